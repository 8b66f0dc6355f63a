"""Word lists and patterns used while profiling.

Patterns use the common subset of Java regular expressions and RE2; ``[\\p{L}\\p{N}_]``
stands for a word character in any script.
"""

# Fixed values.
WORD = r"[\p{L}\p{N}_]+"
LABEL = rf"({WORD}(?:\s+{WORD}){{0,2}})"
NUM = r"(\d+\.?\d*)"
# A match can only start at a word's first letter or where the last match ended; saying so
# spares the search a try at every letter. RE2 has no such mark and needs none.
START = r"(?:\b|\G)"
# Places no range or limit reaches across, so that a text can be searched piece by piece.
RANGE_GAP = r"(?=[,;!?()\"#])|(?<=[A-Za-z])(?=\.)"
# What every stated range holds: two numbers and what stands between them.
RANGE_CORE = r"(?iU)\d\.?\s*(?:-|–|to|and)\s*\d"
RANGE_BETWEEN = rf"(?i){LABEL}\s+(?:is\s+)?(?:between\s+)?{NUM}\s*(?:-|–|to|and)\s*{NUM}"
RANGE_COMPARE = rf"(?i){LABEL}\s*(>=?|<=?)\s*{NUM}"
RANGE_NORMAL = rf"(?i)normal\s+{LABEL}\s*(?:level|range|value)?\s*[:=-]?\s*{NUM}\s*(?:-|–|to)\s*{NUM}"
TERM_EDGE = ".,;:()[]{}'\"!?"
NUMERIC_TYPES = ("INT", "DOUBLE", "FLOAT", "DECIMAL", "REAL", "NUMERIC", "BIGINT", "HUGEINT")
DATE_TYPES = ("DATE", "TIMESTAMP")
DATE_TOKENS = ("date", "month", "yearmonth", "period")
CATEGORY_COLUMNS = ("segment", "category", "type", "status")
TERM_ALIASES = {
    "white blood cell": ("wbc",),
    "white blood cells": ("wbc",),
    "fibrinogen": ("fg",),
    "platelet": ("plt",),
    "platelets": ("plt",),
    "uric acid": ("ua",),
    "lactate dehydrogenase": ("ldh",),
    "creatinine": ("cre",),
    "glucose": ("glu",),
}
