"""Word lists and patterns that read question wording.

Patterns are written in the common subset of Java regular expressions and RE2.
"""

# Fixed values.
TRUTHY = ("true", "1", "yes", "y", "approved")
ENTITY_ALIASES = {
    "name": ("event_name", "name"),
    "id": ("event_id", "id"),
    "type": ("type", "event_type"),
}
MONTHS = (
    "january", "february", "march", "april", "may", "june", "july", "august", "september",
    "october", "november", "december",
)
ORDINALS = (
    ("first", 1), ("1st", 1), ("second", 2), ("2nd", 2), ("third", 3), ("3rd", 3),
    ("fourth", 4), ("4th", 4), ("fifth", 5), ("5th", 5),
)
QUOTED = "'[^']+'|\"[^\"]+\""
QUOTE_EDGES = "^['\"]|['\"]$"
YEAR = r"\b((?:19|20)\d{2})\b"
MONTH_NUMBER = r"\b(?:month|m)\s*(\d{1,2})\b"
RANKED_NUMBER = r"\brank(?:ed)?\s+(\d+)\b"
BETWEEN = r"\bbetween\s+([-+]?\d+(?:\.\d+)?)\s+(?:to|and|-)\s+([-+]?\d+(?:\.\d+)?)\b"
PRODUCT_ID = (
    r"(?i)\bproduct\s+id\s+(?:no\.?\s*)?(\d+)\b",
    r"(?i)\bproduct\s+(?:no\.?\s*)?(\d+)\b",
)
UNIT_THRESHOLD = (
    r"(?i)\bmore than\s+([-+]?\d+(?:\.\d+)?)\s+per unit\b",
    r"(?i)\bgreater than\s+([-+]?\d+(?:\.\d+)?)\s+per unit\b",
    r"(?i)\bpaid\s+more than\s+([-+]?\d+(?:\.\d+)?)\b",
)
CATEGORY = (
    r"(?i)\bbudget\s+in\s+([A-Za-z][A-Za-z ]+?)(?:\s+for\b|\s+of\b|\s+was\b)",
    r"(?i)\b([A-Za-z][A-Za-z ]+?)\s+budget\b",
)
PUBLISHED_BY = r"(?i)published by\s+([A-Za-z0-9 .&'-]+?)(?:\?|$)"
