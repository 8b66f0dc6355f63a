"""Cell-level expressions shared by every operator that reads text cells."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The three missing-value policies.
MISSING_BLANK = ("",)
MISSING_SANITISE = ("", "null", "none", "nan", "na", "n/a", "nat")
MISSING_REPAIR = (
    "null", "none", "nan", "na", "n/a", "nat", "inf", "-inf", "infinity", "-infinity",
)
# The text forms of a float literal.
NUMBER_TEXT = (
    r"^[+-]?(\d+(_\d+)*(\.(\d+(_\d+)*)?)?|\.\d+(_\d+)*)([eE][+-]?\d+(_\d+)*)?$"
)
# The same forms without a way back, since Java keeps one on the stack for every ``_`` of a long text.
NUMBER_FORM = (
    r"^[+-]?+(?:\d++(?:_\d++)*+(?:\.(?:\d++(?:_\d++)*+)?+)?+|\.\d++(?:_\d++)*+)(?:[eE][+-]?+\d++(?:_\d++)*+)?+$"
)
SPECIAL_TEXT = r"(?i)^[+-]?(inf|infinity|nan)$"

SPACES = " \t\n\x0b\f\r"


def bound(c: Column, body) -> Column:
    """Evaluate ``c`` once and use it several times in ``body``.

    Repeating a long expression inline multiplies the generated code.
    """
    return F.element_at(F.transform(F.array(c), body), 1)


def trimmed(c: Column) -> Column:
    """Strip leading and trailing white space."""
    return F.btrim(c, F.lit(SPACES))


def number_of(s: Column) -> Column:
    """Trimmed text to double, NULL when it is not a finite float literal."""
    return F.when(
        s.rlike(NUMBER_FORM), F.replace(s, F.lit("_"), F.lit("")).try_cast("double")
    )


def to_number(c: Column) -> Column:
    """Text to double, NULL when the text is not a finite float literal."""
    return number_of(trimmed(c))


def to_number_commas(c: Column) -> Column:
    """As :func:`to_number` after removing thousands commas."""
    return to_number(F.replace(c, F.lit(","), F.lit("")))


def _hundredths(a: Column) -> Column:
    """``100 * a`` rounded half to even on the exact binary value of ``a``.

    The product is split into its rounded part and its exact error, so a tie counts as
    one only when the binary value really is one.
    """
    def with_high(hi: Column) -> Column:
        p = a * F.lit(100.0)
        err = (hi * F.lit(100.0) - p) + (a - hi) * F.lit(100.0)
        f = F.floor(p)
        half = p - f
        up = (half > 0.5) | ((half == 0.5) & ((err > 0) | ((err == 0) & (f % 2 == 1))))
        return f + F.when(up, F.lit(1)).otherwise(F.lit(0))

    c = a * F.lit(134217729.0)
    return bound(c - (c - a), with_high)


def fixed2_of(x: Column, negative: Column) -> Column:
    """A double printed with two decimals, as ``%.2f`` prints its exact binary value."""
    def printed(a: Column) -> Column:
        small = bound(
            _hundredths(a),
            lambda n: F.concat(
                F.floor(n / 100).cast("string"), F.lit("."),
                F.lpad((n % 100).cast("string"), 2, "0"),
            ),
        )
        big = a.try_cast("decimal(38,2)").cast("string")
        return F.when(a < F.lit(9.0e13), small).otherwise(big)

    sign = F.when(negative, F.lit("-")).otherwise(F.lit(""))
    return F.concat(sign, bound(F.abs(x), printed))


def fixed2_text(c: Column) -> Column:
    """Numeric text printed with two decimals; NULL when the text is not numeric."""
    def printed(s: Column) -> Column:
        sign = F.when(s.startswith("-"), F.lit("-")).otherwise(F.lit(""))
        special = F.when(F.lower(s).contains("nan"), F.lit("nan")).otherwise(
            F.concat(sign, F.lit("inf"))
        )
        return F.when(s.rlike(SPECIAL_TEXT), special).otherwise(
            fixed2_of(number_of(s), s.startswith("-"))
        )

    return bound(trimmed(c), printed)


def clean_cell(c: Column, tokens: tuple[str, ...]) -> Column:
    """Trim a cell and turn the policy's missing tokens into ''."""
    s = trimmed(F.coalesce(c, F.lit("")))
    return F.when(F.lower(s).isin(*tokens), F.lit("")).otherwise(s)


def normal_words(c: Column) -> Column:
    """Lower case, every run of other characters than a-z 0-9 to one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def any_contains(c: Column, terms: tuple[str, ...] | list[str]) -> Column:
    """True when the text holds at least one of the literal terms."""
    out = F.lit(False)
    for term in terms:
        out = out | c.contains(term)
    return out


def any_word(c: Column, words: tuple[str, ...] | list[str]) -> Column:
    """True when one of the words occurs between word boundaries."""
    return c.rlike(r"(?U)\b(" + "|".join(words) + r")\b")
