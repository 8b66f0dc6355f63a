"""Turn rule data into column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from questloom.functions.values import any_contains, bound


def holds(text: Column, groups: Sequence[Sequence[str]]) -> Column:
    """Every group has at least one of its terms in the text."""
    out = F.lit(True)
    for group in groups:
        out = out & any_contains(text, group)
    return out


def names_of(pairs: Sequence[tuple[str, Column]]) -> Column:
    """Array of the names whose condition holds, in the given order."""
    return F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in pairs]))


def pick(c: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def distinct_ignoring_case(items: Column) -> Column:
    """First spelling of every item, order kept."""
    def keep(xs: Column) -> Column:
        lowers = F.transform(xs, lambda x: F.lower(x))
        return F.filter(
            xs, lambda x, i: F.array_position(lowers, F.lower(x)) == (i + 1).cast("bigint")
        )

    return bound(items, keep)


def squash_space(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))
