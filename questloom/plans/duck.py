"""DuckDB spellings of the shared cell rules, used only in oracle SQL."""

from __future__ import annotations

from questloom.functions.values import NUMBER_TEXT


def trimmed(v: str) -> str:
    return f"regexp_replace({v}, '^\\s+|\\s+$', '', 'g')"


def num(v: str) -> str:
    s = trimmed(v)
    return f"CASE WHEN regexp_matches({s}, '{NUMBER_TEXT}') THEN TRY_CAST(replace({s}, '_', '') AS DOUBLE) END"


def fixed2(v: str) -> str:
    s = trimmed(v)
    return (
        f"CASE WHEN regexp_matches({s}, '(?i)^[+-]?(inf|infinity|nan)$') THEN"
        f" CASE WHEN lower({s}) LIKE '%nan%' THEN 'nan' WHEN {s} LIKE '-%' THEN '-inf' ELSE 'inf' END"
        f" ELSE format('{{:.2f}}', {num(v)}) END"
    )


def any_contains(c: str, terms) -> str:
    return "(" + " OR ".join(f"contains({c}, '{t}')" for t in terms) + ")"


def holds(c: str, groups) -> str:
    return "(" + " AND ".join(any_contains(c, g) for g in groups) + ")"


def names_of(pairs) -> str:
    items = ", ".join(f"CASE WHEN {cond} THEN '{name}' END" for name, cond in pairs)
    return f"list_filter([{items}], lambda x: x IS NOT NULL)"


def like(c: str, pattern: str) -> str:
    return f"regexp_matches({c}, '{pattern.replace(chr(39), chr(39) * 2)}')"


def extract(c: str, pattern: str, group: int = 1) -> str:
    return f"NULLIF(regexp_extract({c}, '{pattern.replace(chr(39), chr(39) * 2)}', {group}), '')"


def squash(c: str) -> str:
    return f"trim(regexp_replace({c}, '\\s+', ' ', 'g'))"


def distinct_ignoring_case(items: str) -> str:
    return (
        f"list_filter({items}, lambda x, i: list_position(list_transform({items}, lambda y: lower(y)), lower(x)) = i)"
    )
