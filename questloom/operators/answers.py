"""Clean and reshape answer tables held as long cells, all tasks in one job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from questloom.functions.values import (
    MISSING_REPAIR,
    any_contains,
    clean_cell,
    fixed2_text,
    to_number,
    to_number_commas,
    trimmed,
)
from questloom.rules import shapes as R


#: Rows of an answer that meet the answer's figures in one task.
SLICE = 1 << 16


def _slice() -> Column:
    return F.floor(F.col("row_idx") / SLICE).alias("_slice")


def normalise_cells(cells: DataFrame) -> DataFrame:
    """Trim, blank the missing tokens and pad short rows to the task's width.

    The only per-row array holds the row's own cells. Of a cell given twice the least
    value stays. Rows meet the width by slices of an answer, so a long one is spread.
    """
    slices = cells.groupBy("task_id", _slice()).agg((F.max("col_idx") + 1).alias("_w"))
    width = slices.select("task_id", "_slice", F.max("_w").over(Window.partitionBy("task_id")).alias("_w"))
    once = cells.groupBy("task_id", "row_idx", "col_idx").agg(F.min("v").alias("v"))
    row = once.groupBy("task_id", "row_idx").agg(
        F.map_from_entries(
            F.collect_list(F.struct("col_idx", clean_cell(F.col("v"), MISSING_REPAIR)))
        ).alias("_m")
    )
    return (
        row.withColumn("_slice", _slice()).join(width, ["task_id", "_slice"])
        .select("task_id", "row_idx", "_m", F.explode(F.expr("sequence(0, _w - 1)")).alias("col_idx"))
        .select(
            "task_id", "row_idx", "col_idx",
            F.coalesce(F.try_element_at("_m", F.col("col_idx")), F.lit("")).alias("v"),
        )
    )


def sanitise(c: Column) -> Column:
    """Missing tokens to '', every numeric cell to two decimals."""
    s = trimmed(F.coalesce(c, F.lit("")))
    return F.when(F.lower(s).isin(*R.SANITISE_TOKENS), F.lit("")).otherwise(
        F.coalesce(F.when(to_number(s).isNotNull(), fixed2_text(s)), s)
    )


def too_precise(c: Column) -> Column:
    """True for numeric text with more than two characters after the point."""
    s = trimmed(c)
    tail = F.length(F.split_part(s, F.lit("."), F.lit(2)))
    return F.coalesce(to_number_commas(s).isNotNull() & (tail > 2), F.lit(False))


def round_cells(cells: DataFrame) -> DataFrame:
    """Print long decimals with two places; ``changed`` marks the edited cells."""
    edit = too_precise(F.col("v")) & to_number(F.col("v")).isNotNull()
    return cells.withColumn("changed", edit).withColumn(
        "v", F.when(edit, fixed2_text(F.col("v"))).otherwise(F.col("v"))
    )


def split_full_name(df: DataFrame, column: str) -> DataFrame:
    """First word and the rest; a single word has no last name."""
    words = F.filter(F.split(F.col(column), r"\s+"), lambda w: w != "")
    rest = F.array_join(F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0))), " ")
    first = F.when(F.size(words) >= 2, F.try_element_at(words, F.lit(1))).otherwise(
        trimmed(F.col(column))
    )
    return df.withColumn("first_name", first).withColumn("last_name", rest)


def prune_to_column(cells: DataFrame, keep: DataFrame) -> DataFrame:
    """Keep one named column per task; a task whose header lacks it stays whole.

    ``cells`` carries ``col_name``; ``keep`` is ``(task_id, keep_column)``. Cells meet
    their task's choice by slices of an answer, so a long one is spread.
    """
    named = F.lower(F.trim("col_name"))
    wanted = keep.select("task_id", F.lower(F.trim("keep_column")).alias("_keep"))
    seen = cells.select("task_id", _slice(), named.alias("_keep")).distinct()
    found = seen.select("task_id", "_keep").distinct().join(wanted, ["task_id", "_keep"])
    choice = seen.select("task_id", "_slice").distinct().join(found, "task_id")
    return (
        cells.withColumn("_slice", _slice()).join(choice, ["task_id", "_slice"], "left")
        .filter(F.col("_keep").isNull() | (named == F.col("_keep"))).select(*cells.columns)
    )


def split_packed_score(cells: DataFrame) -> DataFrame:
    """``a - b`` or ``a:b`` as two columns; other cells are left out."""
    home = F.regexp_extract("v", R.PACKED_SCORE, 1)
    return cells.filter(F.col("v").rlike(R.PACKED_SCORE)).select(
        "task_id", "row_idx", home.alias("home"),
        F.regexp_extract("v", R.PACKED_SCORE, 2).alias("away"),
    )


def strip_percent(cells: DataFrame) -> DataFrame:
    s = trimmed(F.col("v"))
    hit = s.rlike(R.PERCENT_CELL)
    return cells.select(
        "task_id", "row_idx", F.when(hit, F.regexp_extract(s, R.PERCENT_CELL, 1)).otherwise(F.col("v")).alias("v"),
        hit.alias("changed"),
    )


def shape_check(cells: DataFrame) -> DataFrame:
    """Rows per task, its width, and how many rows are not that wide.

    ``row_idx`` -1 holds the header; without one the widest row is taken. Rows of one
    width are counted together before the task's figures are taken from them.
    """
    body = F.col("row_idx") >= 0
    rows = cells.groupBy("task_id", "row_idx").agg(F.count(F.lit(1)).alias("w"))
    alike = rows.groupBy("task_id", "w").agg(F.count_if(body).alias("n"), F.max(~body).alias("head"))
    task = Window.partitionBy("task_id")
    width = F.coalesce(F.max(F.when(F.col("head"), F.col("w"))).over(task), F.max("w").over(task))
    out = alike.withColumn("width", width).groupBy("task_id", "width").agg(
        F.sum("n").alias("rows"), F.sum(F.when(F.col("w") != F.col("width"), F.col("n")).otherwise(0)).alias("bad_rows")
    )
    return out.filter(F.col("rows") > 0).withColumn("ok", F.col("bad_rows") == 0)


def requests_many_fields(q: Column) -> Column:
    """``q`` is lower-case question text."""
    hits = F.lit(0)
    for term in R.FIELD_TERMS:
        hits = hits + q.contains(term).cast("int")
    return any_contains(q, R.MANY_MARKERS) & (hits >= 2)


def _entity_candidates(q: Column) -> Column:
    parts = []
    for entity in R.ENTITY_TERMS:
        if entity == "transaction":
            names = R.TRANSACTION_COLUMNS
        else:
            names = tuple(p.format(e=entity) for p in R.ENTITY_COLUMNS)
        parts.append((q.rlike(rf"\b{entity}s?\b"), names))
    parts.append((any_contains(q, ("withdrawal", "transaction", "transactions")), R.TRANSACTION_COLUMNS))
    parts.append((any_contains(q, ("event", "events")), R.EVENT_COLUMNS))
    none = F.expr("cast(array() as array<string>)")
    return F.concat(
        *[F.when(hit, F.array(*[F.lit(n) for n in names])).otherwise(none) for hit, names in parts]
    )


def _only(cols: Column, name: str) -> Column:
    some = F.filter(cols, lambda c: (c == name) | c.endswith(f"_{name}"))
    return F.when(F.size(some) == 1, F.try_element_at(some, F.lit(1)))


def keep_column_choice(df: DataFrame, question: str, headers: str) -> DataFrame:
    """The one column a question asks for, or NULL. ``headers`` is an array column."""
    q = F.lower(F.col(question))
    cols = F.transform(F.col(headers), lambda c: F.lower(F.trim(c)))
    wide = F.size(cols) > 1
    site = any_contains(q, ("website", "web site", "url")) & any_contains(q, ("name", "reference", "ref"))
    asks = q.rlike(r"\b(which|what|list|show|return|give)\b")
    first = F.try_element_at(
        F.filter(_entity_candidates(q), lambda c: F.array_contains(cols, c)), F.lit(1)
    )
    single = F.when(
        wide & ~requests_many_fields(q) & ~site & asks,
        F.coalesce(first, _only(cols, "id"), _only(cols, "name")),
    )

    def countish(c: Column) -> Column:
        return c.isin(*R.COUNT_COLUMNS) | c.endswith("_count")

    others = F.filter(cols, lambda c: ~countish(c))
    liked = F.filter(
        F.array(*[F.lit(n) for n in R.TALLY_PREFERRED]), lambda n: F.array_contains(cols, n)
    )
    tally = F.when(
        wide & q.rlike(r"\btall(?:y|ied|ies)\b") & F.exists(cols, countish) & (F.size(others) > 0),
        F.coalesce(F.try_element_at(liked, F.lit(1)), F.try_element_at(others, F.lit(1))),
    )
    return df.withColumn("keep_single", single).withColumn("keep_tally", tally)
