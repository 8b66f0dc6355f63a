"""Task definitions and execution traces held as JSON."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values.
TASK_KEYS = ("difficulty", "question", "task_id")
TRACE_SCHEMA = (
    "task_id string, succeeded boolean, failure_reason string, steps array<struct<"
    "step_index: bigint, thought: string, action: string, action_input: string,"
    " ok: boolean, observation: string>>"
)


def scan_strict(df: DataFrame, folder: str, column: str) -> DataFrame:
    """Parse task definitions; ``fault`` says why a row is not a valid task."""
    c = F.col(column)
    keys = F.sort_array(F.json_object_keys(c))
    row = F.from_json(c, "task_id string, difficulty string, question string")
    fault = (
        F.when(F.try_parse_json(c).isNull() | keys.isNull(), F.lit("not an object"))
        .when(keys != F.array(*[F.lit(k) for k in TASK_KEYS]), F.lit("wrong keys"))
        .when(row["task_id"] != F.col(folder), F.lit("id differs from folder"))
    )
    number = F.regexp_extract(row["task_id"], r"(\d+)$", 1).try_cast("bigint")
    return df.select(
        folder, row["task_id"].alias("task_id"), row["difficulty"].alias("difficulty"),
        row["question"].alias("question"), fault.alias("fault"),
        F.when(fault.isNull(), number).alias("task_no"),
    )


def select_tasks(
    tasks: DataFrame, ids: Sequence[object] = (), difficulties: Sequence[str] = ()
) -> DataFrame:
    if ids:
        tasks = tasks.filter(F.col("task_id").isin(*ids))
    if difficulties:
        tasks = tasks.filter(F.col("difficulty").isin(*difficulties))
    return tasks


def counts(tasks: DataFrame) -> DataFrame:
    return tasks.groupBy("difficulty").agg(F.count(F.lit(1)).alias("n"))


def trace_steps(df: DataFrame, column: str, keep: Sequence[str] = ()) -> DataFrame:
    """One row per step; input and observation stay JSON text."""
    doc = df.select(*keep, F.from_json(F.col(column), TRACE_SCHEMA).alias("_t"))
    return doc.select(*keep, "_t.task_id", F.explode("_t.steps").alias("_s")).select(
        *keep, "task_id", "_s.step_index", "_s.action", "_s.ok", "_s.observation"
    )
