"""Mine scored runs for failure patterns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from questloom.rules import traces as R

GROUPS = ("difficulty", "route", "task_type", "operation", "output_shape")


def task_rows(runs: DataFrame, scores: DataFrame, failures_only: bool = False, fail_below: float = 0.5) -> DataFrame:
    """Runs with their score; an unscored task counts as 1.0.

    ``failures_only`` uses just the scores below ``fail_below``, as a failures list would.
    """
    if failures_only:
        scores = scores.filter(F.col("score") < fail_below)
    named = [F.coalesce(c, F.lit("unknown")).alias(c) for c in GROUPS]
    return runs.join(scores.select("task_id", "score"), "task_id", "left").select(
        "task_id", *named, "domains", F.coalesce("score", F.lit(1.0)).alias("score")
    )


def low_scores(rows: DataFrame, threshold: float = 1.0) -> DataFrame:
    return rows.filter(F.col("score") < threshold).orderBy("score", "difficulty", "task_id")


def group_counts(rows: DataFrame, signals: DataFrame) -> DataFrame:
    """Task counts by each label, by domain and by signal, as (kind, name, n)."""
    sets = [[g] for g in GROUPS]
    kind = F.lit(None)
    name = F.lit(None)
    for g in GROUPS:
        kind = F.when(F.col(f"_{g}") == 0, F.lit(g)).otherwise(kind)
        name = F.when(F.col(f"_{g}") == 0, F.col(g)).otherwise(name)
    scalars = (
        rows.groupingSets(sets, *GROUPS)
        .agg(F.count(F.lit(1)).alias("n"), *[F.grouping(g).alias(f"_{g}") for g in GROUPS])
        .select(kind.alias("kind"), name.alias("name"), "n")
    )
    domains = rows.select(F.explode("domains").alias("name")).groupBy("name").agg(
        F.count(F.lit(1)).alias("n")
    ).select(F.lit("domain").alias("kind"), "name", "n")
    codes = (
        signals.select("task_id", F.col("code").alias("name")).distinct()
        .join(rows.select("task_id"), "task_id", "left_semi").groupBy("name").agg(F.count(F.lit(1)).alias("n"))
        .select(F.lit("signal").alias("kind"), "name", "n")
    )
    return reduce(DataFrame.unionByName, [scalars, domains, codes])


def tasks_by(rows: DataFrame, column: str) -> DataFrame:
    """Task ids per label, as rows in order: a label may cover most tasks."""
    return rows.select(F.col(column).alias("label"), "task_id").orderBy("label", "task_id")


def recommendations(rows: DataFrame, signals: DataFrame) -> DataFrame:
    """Priority 10 per task plus 5 per lost score, for known signals and task types."""
    loss = F.greatest(F.lit(0.0), F.lit(1.0) - F.col("score"))
    s_area = F.create_map(*[F.lit(x) for pair in R.SIGNAL_RULES for x in pair])
    t_area = F.create_map(*[F.lit(x) for pair in R.TYPE_RULES for x in pair])
    base = rows.select("task_id", "task_type", loss.alias("loss"))
    by_signal = (
        signals.select("task_id", F.col("code").alias("key")).distinct().join(base, "task_id")
        .select(F.lit("signal").alias("kind"), "key", F.try_element_at(s_area, F.col("key")).alias("area"), "task_id", "loss")
    )
    by_type = base.select(
        F.lit("task_type").alias("kind"), F.col("task_type").alias("key"),
        F.try_element_at(t_area, F.col("task_type")).alias("area"), "task_id", "loss",
    )
    # task_id is unique per (kind, key), so a plain count is the distinct count.
    out = by_signal.unionByName(by_type).filter(F.col("area").isNotNull()).groupBy("kind", "key", "area").agg(
        F.count(F.lit(1)).alias("task_count"), F.round(F.sum("loss"), 4).alias("total_score_loss")
    )
    return out.withColumn(
        "priority", F.round(F.col("task_count") * 10 + F.col("total_score_loss") * 5, 4)
    ).orderBy(F.desc("priority"), "kind", "key")
