"""Progress counters of finishing tasks as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def counts(done: DataFrame, width: str = "1 day", late: str | None = None) -> DataFrame:
    """Completed, succeeded and failed per window.

    Without ``late`` every row counts, however late it comes; the state is one row per
    window. With it, windows older than that are closed and later rows are lost.
    """
    timed = done.withColumn("ts", F.col("ts").cast("timestamp"))
    if late is not None:
        timed = timed.withWatermark("ts", late)
    return timed.groupBy(F.window("ts", width).alias("w")).agg(
        F.count(F.lit(1)).alias("completed"), F.count_if("ok").alias("succeeded"),
        F.count_if(~F.col("ok")).alias("failed"),
    ).select(
        F.col("w.start").alias("window_start"), "completed", "succeeded", "failed",
        F.try_divide(F.col("succeeded"), F.col("completed")).alias("success_rate"),
    )


def write_updates(updates: DataFrame, folder: str, checkpoint: str):
    """Run a counter stream; each micro-batch overwrites its own folder, so a retry is safe."""
    def save(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/epoch={epoch}")

    return (
        updates.writeStream.outputMode("update").option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).foreachBatch(save).start()
    )


def latest(spark: SparkSession, folder: str) -> DataFrame:
    """Newest figures per window."""
    rows = spark.read.parquet(folder)
    best = F.max(F.struct("epoch", "completed", "succeeded", "failed", "success_rate")).alias("b")
    return rows.groupBy("window_start").agg(best).select(
        "window_start", "b.completed", "b.succeeded", "b.failed", "b.success_rate"
    )
