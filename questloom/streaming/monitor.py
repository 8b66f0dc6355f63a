"""Judge steps as they arrive, in any order, with the rules of the batch.

Each micro-batch adds its rows to the open slices of their tasks and judges every step
whose predecessors in the slice are there. Slices overlap as in the batch, so a slice holds
at most its size plus the reach of the rules, and a task with very many steps is spread
over many keys. Nothing is dropped by time: a step waits until its predecessors come or
until ``close`` is called.

Folders: ``flags`` (results), ``open`` (rows of unfinished slices) and ``done`` (finished
slices, as intervals that are merged with their neighbours), one subfolder per micro-batch.
A micro-batch reads what the last one left and nothing older, so its cost follows the tasks
and not the history; older subfolders are removed. A retried micro-batch writes its own again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from questloom.functions.groups import step_slices
from questloom.operators.traces import FLAGS, REPEAT_WINDOW, SCOUT_WINDOW, judged

REACH = max(REPEAT_WINDOW, SCOUT_WINDOW)
COLUMNS = ("task_id", "step_index", "action", "action_key", "ok", "rows_returned")
CLOSED = 2**62


def _left_by(spark: SparkSession, folder: str, kind: str, epoch: int, schema) -> DataFrame:
    """What micro-batch ``epoch`` wrote."""
    return spark.read.schema(schema).parquet(f"{folder}/{kind}/epoch={epoch}")


def _files(spark: SparkSession, path: str):
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return there, there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _forget(spark: SparkSession, folder: str, epoch: int) -> None:
    """Remove the state of a micro-batch that no retry can ask for any more."""
    for kind in ("open", "done", "step"):
        path, files = _files(spark, f"{folder}/{kind}/epoch={epoch}")
        files.delete(path, True)


def _last_epoch(spark: SparkSession, folder: str) -> int:
    path, files = _files(spark, f"{folder}/done")
    return max(int(f.getPath().getName().split("=")[1]) for f in files.listStatus(path) if "=" in f.getPath().getName())


def merged(intervals: DataFrame) -> DataFrame:
    """``(task_id, lo, hi)`` with overlapping and adjacent intervals of a task joined."""
    by_lo = Window.partitionBy("task_id").orderBy("lo", "hi")
    before = F.max("hi").over(by_lo.rowsBetween(Window.unboundedPreceding, -1))
    starts = intervals.withColumn("_new", F.coalesce(F.col("lo") > before + 1, F.lit(True)).cast("int"))
    grouped = starts.withColumn("_g", F.sum("_new").over(by_lo.rowsBetween(Window.unboundedPreceding, 0)))
    return grouped.groupBy("task_id", "_g").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("_g")


def advance(batch: DataFrame, folder: str, epoch: int, size: int, close: bool = False) -> None:
    """Take in one micro-batch. Steps that were judged already are ignored."""
    spark = batch.sparkSession
    last = _last_epoch(spark, folder) if close else epoch - 1
    new = step_slices(batch.select(*COLUMNS), "step_index", REACH, size).withColumn("_told", F.lit(False))
    done = _left_by(spark, folder, "done", last, _intervals(new).schema)
    over = (new["task_id"] == done["task_id"]) & new["_part"].between(done["lo"], done["hi"])
    rows = new.join(done, over, "left_anti").unionByName(_left_by(spark, folder, "open", last, new.schema))
    # A step that came twice counts once; one that was told before stays told.
    step = Window.partitionBy("task_id", "_part", "step_index").orderBy(F.desc("_told"))
    rows = rows.withColumn("_i", F.row_number().over(step)).filter("_i = 1").drop("_i")
    slice_ = Window.partitionBy("task_id", "_part")
    first = F.when(F.col("_part") == 0, 1).otherwise(F.col("_part") * size - REACH + 1)
    dense = F.row_number().over(slice_.orderBy("step_index")) == F.col("step_index") - first + 1
    seen = judged(rows).withColumn("_ready", F.lit(True) if close else dense)
    seen = seen.withColumn("_full", F.count_if(F.col("_own") & F.col("_ready")).over(slice_) == size)
    seen = seen.withColumn("_full", F.lit(True) if close else F.col("_full"))
    at = f"{folder}/{{}}/epoch={epoch}"
    # Written first with its marks, so that flags, open rows and names come from one result.
    seen.write.mode("overwrite").parquet(at.format("step"))
    seen = spark.read.schema(seen.schema).parquet(at.format("step"))
    seen.filter("_own AND _ready AND NOT _told").select("task_id", "step_index", "action", *FLAGS).write.mode(
        "overwrite"
    ).parquet(at.format("flags"))
    seen.filter("NOT _full").withColumn("_told", F.col("_told") | (F.col("_own") & F.col("_ready"))).select(
        *rows.columns
    ).write.mode("overwrite").parquet(at.format("open"))
    ended = _intervals(seen.filter("_full"))
    merged(done.unionByName(ended)).write.mode("overwrite").parquet(at.format("done"))
    if not close:
        _forget(spark, folder, epoch - 2)


def _intervals(slices: DataFrame) -> DataFrame:
    part = F.col("_part").cast("long")
    return slices.select("task_id", part.alias("lo"), part.alias("hi")).distinct()


def monitor(steps: DataFrame, folder: str, checkpoint: str, size: int = 512):
    """Start the stream over what is available; results gather below ``folder``."""
    # Empty first folders, so that every micro-batch finds something to read.
    spark = steps.sparkSession
    empty = step_slices(spark.createDataFrame([], steps.select(*COLUMNS).schema), "step_index", REACH, size)
    empty = empty.withColumn("_told", F.lit(False))
    empty.write.mode("overwrite").parquet(f"{folder}/open/epoch=-1")
    _intervals(empty).write.mode("overwrite").parquet(f"{folder}/done/epoch=-1")
    return (
        steps.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
        .foreachBatch(lambda batch, epoch: advance(batch, folder, epoch, size)).start()
    )


def close(steps: DataFrame, folder: str, size: int = 512) -> None:
    """Judge what still waits for a lost predecessor, in the order of its steps.

    ``steps`` gives the schema only; call it when the stream has ended.
    """
    spark = steps.sparkSession
    advance(spark.createDataFrame([], steps.select(*COLUMNS).schema), folder, CLOSED, size, close=True)


def flags(spark: SparkSession, folder: str) -> DataFrame:
    """All flags so far."""
    return spark.read.parquet(f"{folder}/flags").drop("epoch")
