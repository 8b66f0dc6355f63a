"""The step monitor keeps little state and does not slow down with its history."""

import os

from pyspark.sql import functions as F
from test_scale import hot_steps, rows

from questloom.operators import traces as R
from questloom.streaming import monitor as MO


def started(spark, folder, steps, size):
    MO.monitor(feed(spark, steps.limit(0), f"{folder}-feed"), folder, f"{folder}-state", size).awaitTermination()


def feed(spark, df, path):
    df.write.mode("overwrite").parquet(path)
    return spark.readStream.schema(df.schema).parquet(path)


def test_state_of_many_batches(spark, tmp_path):
    steps = hot_steps(spark, 1200).drop("ts").cache()
    folder = str(tmp_path / "monitor")
    started(spark, folder, steps, 16)
    batches, sizes = 14, []
    for i in range(batches):
        late = F.pmod(F.xxhash64("task_id", "step_index"), F.lit(3))  # a third comes two batches late
        lot = F.floor((F.col("step_index") - 1) * (batches - 4) / 900) + F.when(late == 0, 2).otherwise(0)
        MO.advance(steps.filter(F.least(lot, F.lit(batches - 1)) == i), folder, i, 16)
        sizes.append(spark.read.parquet(f"{folder}/done/epoch={i}").count())
    MO.close(steps, folder, 16)
    want = rows(R.step_flags(steps).select("task_id", "step_index", "action", *R.FLAGS))
    assert rows(MO.flags(spark, folder)) == want
    # Three tasks whose slices end one after the other: a few intervals, and old folders gone.
    assert max(sizes) <= 12 and sizes[-1] <= 3
    assert len([x for x in os.listdir(f"{folder}/done") if x.startswith("epoch")]) <= 4


def test_intervals_are_merged(spark):
    df = spark.createDataFrame([(1, 0, 0), (1, 1, 1), (1, 5, 5), (1, 3, 4), (1, 0, 9), (2, 7, 7), (2, 9, 9)], "task_id int, lo long, hi long")
    assert rows(MO.merged(df)) == [(1, 0, 9), (2, 7, 7), (2, 9, 9)]
    df = df.filter("hi < 9")
    assert rows(MO.merged(df)) == [(1, 0, 1), (1, 3, 5), (2, 7, 7)]
