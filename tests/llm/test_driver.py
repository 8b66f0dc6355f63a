"""What the driver holds while a stage runs."""

import numpy as np
from pyspark.sql import functions as F

from questloom.llm import neardup, quality


def _docs(spark, n=60):
    return spark.createDataFrame(
        [(i, " ".join(f"w{(i * 7 + j) % 31}" for j in range(12)), "en") for i in range(n)], "doc_id long, text string, lang string"
    )


def test_bitmaps_come_in_small_partitions(spark, monkeypatch):
    """One file holds all pieces; the JVM never hands them over at once."""
    size = 1 << (neardup.BITMAP_BITS - 3 - 5)  # 32 pieces a class
    profiled = spark.range(32 * len(neardup.CLASSES)).coalesce(1).select(
        F.col("id").cast("int").alias("piece"), F.unhex(F.lpad(F.hex(F.col("id")), 2, "0")).alias("b")
    ).select("piece", F.expr(f"unhex(repeat(hex(b), {size}))").alias("bits"))
    most, kind = [], type(profiled)
    plain = kind.toLocalIterator

    def watched(df, *args, **kw):
        most.append(df.groupBy(F.spark_partition_id()).agg(F.sum(F.octet_length("bits")).alias("n")).agg(F.max("n")).first()[0])
        return plain(df, *args, **kw)

    monkeypatch.setattr(kind, "toLocalIterator", watched)
    got = neardup.class_bitmaps(profiled)
    whole = len(neardup.CLASSES) << (neardup.BITMAP_BITS - 3)
    assert most and max(most) <= whole // 4
    want = np.repeat(np.arange(32 * len(neardup.CLASSES), dtype=np.uint8), size).reshape(got.shape)
    assert (got == want).all()


def test_last_plan_of_accept_is_small(spark):
    """Bands and centres are read back, not planned again and again."""
    plan = quality.accept(_docs(spark))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window") == 0 and plan.count("Join") <= 4


def test_more_pairs_reads_open_lists_once_written(spark):
    index = spark.createDataFrame([(t, i, 10) for t in range(3) for i in range(6)], "token long, id long, n long")
    labels = spark.createDataFrame([(i, i // 3) for i in range(6)], "id long, label long")
    marks = spark.createDataFrame([(i, *[0] * len(neardup.BITS)) for i in range(6)], "id long, " + ", ".join(f"{b} long" for b in neardup.BITS))
    pairs = neardup.later_pairs(index, labels, marks, 80, few=64)
    assert pairs._jdf.queryExecution().optimizedPlan().toString().count("Join") <= 5
    assert {tuple(r) for r in pairs.collect()} == {(a, b) for a in range(3) for b in range(3, 6)}
