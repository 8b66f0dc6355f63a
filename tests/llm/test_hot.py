"""Keys that hold a large share of the rows."""

import random

import brute
import pytest
from pyspark.sql import functions as F

from questloom.llm import common, repeats


def test_rows_of_a_hot_key_stay_where_they_are(spark):
    rows = spark.range(0, 6000, 1, 6).select(F.when(F.col("id") % 10 == 0, F.col("id")).otherwise(F.lit(-1)).alias("h"), "id")
    side = spark.range(-1, 6000, 20).select(F.col("id").alias("h"), F.lit("x").alias("s"))
    side = side.union(spark.createDataFrame([(0, "y"), (20, "y")], "h long, s string"))
    hot = spark.createDataFrame([(-1,), (7777,)], "h long")
    out = repeats.meet(rows, side, ["h"], hot)
    want = {(r.id, r.s) for r in rows.join(side, "h").collect()}
    assert {(r.id, r.s) for r in out.collect()} == want and out.count() == rows.join(side, "h").count()
    most = out.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert most <= 1000


@pytest.mark.parametrize("share", [1, 40])
def test_repeats_with_hot_anchors(spark, share):
    rng = random.Random(9)
    words = ["".join(rng.choices("abcdefgh", k=6)) for _ in range(2000)]
    passage = " ".join(words[:90])
    rows = [(i, " ".join(rng.choices(words, k=30)) + passage) for i in range(60)] + [(100 + i, passage * 2) for i in range(60)]
    rows += [(300, None), (301, ""), (302, " ".join(words[100:200])), (303, " ".join(words[100:200]) + "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").select(*common.row_key("doc_id", "text"), "doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("_b"))
    spans = repeats.repeated_spans(docs.drop("doc_id"), share=share)
    got = {r.doc_id: (len(r._b), sum(e - s for s, e in repeats.merged(r.spans)), len(repeats.merged(r.spans))) for r in docs.join(spans, ["_k1", "_k2"], "left").collect()}
    assert got == {k: v[:3] for k, v in brute.repeats(rows).items()}
