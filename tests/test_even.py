"""Work is dealt evenly over tasks, and patterns run only where they can match."""

from pyspark.sql import functions as F

from questloom.functions.groups import spread
from questloom.operators import documents as O
from questloom.operators import profile as P
from questloom.operators import thresholds as T
from questloom.plans import catalogue  # noqa: F401 - defines the derived tables
from questloom.plans.registry import Tables
from questloom.rules import documents as R


def optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_rows_are_spread_whatever_their_keys(spark):
    rows = spark.createDataFrame([(None, "x")] * 4000, "k long, v string").coalesce(1)
    sizes = [r["n"] for r in spread(rows).groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert sum(sizes) == 4000 and len(sizes) >= 8 and max(sizes) < 1000


def test_texts_of_a_small_file_are_made_in_many_tasks(spark, tmp_path):
    customers = [(i, f"c{i}", i % 3, 1.5, "BUILDING") for i in range(50)]
    df = spark.createDataFrame(customers, "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string")
    df.coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    t = Tables(spark, str(tmp_path))
    for name in ("narratives", "case_notes", "budget_notes", "race_notes", "ward_notes"):
        assert t.load(name).rdd.getNumPartitions() >= 8, name


def test_range_patterns_run_once_a_row(spark):
    df = spark.createDataFrame([(1, "a 1-2")], "doc_id long, text string")
    plan = optimized(P.doc_ranges(df, "doc_id", "text"))
    assert not [x for x in plan.splitlines() if "Filter" in x and "regexp_extract_all" in x]


def test_ranges_across_and_beside_cuts(spark):
    text = "The size is 5. to 7, mass² (kg) 1.5-2; abnormal level: 3 to 4.x weight >= 9.5! normal 7-8"
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    rows = P.doc_ranges(df, "doc_id", "text").orderBy("range_index").collect()
    got = [(r.type, r.label, r.lo, r.hi, r.op, r.val) for r in rows]
    assert ("range", "the size is", 5.0, 7.0, "", None) in got
    assert ("gt", "x weight", None, None, ">=", 9.5) in got
    assert ("range", "normal", 7.0, 8.0, "", None) in got


def test_needed_words_belong_to_their_patterns(spark):
    assert len(R.PLAIN_ID_WORDS) == len(R.PLAIN_IDS)
    texts = [
        "MEDICAL RECORD NUMBER 11", "File number 12", "Registry Number 13", "registration number 14",
        "tracked by the unique code 15", "entry is referenced by ID 16", "IDENTIFIER 17", "ID:18", "Hero 19", "no id", "none 3",
    ]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, p string")
    got = df.select("i", O.entity_id_any(F.col("p"), "client").alias("e")).orderBy("i").collect()
    assert [r.e for r in got] == ["11", "12", "13", "14", "15", "16", "17", "18", "19", None, None]


def test_field_values_in_any_case(spark):
    texts = [
        "HEIGHT was REVISED to 181", "The placeholder 5 stands for height", "Publisher\nAffiliation FINALIZED as 7",
        "182 CM is their height", "under oversight of publisher 9", "height unknown", "weight 3",
    ]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, s string")
    names = ("height", "recorded height", "publisher", "publisher affiliation")
    rows = df.select("i", O.field_value(F.col("s"), names).alias("v")).orderBy("i").collect()
    assert [r.v and tuple(r.v) for r in rows] == [(98, 181.0), (80, 5.0), (98, 7.0), (60, 182.0), (60, 9.0), None, None]


def test_population_words_are_constants(spark):
    df = spark.createDataFrame([("1", " Female "), ("2", "m"), ("3", None)], "entity_id string, sex string")
    found = T.table_population(df, F.lit("t"), "entity_id", "sex", [" Females", "woman", ""])
    assert [r.entity_id for r in found.collect()] == ["1"]
    assert "lambda" not in optimized(found)
    notes = spark.createDataFrame([("Patient 123 is a woman.",)], "text string")
    plan = optimized(T.document_population(notes, F.lit("d"), "text", ["Females"]))
    assert "array_join" not in plan
