import itertools
import math
import random
import re

from pyspark.sql import functions as F

import pytest
from questloom.functions import values as V
from questloom.operators.answers import sanitise, split_full_name
from questloom.operators.query import json_path_of, read_only_query
from questloom.sources.tables import unique_names


def test_two_decimals_follow_the_exact_binary_value(spark):
    rng = random.Random(7)
    xs = [0.125, 0.375, 2.675, 1.005, -0.001, 0.005, -2.5, 1e12 + 0.125, 99.995, 0.0, -0.0, 1e8 + 0.375]
    xs += [rng.choice([-1, 1]) * rng.random() * 10 ** rng.randint(-4, 11) for _ in range(3000)]
    xs += [rng.randint(-10**7, 10**7) / 1000 for _ in range(3000)]
    rows = spark.createDataFrame([(repr(x), f"{x:.2f}") for x in xs], "v string, want string")
    bad = rows.withColumn("got", V.fixed2_text(F.col("v"))).filter("NOT (got <=> want)")
    assert bad.count() == 0, bad.take(5)


def test_number_text_is_what_float_reads(spark):
    texts = ["1", " 2.5 ", "1_000", "1__0", "_1", ".5", "5.", "1e3", "1d", "1.0f", "0x10", "", "abc", "+-1", "1,000", "\t7\n"]

    def want(t):
        try:
            x = float(t)
        except ValueError:
            return None
        return x if math.isfinite(x) else None

    df = spark.createDataFrame([(t,) for t in texts], "v string").select("v", V.to_number(F.col("v")).alias("x"))
    assert {r.v: r.x for r in df.collect()} == {t: want(t) for t in texts}


def test_number_form_reads_what_number_text_reads():
    for k in range(8):
        for t in itertools.product("+-10._eE x" if k < 5 else "+1._e", repeat=k):
            t = "".join(t)
            assert bool(re.search(V.NUMBER_FORM, t)) == bool(re.search(V.NUMBER_TEXT, t)), t


def test_a_long_number_with_marks_does_not_use_up_the_stack(spark):
    texts = ["1" + "_1" * 100, "1" + "_1" * 50_000 + "x", "0." + "0_" * 50_000 + "1", "1e" + "0_" * 50_000 + "2"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, v string").repartition(2)
    got = dict(df.select("i", V.to_number(F.col("v"))).collect())
    assert got == {0: float("1" * 101), 1: None, 2: 0.0, 3: 100.0}


def test_special_numbers_and_missing(spark):
    df = spark.createDataFrame([("NaN",), ("-Infinity",), ("inf",), ("n/a",), (" x ",)], "v string")
    got = [r[0] for r in df.select(V.fixed2_text(F.col("v"))).collect()]
    assert got == ["nan", "-inf", "inf", None, None]
    clean = [r[0] for r in df.select(V.clean_cell(F.col("v"), V.MISSING_REPAIR)).collect()]
    assert clean == ["", "", "", "", "x"]
    assert [r[0] for r in df.select(sanitise(F.col("v"))).collect()] == ["", "", "", "n/a", "x"]


def test_split_name(spark):
    df = spark.createDataFrame([("Ann  Lee Oz",), (" Bo ",), ("",)], "n string")
    rows = split_full_name(df, "n").collect()
    assert [(r.first_name, r.last_name) for r in rows] == [("Ann", "Lee Oz"), ("Bo", ""), ("", "")]


def test_view_names(spark):
    paths = ["csv/9 Sales-2024.csv", "9.csv", "__.md", "a.csv", "a.json", "a_2.csv", "x" * 120 + ".csv", "x" * 120 + ".json"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    got = {r.path: r.view_name for r in unique_names(df, "path").collect()}
    assert [got[p] for p in paths[:6]] == ["csv__9_sales_2024", "t_9", "table", "a", "a_2", "a_2_2"]
    assert [got[p] for p in paths[6:]] == ["x" * 96, "x" * 90 + "_2"]
    assert len(set(got.values())) == len(paths)


def test_paths():
    assert json_path_of("a.b.0.c") == "$.a.b[0].c"


def test_read_only(spark):
    assert read_only_query(spark, "/* x */ -- y\n WITH a AS (SELECT 1) SELECT * FROM a -- end").count() == 1
    assert read_only_query(spark, "(SELECT 1);").count() == 1
    for bad in ("DROP TABLE x -- select", "WITH c AS (SELECT 1 AS a) INSERT INTO t SELECT * FROM c", "CREATE VIEW v AS SELECT 1"):
        with pytest.raises(ValueError):
            read_only_query(spark, bad)
