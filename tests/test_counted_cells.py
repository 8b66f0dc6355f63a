"""Cells that are counted before they become text, and CSV lines that need no parser."""

import datetime
import os

from pyspark.sql import functions as F

from questloom.operators import context as X


def both(spark):
    a = spark.createDataFrame(
        [(1, 0.0, "x", True, datetime.date(2024, 1, 2), ["p"]), (1, -0.0, " ", None, None, None), (None, float("nan"), None, False, None, []),
         (2, 1.5e300, "x", True, datetime.date(2024, 1, 2), ["p"]), (2, None, "y" * 300, True, None, ["q"]), (2, -0.0, "y" * 300, True, None, ["q"])],
        "k int, d double, s string, b boolean, day date, l array<string>",
    )
    b = spark.range(3000).select((F.col("id") % 7).alias("k"), (F.col("id") % 3).cast("float").alias("f"), F.timestamp_seconds(F.col("id") % 5).alias("ts"))
    return {"a": a, "b": b, "none": b.limit(0)}


def test_counts_give_the_states_of_the_cells(spark):
    tables = both(spark)
    counts = X.all_cells([X.table_counts(tables)])
    cells = X.all_cells([X.table_cells(n, df) for n, df in tables.items()])
    for exact in (True, False):
        want = {tuple(r) for r in X.column_states(cells, exact).collect()}
        assert {tuple(r) for r in X.column_states(counts, exact).collect()} == want and len(want) == 9
    # 9,000 cells of the second table travel as 7 + 3 + 5 counts.
    assert counts.filter("path = 'b'").count() == 15 and counts.agg(F.sum("n")).first()[0] == cells.count()


def test_plain_and_quoted_lines(spark, tmp_path):
    lines = ["a, b ,c", '1,"x,y",2', "1,,", "1", "1,2,3,4,5", " ,  ,", '"q""r",z\\,w', ",,", "   ", "é,漢,\tz"]
    os.makedirs(tmp_path / "d+e f")
    for part in (0, 1):
        (tmp_path / "d+e f" / f"part-{part}.csv").write_text("﻿" * (1 - part) + "\n".join(lines) + "\n")
    cells = X.csv_cells(spark, str(tmp_path))
    got = {}
    for r in cells.collect():
        assert r.path == "d+e f" and r.type == "csv" and ["a", "b", "c"][r.ordinal] == r.column
        got.setdefault(r.column, []).append(r.value)
    rows = [("1", "x,y", "2"), ("1", None, None), ("1", None, None), ("1", "2", "3"), (" ", "  ", None), ('q"r', "z\\", "w"), (None, None, None), ("   ", None, None), ("é", "漢", "\tz")]
    for i, name in enumerate("abc"):
        assert sorted(map(str, got[name])) == sorted(str(r[i]) for r in rows * 2)


def test_json_texts_are_read_in_one_pass(spark):
    texts = ['{"records":[{"a":1},7,{"b":null}]}', '[{"a":"x"},2]', ' {"c":{"d":1}}', '{"records":[]}', '{"records":"none"}', '{"bro', "7", None, "", '{"records":null,"e":2}']
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "p string, v string")
    out = X.json_cells(df, "p", "v")
    got = {(r.path, r.ordinal, r.column, r.value) for r in out.collect()}
    assert got == {("0", 0, "a", "1"), ("0", 0, "b", None), ("1", 0, "a", "x"), ("2", 0, "c", '{"d":1}'), ("4", 0, "records", "none"), ("9", 0, "records", None), ("9", 1, "e", "2")}
    plan = spark._jvm.PythonSQLUtils.explainString(out._jdf.queryExecution(), "simple")
    assert "Union" not in plan
