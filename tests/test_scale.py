"""Results do not depend on how the rows are spread, also when one key holds most rows."""

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from questloom.functions import groups as G
from questloom.operators import traces as R
from questloom.operators import thresholds as T
from questloom.operators import verify as V
from questloom.plans.catalogue import QUERIES
from questloom.sources import tables as TB

SMALL = "/root/testdata/sf0.001"


def hot_steps(spark, n=6000):
    """Steps of three tasks; one has two thirds of the rows."""
    act = F.element_at(F.array(*[F.lit(a) for a in ("search_doc", "execute_data_sql", "read_doc", "execute_python", "search_doc")]), (F.abs(F.xxhash64("id")) % 5 + 1).cast("int"))
    base = spark.range(n).select(
        "id", F.when(F.col("id") % 3 < 2, 0).otherwise(F.col("id") % 2 + 1).alias("task_id"), act.alias("action"),
        (F.abs(F.xxhash64("id", F.lit(1))) % 3).alias("k"), (F.abs(F.xxhash64("id", F.lit(2))) % 5).alias("r"),
    )
    w = Window.partitionBy("task_id").orderBy("id")
    return base.select(
        "task_id", F.row_number().over(w).alias("step_index"), "action",
        F.concat_ws(":", "action", "k").alias("action_key"), (F.col("k") != 0).alias("ok"), F.col("r").cast("int").alias("rows_returned"),
        F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 40).alias("ts"),
    )


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_step_rules_do_not_depend_on_the_slices(spark):
    steps = hot_steps(spark).drop("ts")
    whole = rows(R.step_flags(steps, 10**6))
    assert rows(R.step_flags(steps, 16)) == whole
    assert rows(R.step_flags(steps.repartition(5), 64)) == whole


def test_numbering_equals_row_number(spark):
    ev = spark.read.parquet(f"{SMALL}/events.parquet").withColumn("user_id", F.when(F.col("user_id") % 3 == 0, 0).otherwise(F.col("user_id")))
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    want = ev.withColumn("n", F.row_number().over(w).cast("bigint")).select("event_id", "n")
    got = G.number_in_key(ev, "user_id", "ts", "event_id", "n").select("event_id", "n")
    assert rows(got) == rows(want)


@pytest.mark.parametrize("kind", ["spread", "one value", "two values", "heavy tail"])
def test_quantiles_are_exact(spark, kind):
    rng = np.random.default_rng(3)
    x = {
        "spread": rng.normal(0, 5, 5000), "one value": np.array([4.0]),
        "two values": np.array([1.0] * 2000 + [2.0] * 7), "heavy tail": np.exp(rng.normal(0, 6, 4000)),
    }[kind]
    df = spark.createDataFrame([(float(v),) for v in x], "x double").repartition(7)
    qs = [0.0, 0.05, 0.25, 0.5, 0.95, 1.0]
    got = {r.q: r["at"] for r in G.exact_quantiles(df, [], "x", qs).collect()}
    for q in qs:
        assert got[q] == pytest.approx(np.quantile(x, q), rel=1e-12)


@pytest.mark.parametrize("rounds", [1, 2, 3])
def test_quantiles_by_repeated_slices(spark, rounds):
    rng = np.random.default_rng(5)
    data = {"a": rng.normal(0, 5, 900), "b": np.round(np.exp(rng.normal(0, 2, 900)), 1), "c": np.array([7.0])}
    rows = [(k, float(v)) for k, xs in data.items() for v in xs]
    df = spark.createDataFrame([*rows, ("a", None), ("d", None)], "k string, x double")
    counted = df.groupBy("k", "x").agg(F.count("*").alias("n"))
    qs = [0.05, 0.5, 0.9]
    plain = G.exact_quantiles(df, ["k"], "x", qs, steps=2, rounds=rounds).collect()
    weighed = G.exact_quantiles(counted, ["k"], "x", qs, steps=2, rounds=rounds, weight="n").collect()
    for rows in (plain, weighed):
        got = {(r.k, r.q): r["at"] for r in rows}
        assert set(got) == {(k, q) for k in data for q in qs}
        for k, q in got:
            assert got[k, q] == pytest.approx(np.quantile(data[k], q), rel=1e-12)


def test_metrics_profiled_together(spark, monkeypatch):
    rng = np.random.default_rng(7)
    x, y = rng.normal(100, 5, 600), rng.integers(0, 9, 600)
    df = spark.createDataFrame(
        [(float(a), f"{b},000", "n/a") for a, b in zip(x, y)] + [(None, "", None), (float("inf"), "z", None)],
        "x double, y string, z string",
    )
    monkeypatch.setattr(T, "RANKED", 1)
    got = {r.metric: r for r in T.metric_profiles(df, ["x", "y", "z"]).collect()}
    assert set(got) == {"x", "y"}
    for name, v in (("x", x), ("y", y * 1000.0)):
        r = got[name]
        assert r["count"] == 600 and r["p90"] == pytest.approx(np.quantile(v, 0.9), abs=1e-5)
        assert (r["mean"], r["std"], r["max"]) == pytest.approx((v.mean(), v.std(), v.max()), abs=1e-5)
    assert T.metric_profiles(df.limit(0), ["x", "y"]).collect() == []


def test_identical_columns_need_equal_sets(spark):
    data = [(1, r, c, v) for r in range(4) for c, v in ((0, f"a{r}"), (1, f"a{3 - r}"), (2, f"a{min(r, 2)}"))]
    data += [(2, 0, c, "same") for c in range(2000)]
    df = spark.createDataFrame(data, "task_id int, row_idx int, col_idx int, v string")
    assert sorted((r.task_id, r["first"], r["columns"]) for r in V.equal_columns(df).collect()) == [(1, 0, 2), (2, 0, 2000)]


def test_view_names_of_many_files(spark):
    plain = spark.range(100_000).select(F.format_string("data/part_%05d.csv", "id").alias("path"))
    assert TB.unique_names(plain, "path").select("view_name").distinct().count() == 100_000
    same = spark.range(20_000).select(F.format_string("x/a%s.csv", F.repeat(F.lit("-"), F.col("id").cast("int") % 200 + 1)).alias("path"), "id")
    same = same.select(F.concat("path", F.lit("?"), F.col("id").cast("string")).alias("path"))
    names = TB.unique_names(same, "path")
    assert names.select("view_name").distinct().count() == 20_000


def test_view_names_take_the_first_free_number(spark):
    paths = ["a.csv", "a.json", "a.md", "a_2.csv", "a_2.json", "b.csv"]
    got = TB.unique_names(spark.createDataFrame([(p,) for p in paths], "path string"), "path")
    assert {r.path: r.view_name for r in got.collect()} == {
        "a.csv": "a", "a.json": "a_2", "a.md": "a_3", "a_2.csv": "a_2_2", "a_2.json": "a_2_3", "b.csv": "b",
    }


def test_plans_hold_no_cross_join_and_no_python(spark):
    found = {}
    for name, fn in QUERIES.items():
        if name.startswith("stream_"):
            continue
        plan = fn(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
        bad = [w for w in ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "InPandas") if w in plan]
        if bad:
            found[name] = bad
    assert not found


def test_filters_and_columns_reach_the_scan(spark):
    plan = QUERIES["q_text_fn"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(o_orderdate" in plan and "o_totalprice" not in plan


def feed_of(spark, steps, folder, files):
    steps.orderBy(F.rand(5)).repartition(files).write.parquet(folder)
    return spark.readStream.schema(steps.schema).option("maxFilesPerTrigger", 1).parquet(folder)


COLS = ["task_id", "step_index", "action", *R.FLAGS]


def test_stream_out_of_order_equals_batch(spark, tmp_path):
    from questloom.streaming import monitor as MO

    steps = hot_steps(spark, 600)
    twice = steps.union(steps.filter("step_index % 50 = 3"))  # some steps come again
    out = str(tmp_path / "out")
    MO.monitor(feed_of(spark, twice, str(tmp_path / "feed"), 6), out, str(tmp_path / "cp"), size=64).awaitTermination()
    assert rows(MO.flags(spark, out).select(*COLS)) == rows(R.step_flags(steps).select(*COLS))


def test_stream_waits_for_a_lost_step_until_closed(spark, tmp_path):
    from questloom.streaming import monitor as MO

    steps = hot_steps(spark, 60)
    lost = steps.filter("step_index <> 20")
    out = str(tmp_path / "out")
    feed = feed_of(spark, lost, str(tmp_path / "feed"), 3)
    MO.monitor(feed, out, str(tmp_path / "cp"), size=64).awaitTermination()
    early = MO.flags(spark, out).select(*COLS)
    assert rows(early) == rows(R.step_flags(steps).filter("step_index < 20").select(*COLS))
    MO.close(lost, out, size=64)
    assert rows(MO.flags(spark, out).select(*COLS)) == rows(R.step_flags(lost).select(*COLS))


def test_progress_counts_late_rows(spark, tmp_path):
    from questloom.streaming import progress as PR

    done = spark.range(600).selectExpr("timestamp'2024-01-01' + make_interval(0, 0, 0, cast(id / 20 AS int)) AS ts", "id % 3 > 0 AS ok")
    feed = feed_of(spark, done, str(tmp_path / "feed"), 6)
    PR.write_updates(PR.counts(feed), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = PR.latest(spark, str(tmp_path / "out")).agg(F.sum("completed"), F.count("*"), F.sum("succeeded")).first()
    assert tuple(got) == (600, 30, 400)


def test_evidence_of_short_lines_is_cut_with_a_note(spark):
    parts = spark.range(1000).selectExpr("1 AS task_id", "id + 1 AS step_index", "0 AS part_no", "'ab' AS part")
    text = R.evidence_summary(parts, "part", max_chars=1500, size=64).first()["summary"]
    whole = "\n".join(["ab"] * 1000)
    assert text == whole[:1500] + f"\n... <{len(whole) - 1500} more chars truncated>"
    assert R.evidence_summary(parts, "part", max_chars=None).first()["summary"] == whole


def test_cases_of_the_first_verdict(spark):
    from questloom.operators import answers as A
    from questloom.operators import patterns as P
    from questloom.operators import profile as PF
    from questloom.sources import files as S

    docs = spark.createDataFrame([('{"AVOID":1,"VARIANT_ID":"x","a b: VOID":null,"n":[{"OBJECT":[]}]}',)], "v string")
    doc = S.parse_json(docs, "v").select("doc.*")
    assert doc.columns == ["AVOID", "VARIANT_ID", "a b: VOID", "n"] and doc.first()["VARIANT_ID"] == "x"
    text_dates = spark.createDataFrame([("201305",), ("201201",), ("2013-07-01",)], "d string")
    assert text_dates.filter(P.in_year(text_dates, "d", 2013)).count() == 2
    days = text_dates.selectExpr("to_date(left(d, 4), 'yyyy') AS d")
    assert days.filter(P.in_year(days, "d", 2013)).count() == 2
    runs = spark.createDataFrame([("task_2", True, None, 4), ("task_1", False, "abc", 1), ("task_9", False, "abc", 1)], "task_id string, succeeded boolean, failure_reason string, total_steps int")
    assert tuple(R.case_pick(runs).first()) == ("task_2", "task_1")
    cells = spark.createDataFrame([(1, 0, 0, "b"), (1, 0, 0, "a"), (1, 0, 1, "c")], "task_id int, row_idx int, col_idx int, v string")
    assert [r.v for r in A.normalise_cells(cells).orderBy("col_idx").collect()] == ["a", "c"]
    deep = "1"
    for i in range(7):
        deep = f'{{"k{i}":{deep}}}'
    wide = "{" + ",".join(f'"p{i}":1' for i in range(60)) + "}"
    both = spark.createDataFrame([(deep,), (wide,)], "v string")
    paths = {r.path for r in PF.json_key_paths(both, "v").collect()}
    assert "$.k6.k5.k4.k3.k2.k1.k0" in paths and all(f"$.p{i}" in paths for i in range(60))
    heads = spark.createDataFrame([(1, "\n".join(f"# h{i}" for i in range(25)))], "doc_id int, text string")
    assert PF.doc_headings(heads, "doc_id", "text").count() == 25
    assert PF.doc_headings(heads, "doc_id", "text", limit=20).count() == 20
