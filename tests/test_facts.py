"""Answer and trace facts: one pass over cells and steps for all checks."""

import re

from pyspark.sql import functions as F

from questloom.operators import answers as A
from questloom.operators import traces as R
from questloom.operators import verify as V
from questloom.sources.files import catalogue

REPORT = "task_id long, check string, passed boolean, detail string"
CONTRACTS = "task_id long, expected_columns array<string>, expected_column_count long, min_rows long, max_rows long, exact_columns boolean"
WORDING = "task_id long, question string, aggregation string, requested_fields array<string>, risk_codes array<string>"
TASKS = "task_id long, failure_reason string, answer_present boolean, budget_exhausted boolean, intents array<string>"


def exchanges(df) -> int:
    return len(re.findall(r"\bExchange ", df._jdf.queryExecution().executedPlan().toString()))


def inputs(spark):
    cells = spark.createDataFrame(
        [(1, r, c, v) for r in range(3) for c, v in enumerate(["x", "5%"])] + [(2, 0, 0, " "), (4, 0, 0, None)],
        "task_id long, row_idx long, col_idx int, v string",
    )
    headers = spark.createDataFrame(
        [(1, 0, "Name"), (1, 1, "Share"), (2, 0, "Name"), (3, 0, None)], "task_id long, col_idx int, name string"
    )
    readable = spark.createDataFrame([(i, "readability_check", i != 5, "d") for i in (1, 2, 3, 5)], REPORT)
    contracts = spark.createDataFrame([(1, ["name", "share"], 2, None, 2, True)], CONTRACTS)
    wording = spark.createDataFrame(
        [(1, "What percentage of x?", None, [], ["denominator_risk"]), (9, "Rank it", None, [], ["rank_semantics_risk"])], WORDING
    )
    steps = spark.createDataFrame([(1, 1, "numerator"), (1, 2, "denominator")], "task_id long, step_index int, text string")
    return cells, headers, readable, contracts, wording, V.trace_evidence(steps, F.col("text"))


def test_gather_keeps_every_task_once(spark):
    a = spark.createDataFrame([(1, "p"), (2, None), (2, "q")], "task_id long, x string")
    b = spark.createDataFrame([(2, [1]), (3, None)], "task_id long, x array<int>")
    got = {r.task_id: (r.has_a, r.has_b, r.a.x, r.b.x) for r in V.gather(a=a, b=b).collect()}
    assert got == {1: (True, False, "p", None), 2: (True, True, "q", [1]), 3: (False, True, None, None)}


def test_gather_of_nothing(spark):
    empty = spark.createDataFrame([], "task_id long, x string")
    assert V.gather(a=empty, b=empty).collect() == []


def test_unread_facts_are_pruned(spark):
    cells, headers, readable, *_ = inputs(spark)
    tasks = readable.select("task_id")
    plan = V.shape_check(tasks, headers, cells)._jdf.queryExecution().optimizedPlan().toString()
    assert "sha2" not in plan and "RLIKE" not in plan


def test_checks_and_risks_of_a_review(spark):
    cells, headers, readable, contracts, wording, evidence = inputs(spark)
    seen = V.review(readable, headers, cells, contracts, wording, "question", evidence)
    got = {r.task_id: r for r in seen.collect()}
    assert [(c.check, c.detail) for c in got[1].checks if not c.passed] == [("task_contract_check", "too many rows")]
    assert [c.detail for c in got[5].checks] == ["d"]
    assert [c.detail for c in got[2].checks if not c.passed] == ["too many empty rows", "single empty cell"]
    assert [c.detail for c in got[3].checks if not c.passed] == ["header has no names", "no data rows"]
    assert got[4].checks is None and got[9].checks is None
    assert [(r.code, r.severity) for r in got[1].risks] == [("denominator_risk", "info"), ("scalar_format_semantic_risk", "warning")]
    assert got[3].risks is None and [r.code for r in got[9].risks] == ["rank_semantics_risk"]
    assert (got[1].filled_cells, got[1].numeric_cells, got[4].filled_cells) == (6, 0, 0)


def test_signals_take_counts_of_the_review_or_their_own(spark):
    cells, headers, readable, contracts, wording, evidence = inputs(spark)
    seen = V.review(readable, headers, cells, contracts, wording, "question", evidence)
    own = spark.createDataFrame([(1, "", True, False, ["ratio", "count", "average"]), (7, None, True, False, []), (8, "Timeout", False, True, None)], TASKS)
    intents = F.array(*[F.lit(i) for i in R.R.NUMERIC_INTENTS])
    got = {}
    for r in R.failure_signals(own.withColumn("intents", F.when(F.col("task_id") == 1, intents).otherwise(F.col("intents"))), seen).collect():
        got.setdefault(r.task_id, set()).add((r.code, r.source, r.severity))
    assert ("numeric_grounding_error", 4, "warning") in got[1]
    assert got[7] == {("passed_no_obvious_risk", 9, "info")}
    assert {c for c, *_ in got[8]} == {"runtime_timeout", "no_grounded_answer", "budget_exhaustion"}
    told = own.withColumn("intents", intents).withColumn("filled_cells", F.lit(2)).withColumn("numeric_cells", F.lit(1))
    codes = {r.code for r in R.failure_signals(told, seen).filter("task_id = 1").collect()}
    assert "numeric_grounding_error" not in codes


def test_one_shuffle_of_cells_and_one_of_steps(spark):
    cells, headers, readable, contracts, wording, evidence = inputs(spark)
    seen = V.review(readable, headers, cells, contracts, wording, "question", evidence)
    tree = seen._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in tree
    # Cells by row, rows by mark, rows by task; headers; steps; the meeting of all parts.
    assert exchanges(seen) == 6


def test_readable_files_and_lines(spark, tmp_path):
    for name, data in {"a": b"x,1\ny", "b": b"", "c": b"ok\n\xff\xfe"}.items():
        (tmp_path / name).write_bytes(data)
    expected = spark.createDataFrame([(n,) for n in "abcd"], "answer string")
    want = {"a": "readable", "b": "empty", "c": "not UTF-8", "d": "missing"}
    files = V.readability(spark, str(tmp_path), expected, "answer").collect()
    assert {r.answer: r.detail for r in files} == want and [r.answer for r in files if r.passed] == ["a"]
    lines = spark.read.text(str(tmp_path)).select(F.element_at(F.split("_metadata.file_path", "/"), -1).alias("answer"), "value")
    empty = spark.createDataFrame([("b", "")], "answer string, value string")
    got = V.line_readability(lines.unionByName(empty), expected, "answer", "value").collect()
    assert {r.answer: r.detail for r in got} == want


def test_long_answers_meet_their_figures_by_slices(spark):
    n = 3 * A.SLICE
    rows = spark.range(0, n, A.SLICE // 2).select(F.lit(1).alias("task_id"), F.col("id").alias("row_idx"))
    cells = rows.select("*", F.lit(0).alias("col_idx"), F.lit(" null ").alias("v")).unionByName(
        spark.createDataFrame([(1, n - 1, 2, "x"), (2, 0, 0, "y"), (1, -1, 0, "h"), (1, -1, 1, "h")], "task_id int, row_idx long, col_idx int, v string")
    )
    got = A.normalise_cells(cells)
    assert got.filter("task_id = 1").count() == 3 * 8 and got.filter("task_id = 2").collect()[0].v == "y"
    assert got.filter("task_id = 1 and row_idx = 0").select("v").distinct().collect()[0].v == ""
    named = cells.withColumn("col_name", F.concat(F.lit(" C"), "col_idx"))
    keep = spark.createDataFrame([(1, "c2"), (2, "c9")], "task_id int, keep_column string")
    kept = A.prune_to_column(named, keep)
    assert kept.columns == named.columns
    assert sorted((r.task_id, r.v) for r in kept.collect()) == [(1, "x"), (2, "y")]
    shape = {r.task_id: (r.width, r.rows, r.bad_rows, r.ok) for r in A.shape_check(cells).collect()}
    assert shape == {1: (2, 7, 7, False), 2: (1, 1, 0, True)}


def test_catalogue_lists_empty_files_and_odd_names(spark, tmp_path):
    (tmp_path / "sub dir").mkdir()
    for name, data in {"a b+c%d.csv": b"x", "none.json": b"", "sub dir/\u00e9.txt": b"yy"}.items():
        (tmp_path / name).write_bytes(data)
    got = {r.path: (r.size, r.kind) for r in catalogue(spark, str(tmp_path)).collect()}
    assert {p: s for p, (s, _) in got.items()} == {"a b+c%d.csv": 1, "none.json": 0, "sub dir/\u00e9.txt": 2}
    (tmp_path / "nothing").mkdir()
    assert catalogue(spark, str(tmp_path / "nothing")).count() == 0
