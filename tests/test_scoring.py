from pyspark.sql import functions as F

from questloom.operators import evaluate as E
from questloom.operators import traces as R
from questloom.rules import traces as X


def cells(spark, gold, pred, task="t"):
    rows = []
    for side, table in (("gold", gold), ("pred", pred)):
        for r, row in enumerate(table):
            rows += [(task, side, r, c, v) for c, v in enumerate(row)]
    return spark.createDataFrame(rows, "task_id string, side string, row_idx int, col_idx int, v string")


def score(spark, gold, pred):
    c = cells(spark, gold, pred)
    m = E.greedy_match(E.jaccard_pairs(E.value_sets(c)))
    return E.scores(m, E.distinct_columns(c)).first()


def test_equal_answer_scores_one(spark):
    r = score(spark, [["1", "a"], ["2", "b"]], [[" b", "2.0"], ["a ", "1.00"]])
    assert (r.score, r.matched_columns, r.redundant_columns) == (1.0, 2, 0)


def test_missing_answer_scores_zero(spark):
    assert score(spark, [["1"]], []).score == 0.0


def test_extra_column_costs_a_twentieth(spark):
    r = score(spark, [["1"], ["2"]], [["1", "x"], ["2", "y"]])
    assert abs(r.score - 0.95) < 1e-9


def test_greedy_ties_follow_gold_then_predicted_order(spark):
    c = cells(spark, [["1", "1"]], [["1", "1"]])
    got = E.greedy_match(E.jaccard_pairs(E.value_sets(c))).orderBy("g").collect()
    assert [(r.g, r.p, r.similarity) for r in got] == [(0, 0, 1.0), (1, 1, 1.0)]


def test_header_in_the_sets_is_an_option(spark):
    c = cells(spark, [["1"]], [["2"]])
    heads = spark.createDataFrame(
        [("t", "gold", 0, "n"), ("t", "pred", 0, "n")], "task_id string, side string, col_idx int, v string"
    )
    assert E.jaccard_pairs(E.value_sets(c)).count() == 0
    assert E.jaccard_pairs(E.value_sets(c, heads)).first().shared == 1


def test_columns_empty_on_both_sides_match(spark):
    c = cells(spark, [["1"]], [["1"]])
    cols = spark.createDataFrame(
        [("t", "gold", 0), ("t", "gold", 1), ("t", "pred", 0), ("t", "pred", 1)], "task_id string, side string, col_idx int"
    )
    got = E.jaccard_pairs(E.value_sets(c), cols).orderBy("g").collect()
    assert [(r.g, r.p, r.similarity) for r in got] == [(0, 0, 1.0), (1, 1, 1.0)]


def select(spark, original, retry, triggers):
    sig, att = [], []
    for name, (signals, present, rows) in (("original", original), ("retry", retry)):
        sig += [("t", name, c, s) for c, s in signals]
        att.append(("t", name, present, rows, ["a"]))
    s = spark.createDataFrame(sig or [("x", "original", "none", "info")], "task_id string, attempt string, code string, severity string")
    a = spark.createDataFrame(att, "task_id string, attempt string, answer_present boolean, data_row_count int, columns array<string>")
    t = spark.createDataFrame([("t", triggers)], "task_id string, trigger_codes array<string>")
    return R.attempt_select(R.attempt_penalty(s, a), t).first()


def test_more_rows_alone_do_not_win(spark):
    risk = [("denominator_risk", "warning")]
    got = select(spark, (risk, True, 57), (risk, True, 88), ["denominator_risk"])
    assert got.selected == "original" and "more rows" in got.rationale


def test_fewer_hard_errors_win(spark):
    got = select(spark, ([("no_grounded_answer", "error")], False, 0), ([], True, 3), ["no_grounded_answer"])
    assert got.selected == "retry"


def test_no_improvement_keeps_original(spark):
    risk = [("rank_semantics_risk", "warning")]
    assert select(spark, (risk, True, 3), (risk, True, 3), ["rank_semantics_risk"]).selected == "original"


def test_retry_codes_are_known():
    assert set(X.SEMANTIC_CODES) < set(X.RETRY_CODES)


def test_evidence_text_is_cut_at_the_limit(spark):
    rows = [("t", i, 0, f"[a] {i}") for i in range(900)]
    df = spark.createDataFrame(rows, "task_id string, step_index int, part_no int, part string")
    whole = "\n".join(r[3] for r in rows)
    want = whole[:1500] + f"\n... <{len(whole) - 1500} more chars truncated>"
    assert R.evidence_summary(df, "part").first().summary == want
    assert F is not None


def test_greedy_match_of_many_columns(spark):
    import random

    rnd = random.Random(6)
    pairs = [(1, g, p, rnd.randint(1, 9) / 10) for g in range(120) for p in range(120) if rnd.random() < 0.4]
    left, right, want = set(), set(), set()
    for s, g, p in sorted((-s, g, p) for _, g, p, s in pairs):
        if g not in left and p not in right:
            left.add(g)
            right.add(p)
            want.add((g, p, -s))
    df = spark.createDataFrame(pairs, "task_id int, g int, p int, similarity double")
    for rounds in (1, 3):
        assert {(r.g, r.p, r.similarity) for r in E.greedy_match(df, rounds).collect()} == want


def by_hand(cells):
    """The greedy choice over all pairs, in plain Python."""
    sets = {}
    for task, side, c, v in cells:
        sets.setdefault((task, side), {}).setdefault(c, set()).add(v)
    out = set()
    for task in {t for t, _ in sets}:
        gold, pred = sets.get((task, "gold"), {}), sets.get((task, "pred"), {})
        pairs = sorted((-len(a & b) / len(a | b), g, p) for g, a in gold.items() for p, b in pred.items() if a & b)
        left, right = set(), set()
        for s, g, p in pairs:
            if g not in left and p not in right:
                left.add(g)
                right.add(p)
                out.add((task, g, p, round(-s, 9)))
    return out


def matched(spark, cells, wide):
    df = spark.createDataFrame(sorted(set(cells)), "task_id int, side string, col_idx int, v string")
    return {(r.task_id, r.g, r.p, round(r.similarity, 9)) for r in E.match_columns(df, wide).collect()}


def test_match_columns_equals_the_greedy_choice(spark):
    import random

    rnd = random.Random(8)
    cells = []
    for task in range(3):
        for side in ("gold", "pred"):
            for c in range(16):
                for v in ("", "0", "y"):  # common values, in different sets
                    if rnd.random() < (0.9, 0.5, 0.2)[task % 3]:
                        cells.append((task, side, c, v))
                cells += [(task, side, c, f"v{rnd.randint(0, 80)}") for _ in range(rnd.randint(0, 4))]
    want = by_hand(cells)
    assert matched(spark, cells, 1) == want  # many common values
    assert matched(spark, cells, 10**6) == want  # none


def test_a_thousand_columns_share_a_blank(spark):
    cells = []
    for side in ("gold", "pred"):
        for c in range(1000):
            cells.append((1, side, c, ""))
            cells += [(1, side, c, f"{side}{c}-{i}") for i in range(c % 7)]
            if c % 10 == 0:
                cells.append((1, side, c, f"same{c}"))
    df = spark.createDataFrame(cells, "task_id int, side string, col_idx int, v string")
    got = {(r.task_id, r.g, r.p, round(r.similarity, 9)) for r in E.match_columns(df).collect()}
    assert len(got) == 1000 and got == by_hand(cells)
