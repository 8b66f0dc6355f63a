"""Analyse execution traces: usage, loops, audits, failure signals, attempts.

Steps are rows ``(task_id, step_index, action, action_key, ok, rows_returned, …)`` with a
dense ``step_index`` from 1. Rules about "the last few steps" run on slices of a task
with a short overlap, so a task with very many steps spreads over many tasks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from questloom.functions.groups import first_per_group, step_slices
from questloom.functions.values import any_contains
from questloom.operators.verify import gather
from questloom.rules import traces as R
from questloom.rules import wording as W

# How far the step rules look back.
REPEAT_WINDOW = 5
SCOUT_WINDOW = 6
RUN = 3


def tool_usage(steps: DataFrame) -> DataFrame:
    return steps.groupBy("task_id", "action").agg(
        F.count(F.lit(1)).alias("calls"), F.avg(F.col("ok").cast("double")).alias("success_rate")
    )


FLAGS = ("repeated", "error_run", "scout_excess", "empty_sql_run", "profile_missing")


def judged(sliced: DataFrame) -> DataFrame:
    """Loop and scouting rules for every row of step slices, all on one window.

    ``repeated``: the same call at least twice in the previous 5 steps; ``error_run``: the
    third error in a row or later; ``scout_excess``: a search or read after 4 or more
    scouting and no computing steps among the previous 6; ``empty_sql_run``: SQL after 3
    SQL steps with at most 2 rows; ``profile_missing``: no profiling by step 2.
    """
    w = Window.partitionBy("task_id", "_part").orderBy("step_index")
    before = w.rowsBetween(-REPEAT_WINDOW, -1)
    scout = w.rowsBetween(-SCOUT_WINDOW, -1)
    run, prior = w.rowsBetween(-(RUN - 1), 0), w.rowsBetween(-RUN, -1)

    def n(cond: Column, over) -> Column:
        return F.coalesce(F.sum(cond.cast("int")).over(over), F.lit(0))

    action = F.col("action")
    empty_sql = action.isin(*R.SQL_ACTIONS) & F.coalesce(F.col("rows_returned") <= 2, F.lit(False))
    out = (
        sliced.withColumn("_prev", F.collect_list("action_key").over(before))
        .withColumn("_scout", n(action.isin(*R.SCOUT), scout))
        .withColumn("_compute", n(action.isin(*R.COMPUTE), scout))
        .withColumn("_errors", n(~F.col("ok"), run))
        .withColumn("_empty", n(empty_sql, prior))
        .withColumn("_profiled", n(action == R.PROFILE, w.rowsBetween(-2, -1)))
    )
    key = F.col("action_key")
    repeat = F.size(F.filter("_prev", lambda k: k == key))
    return out.select(
        *sliced.columns, repeat.alias("repeat_count"),
        ((repeat >= 2) & (action != "answer")).alias("repeated"),
        (F.col("_errors") >= RUN).alias("error_run"),
        (action.isin("search_doc", "read_doc") & (F.col("_scout") >= 4) & (F.col("_compute") == 0)).alias("scout_excess"),
        (action.isin(*R.SQL_ACTIONS) & (F.col("_empty") >= RUN)).alias("empty_sql_run"),
        ((F.col("step_index") <= 2) & (F.col("_profiled") == 0) & (action != R.PROFILE)).alias("profile_missing"),
    )


def step_flags(steps: DataFrame, size: int = 512) -> DataFrame:
    """The rules of ``judged`` for every step of finished traces: one shuffle."""
    sliced = step_slices(steps, "step_index", max(REPEAT_WINDOW, SCOUT_WINDOW), size)
    return judged(sliced).filter("_own").select(*steps.columns, "repeat_count", *FLAGS)


def low_budget(steps: DataFrame, max_steps: int, light_tasks: DataFrame | None = None) -> DataFrame:
    """Scouting with at most 3 steps left; profiling counts only when already done."""
    first = steps.filter(F.col("action") == R.PROFILE).groupBy("task_id").agg(
        F.min("step_index").alias("_first")
    )
    left = F.lit(max_steps) - F.col("step_index")
    late = steps.filter(left.between(1, 3) & F.col("action").isin(*R.SCOUT))
    if light_tasks is not None:
        late = late.join(light_tasks.select("task_id"), "task_id", "left_anti")
    used = F.coalesce(F.col("_first") < F.col("step_index"), F.lit(False))
    return late.join(first, "task_id", "left").filter((F.col("action") != R.PROFILE) | used).select(
        *steps.columns, left.alias("steps_left")
    )


def failure_category(runs: DataFrame, steps: DataFrame) -> DataFrame:
    bad = steps.groupBy("task_id").agg(
        F.max(~F.col("ok")).alias("_bad"), F.count(F.lit(1)).alias("total_steps")
    )
    reason = F.coalesce("failure_reason", F.lit(""))
    kind = (
        F.when(F.col("succeeded"), F.lit("none"))
        .when(F.lower(reason).contains("timed out"), F.lit("timeout"))
        .when(reason.contains("max_steps"), F.lit("exceeded_max_steps"))
        .when(F.coalesce("_bad", F.lit(False)), F.lit("tool_error")).otherwise(F.lit("no_answer"))
    )
    return runs.join(bad, "task_id", "left").select(
        *runs.columns, F.coalesce("total_steps", F.lit(0)).alias("total_steps"),
        kind.alias("failure_category"),
    )


def run_summary(categories: DataFrame, steps: DataFrame, tools: int = 5) -> DataFrame:
    """Run figures, the most used tools and the failure categories as (kind, name, value)."""
    total = categories.agg(
        F.count(F.lit(1)).alias("n"), F.count_if("succeeded").alias("ok"),
        F.avg("total_steps").alias("steps"), F.avg("elapsed_seconds").alias("secs"),
    )
    figures = total.select(
        F.expr(
            "stack(6, 'task_count', cast(n as double), 'succeeded_count', cast(ok as double),"
            " 'failed_count', cast(n - ok as double), 'success_rate', round(try_divide(ok, n), 3),"
            " 'avg_steps_per_task', round(steps, 1), 'avg_elapsed_seconds', round(secs, 1))"
            " AS (name, value)"
        )
    ).select(F.lit("figure").alias("kind"), "name", "value")
    used = (
        steps.groupBy(F.col("action").alias("name")).agg(F.count(F.lit(1)).cast("double").alias("value"))
        .orderBy(F.desc("value"), "name").limit(tools).select(F.lit("tool").alias("kind"), "name", "value")
    )
    failed = (
        categories.filter(~F.col("succeeded")).groupBy(F.col("failure_category").alias("name"))
        .agg(F.count(F.lit(1)).cast("double").alias("value")).select(F.lit("failure").alias("kind"), "name", "value")
    )
    return figures.unionByName(used).unionByName(failed)


def case_pick(categories: DataFrame) -> DataFrame:
    """The success with the fewest steps and the failure with the longest reason."""
    ok = F.col("succeeded")
    size = F.length(F.coalesce("failure_reason", F.lit("")))
    return categories.agg(
        F.min(F.when(ok, F.struct("total_steps", "task_id")))["task_id"].alias("best_task"),
        F.min(F.when(~ok, F.struct((-size).alias("s"), "task_id")))["task_id"].alias("worst_task"),
    )


def audit_evidence(steps: DataFrame, text: str) -> DataFrame:
    """Which kinds of evidence and tools a task's trace holds; texts are never joined."""
    low = F.lower(F.coalesce(text, F.lit("")))
    action = F.col("action")
    return steps.groupBy("task_id").agg(
        *[F.max(any_contains(low, t)).alias(f"e_{n}") for n, t in R.AUDIT_EVIDENCE],
        F.max(action.isin(*R.COMPUTE)).alias("used_compute"),
        F.max(action.isin(*R.STRUCTURED)).alias("used_structured"),
        F.max(action == "ground_thresholds").alias("used_ground"),
        F.max("step_index").alias("last_step"),
    )


def placeholder_answers(cells: DataFrame) -> DataFrame:
    """Answers whose filled cells are all placeholders; header cells are given as cells."""
    s = F.lower(F.trim(F.coalesce("v", F.lit(""))))
    return cells.groupBy("task_id").agg(
        F.count_if(s != "").alias("_f"), F.count_if((s != "") & s.isin(*R.PLACEHOLDERS)).alias("_p")
    ).select("task_id", (F.col("_f") == F.col("_p")).alias("placeholder"))


def answer_audit(
    tasks: DataFrame, evidence: DataFrame, placeholders: DataFrame, max_steps: int
) -> DataFrame:
    """First rule an answer breaks, or ``allow``.

    ``tasks``: task_id, question, difficulty, has_table, has_doc.
    """
    df = tasks.join(evidence, "task_id", "left").join(placeholders, "task_id", "left")
    no = F.lit(False)
    q = F.col("question")

    def e(name: str) -> Column:
        return F.coalesce(F.col(f"e_{name}"), no)

    table = F.col("has_table")
    light = F.lower("difficulty").isin("easy", "medium") & table & ~F.col("has_doc")
    compute, structured = F.coalesce("used_compute", no), F.coalesce("used_structured", no)
    left = F.greatest(F.lit(max_steps) - F.coalesce("last_step", F.lit(0)) - 1, F.lit(0))
    rules = [
        ("placeholder_answer_blocked", F.coalesce("placeholder", F.lit(True))),
        ("allow", left == 0),
        ("tabular_answer_without_evidence", table & ~structured),
        ("numeric_answer_without_computation", q.rlike(R.NUMERIC) & table & ~compute),
        ("denominator_evidence_missing", ~light & q.rlike(W.RATIO) & ~(e("numerator") & e("denominator"))),
        ("average_monthly_candidates_missing", ~light & q.rlike(W.AVERAGE_MONTHLY) & ~(e("avg") & e("sum") & e("candidates"))),
        ("rank_field_evidence_missing", q.rlike(R.RANKED) & e("position") & ~e("rank")),
        ("threshold_evidence_missing", ~light & q.rlike(W.THRESHOLD) & ~F.coalesce("used_ground", no) & ~e("threshold")),
        ("count_target_evidence_missing", ~light & q.rlike(W.COUNT) & e("count_star") & ~e("distinct") & e("many")),
    ]
    code = F.lit("allow")
    for name, cond in reversed(rules):
        code = F.when(cond, F.lit(name)).otherwise(code)
    return df.select("task_id", code.alias("code"))


def error_classes(df: DataFrame, error: str) -> DataFrame:
    low = F.lower(error)
    hit = F.coalesce(
        *[
            F.when(low.contains(k), F.struct(F.lit(n).alias("pattern"), F.lit("medium").alias("severity"), F.lit(h).alias("hint")))
            for n, k, h in R.ERROR_CLASSES
        ],
        F.struct(F.lit("unknown").alias("pattern"), F.lit("high").alias("severity"), F.lit(R.UNKNOWN_ERROR).alias("hint")),
    )
    return df.withColumn("_h", hit).select(*df.columns, "_h.pattern", "_h.severity", "_h.hint")


OWN = ("failure_reason", "answer_present", "budget_exhausted", "intents", "filled_cells", "numeric_cells")


def failure_signals(tasks: DataFrame, review: DataFrame) -> DataFrame:
    """One row per task and signal code; the earlier source wins.

    ``tasks``: task_id, failure_reason, answer_present, budget_exhausted, intents and, where
    the counts of the review shall not be used, filled_cells and numeric_cells. ``review``
    holds the checks, risks and cell counts of a task in one row, so its signals are
    judged inside that row.
    """
    codes = F.create_map(*[F.lit(x) for pair in R.CHECK_CODES for x in pair])
    given = [c for c in OWN if c in tasks.columns]
    df = gather(own=tasks.select("task_id", *given), seen=review.select("task_id", "checks", "risks", "filled_cells", "numeric_cells"))

    def own(name: str) -> Column:
        return F.col(f"own.{name}") if name in given else F.coalesce(F.col(f"seen.{name}"), F.lit(0))

    def signal(source: Column, code: Column, severity: Column) -> Column:
        return F.struct(source.cast("int").alias("source"), severity.alias("severity"), code.alias("code"))

    def one(source: int, code: Column | str, severity: str, cond: Column) -> Column:
        return F.when(cond, signal(F.lit(source), F.lit(code) if isinstance(code, str) else code, F.lit(severity)))

    failed = F.transform(
        F.filter("seen.checks", lambda c: ~c["passed"]),
        lambda c: signal(F.lit(0), F.coalesce(F.try_element_at(codes, c["check"]), F.lit("verification_error")), F.lit("error")),
    )
    reason = F.lower(F.trim(F.coalesce(own("failure_reason"), F.lit(""))))
    why = (
        F.when(reason.contains("timeout"), F.lit("runtime_timeout"))
        .when(reason.contains("max_steps"), F.lit("budget_exhaustion"))
        .when(reason != "", F.lit("runner_failure"))
    )
    numeric = F.arrays_overlap(own("intents"), F.array(*[F.lit(i) for i in R.NUMERIC_INTENTS]))
    told = F.array_compact(
        F.array(
            one(1, why, "error", why.isNotNull()), one(2, "no_grounded_answer", "error", ~own("answer_present")),
            one(3, "budget_exhaustion", "warning", own("budget_exhausted")),
            one(4, "numeric_grounding_error", "warning", numeric & (own("filled_cells") > 0) & (own("numeric_cells") == 0)),
        )
    )
    numbered = F.transform("seen.risks", lambda r, i: signal(i + 10, r["code"], r["severity"]))
    risks = F.filter(numbered, lambda r: ~(r["code"].isin(*R.INFO_ONLY) & (r["severity"] == "info")))
    none = F.expr("cast(array() as array<struct<source: int, severity: string, code: string>>)")
    every = F.array_sort(F.concat(F.coalesce(failed, none), F.coalesce(told, none), F.coalesce(risks, none)))
    named = df.select("task_id", "has_own", every.alias("_all")).withColumn("_codes", F.transform("_all", lambda s: s["code"]))
    first = F.filter("_all", lambda s, i: F.array_position("_codes", s["code"]) == i + 1)
    quiet = (F.size("_all") == 0) & F.col("has_own")
    closing = F.array(signal(F.lit(9), F.lit("passed_no_obvious_risk"), F.lit("info")))
    return named.select("task_id", F.inline(F.when(quiet, closing).otherwise(first))).select(
        "task_id", "code", "source", "severity"
    )


def signal_notes(signals: DataFrame) -> DataFrame:
    """Advice notes per task, each once; one default note when no code has advice."""
    notes = F.create_map(*[F.lit(x) for pair in R.NOTES for x in pair])
    found = signals.select("task_id", F.try_element_at(notes, F.col("code")).alias("note"))
    per_task = found.groupBy("task_id", "note").agg(F.lit(1).alias("_o"))
    named = per_task.filter(F.col("note").isNotNull()).select("task_id", "note")
    rest = (
        signals.select("task_id").distinct().join(named.select("task_id").distinct(), "task_id", "left_anti")
        .select("task_id", F.lit(R.NO_NOTE).alias("note"))
    )
    return named.unionByName(rest)


def failure_taxonomy(signals: DataFrame, routes: DataFrame, top: int = 20) -> DataFrame:
    """Counts by code, severity and route, the top notes, as (kind, name, n)."""
    sets = (
        signals.groupingSets([["code"], ["severity"]], "code", "severity")
        .agg(F.count(F.lit(1)).alias("n"), F.grouping("code").alias("g"))
        .select(
            F.when(F.col("g") == 0, F.lit("signal")).otherwise(F.lit("severity")).alias("kind"),
            F.coalesce("code", "severity").alias("name"), "n",
        )
    )
    by_route = routes.groupBy(F.coalesce("route", F.lit("unknown")).alias("name")).agg(
        F.count(F.lit(1)).alias("n")
    ).select(F.lit("route").alias("kind"), "name", "n")
    notes = (
        signal_notes(signals).groupBy(F.col("note").alias("name")).agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), "name").limit(top).select(F.lit("note").alias("kind"), "name", "n")
    )
    return reduce(DataFrame.unionByName, [sets, by_route, notes])


def tasks_by_signal(signals: DataFrame) -> DataFrame:
    """Distinct tasks per code, as rows: a code may cover most tasks."""
    return signals.select("code", "task_id").distinct()


def retry_triggers(signals: DataFrame, steps: DataFrame, last: int = 6) -> DataFrame:
    """Trigger codes per task and whether a retry is worth it.

    A task whose last actions are all the same search or read is stuck.
    """
    code, sev = F.col("code"), F.col("severity")
    hit = signals.filter(code.isin(*R.RETRY_CODES) & ~(code.isin(*R.SEMANTIC_CODES) & (sev == "info")))
    # At most one entry per trigger code.
    per_task = hit.groupBy("task_id", "code").agg(F.min("source").alias("source")).groupBy("task_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("source", "code"))), lambda x: x["code"]).alias("trigger_codes")
    )
    recent = first_per_group(steps, ["task_id"], [F.col("step_index").desc()], last)
    stuck = recent.groupBy("task_id").agg(
        reduce(
            lambda a, b: a | b, [F.bool_and(F.col("action") == a) for a in R.STUCK_ACTIONS]
        ).alias("stuck")
    )
    return per_task.join(stuck, "task_id", "left").select(
        "task_id", "trigger_codes", (~F.coalesce("stuck", F.lit(False))).alias("should_retry")
    )


def attempt_penalty(signals: DataFrame, attempts: DataFrame) -> DataFrame:
    """Penalty struct per (task, attempt); lower is better.

    ``signals`` and ``attempts`` are keyed by task_id and attempt; ``attempts`` has
    answer_present, data_row_count and columns (lower-case header array).
    """
    code = F.col("code")
    warnings = signals.groupBy("task_id", "attempt").agg(
        F.count_if(F.col("severity") == "warning").alias("warnings")
    )
    codes = signals.select("task_id", "attempt", "code").distinct().groupBy("task_id", "attempt").agg(
        F.count_if(code.isin(*R.HARD_CODES)).alias("hard_errors"),
        F.count_if(code.isin(*R.SEMANTIC_CODES)).alias("semantic_risks"),
        F.max(code.isin("no_grounded_answer", "output_shape_error")).alias("_bad"),
    )
    zero = F.lit(0)
    df = attempts.join(codes, ["task_id", "attempt"], "left").join(warnings, ["task_id", "attempt"], "left")
    present = F.coalesce("answer_present", F.lit(False))
    rows = F.coalesce("data_row_count", zero)
    default = (F.col("columns") == F.array(F.lit("answer"))) & (rows <= 1)
    bad = F.coalesce(default, F.lit(False)).cast("int") + F.coalesce("_bad", F.lit(False)).cast("int")
    return df.select(
        "task_id", "attempt", present.alias("answer_present"), rows.alias("data_row_count"),
        F.struct(
            (~present).cast("bigint").alias("no_answer"), F.coalesce("hard_errors", zero).alias("hard_errors"),
            F.coalesce("warnings", zero).alias("warnings"), F.coalesce("semantic_risks", zero).alias("semantic_risks"),
            bad.cast("bigint").alias("suspicious"), (present & (rows == 0)).cast("bigint").alias("no_rows"),
        ).alias("penalty"),
    )


def attempt_select(penalties: DataFrame, triggers: DataFrame) -> DataFrame:
    """Original or retry per task. Structs compare field by field, first field first."""
    o = penalties.filter(F.col("attempt") == "original").select(
        "task_id", F.col("penalty").alias("o"), F.col("data_row_count").alias("o_rows")
    )
    r = penalties.filter(F.col("attempt") == "retry").select(
        "task_id", F.col("penalty").alias("r"), F.col("data_row_count").alias("r_rows"),
        F.col("answer_present").alias("r_answer"),
    )
    df = o.join(r, "task_id").join(triggers.select("task_id", "trigger_codes"), "task_id", "left")
    same = F.lit(True)
    for f in ("hard_errors", "warnings", "semantic_risks"):
        same = same & (F.col(f"o.{f}") == F.col(f"r.{f}"))
    inflated = (
        (F.col("o_rows") > 0) & (F.col("r_rows") > F.col("o_rows")) & same
        & (F.col("r_rows") > F.floor(F.col("o_rows") * 1.25)) & (F.col("r_rows") - F.col("o_rows") > 10)
    )
    semantic = F.coalesce(
        F.arrays_overlap("trigger_codes", F.array(*[F.lit(c) for c in R.SEMANTIC_CODES])), F.lit(False)
    )
    softer = (
        semantic & (F.col("r.hard_errors") <= F.col("o.hard_errors"))
        & ((F.col("r.warnings") < F.col("o.warnings")) | (F.col("r.semantic_risks") < F.col("o.semantic_risks")))
    )
    why = (
        F.when(F.col("r_answer") & inflated, F.lit("kept original: only more rows"))
        .when(F.col("r_answer") & (F.col("r") < F.col("o")), F.lit("retry: lower penalty"))
        .when(F.col("r_answer") & softer, F.lit("retry: fewer semantic risks"))
        .otherwise(F.lit("kept original: no improvement"))
    )
    return df.select(
        "task_id", F.when(why.startswith("retry"), F.lit("retry")).otherwise(F.lit("original")).alias("selected"),
        why.alias("rationale"),
    )


def attempt_same(cells: DataFrame) -> DataFrame:
    """Whether two attempts of a task gave the same cells; no answer is ever collected."""
    per_cell = cells.groupBy("task_id", "row_idx", "col_idx", "v").agg(
        F.count_if(F.col("attempt") == "original").alias("o"),
        F.count_if(F.col("attempt") == "retry").alias("r"),
    )
    return per_cell.groupBy("task_id").agg(F.bool_and(F.col("o") == F.col("r")).alias("same_answer"))


def evidence_summary(
    parts: DataFrame, text: str, max_chars: int | None = 1500, size: int = 512
) -> DataFrame:
    """Evidence lines of a task in step order, joined; cut at ``max_chars`` with a note, or whole.

    Only lines that begin up to the cut are gathered. Where a line begins comes from the
    lengths of earlier slices of ``size`` steps and a running length inside its slice, so
    no task reads all lines of a long trace.
    """
    line = parts.withColumn("_n", F.length(text) + 1).withColumn("_slice", F.floor(F.col("step_index") / size))
    if max_chars is not None:
        slices = line.groupBy("task_id", "_slice").agg(F.sum("_n").alias("_sum"))
        over_task = Window.partitionBy("task_id")
        earlier = over_task.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
        starts = slices.select(
            "task_id", "_slice", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_start"),
            (F.sum("_sum").over(over_task) - 1).alias("_len"),
        )
        inside = Window.partitionBy("task_id", "_slice").orderBy("step_index", "part_no").rowsBetween(
            Window.unboundedPreceding, -1
        )
        line = (
            line.join(starts.filter(F.col("_start") <= max_chars), ["task_id", "_slice"])
            .withColumn("_at", F.col("_start") + F.coalesce(F.sum("_n").over(inside), F.lit(0)))
            .filter(F.col("_at") <= max_chars)
        )
    else:
        line = line.withColumn("_len", F.lit(0).cast("bigint"))
    joined = line.groupBy("task_id").agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct("step_index", "part_no", F.col(text).alias("t")))), lambda x: x["t"]
            ),
            "\n",
        ).alias("_s"),
        F.max("_len").alias("_len"),
    )
    if max_chars is None:
        return joined.select("task_id", F.col("_s").alias("summary"))
    over = F.col("_len") - max_chars
    cut = F.concat(
        F.substring("_s", 1, max_chars), F.lit("\n... <"), over.cast("string"), F.lit(" more chars truncated>")
    )
    return joined.select("task_id", F.when(over > 0, cut).otherwise(F.col("_s")).alias("summary"))
