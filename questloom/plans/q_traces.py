"""Trace analytics and failure mining."""

from __future__ import annotations

from pyspark.sql import functions as F

from questloom.operators import classify as C
from questloom.operators import mining as M
from questloom.operators import traces as R
from questloom.plans import duck as D
from questloom.plans import fixtures as fx
from questloom.plans.q_verify import REPORT_SQL, SEM_CHECKS_SQL, SEM_USES, review
from questloom.plans.registry import Tables, query
from questloom.rules import traces as X
from questloom.rules import wording as W

fx.define("task_runs", """
SELECT c_custkey AS task_id, c_nationkey % 3 = 0 AS succeeded, CASE c_custkey % 5 WHEN 1 THEN 'Task Timed Out after 300s' WHEN 2 THEN 'max_steps reached' WHEN 3 THEN 'crashed: ' || c_name ELSE '' END AS failure_reason,
 CAST(c_custkey % 97 AS DOUBLE) AS elapsed_seconds FROM customer""", ("customer",))

fx.define("audit_tasks", """
SELECT task_id, question, difficulty, task_id % 5 <> 4 AS has_table, task_id % 3 = 0 AS has_doc FROM mixed_questions""", ("mixed_questions",))

fx.define("answer_words", """
SELECT task_id, CASE task_id % 7 WHEN 0 THEN ' N/A ' WHEN 1 THEN '' ELSE 'v' END AS v FROM mixed_questions
UNION ALL SELECT task_id, CASE WHEN task_id % 14 = 0 THEN 'Answer' ELSE 'n/a' END FROM mixed_questions WHERE task_id % 7 <> 1""", ("mixed_questions",))

fx.define("error_texts", """
SELECT event_id, CASE event_id % 14 WHEN 0 THEN 'No such column: x' WHEN 1 THEN 'no such table t' WHEN 2 THEN 'Ambiguous column a' WHEN 3 THEN 'SYNTAX ERROR near' WHEN 4 THEN 'TypeError: x' WHEN 5 THEN 'NameError'
 WHEN 6 THEN 'KeyError: k' WHEN 7 THEN 'FileNotFoundError' WHEN 8 THEN 'Parse error' WHEN 9 THEN 'permission denied' WHEN 10 THEN 'timeout, syntax error' WHEN 11 THEN 'out of memory' ELSE event_type END AS error FROM events""", ("events",))

fx.define("signal_tasks", """
SELECT task_id, question, CASE task_id % 6 WHEN 1 THEN 'TIMEOUT!' WHEN 2 THEN 'max_steps' WHEN 3 THEN ' boom ' ELSE '' END AS failure_reason,
 task_id % 4 <> 0 AS answer_present, task_id % 5 = 0 AS budget_exhausted, task_id % 3 AS filled_cells, task_id % 2 AS numeric_cells FROM mixed_questions""", ("mixed_questions",))

fx.define("attempt_signals", """
SELECT task_id, 'original' AS attempt, code, severity FROM task_signals
UNION ALL SELECT task_id, 'retry', code, CASE WHEN task_id % 2 = 0 THEN 'info' ELSE severity END FROM task_signals WHERE (task_id + length(code)) % 3 <> 0""", ("task_signals",))

fx.define("attempts", """
SELECT task_id, 'original' AS attempt, task_id % 5 <> 0 AS answer_present, task_id % 4 * 20 AS data_row_count, CASE WHEN task_id % 3 = 0 THEN 'answer' ELSE 'a,b' END AS cols FROM (SELECT DISTINCT user_id AS task_id FROM events)
UNION ALL SELECT task_id, 'retry', task_id % 7 <> 0, task_id % 4 * 20 + task_id % 13, CASE WHEN task_id % 4 = 0 THEN 'answer' ELSE 'a' END FROM (SELECT DISTINCT user_id AS task_id FROM events)""", ("events",))

fx.define("attempt_cells", """
SELECT c_nationkey AS task_id, c_custkey AS row_idx, 0 AS col_idx, 'original' AS attempt, c_name AS v FROM customer
UNION ALL SELECT c_nationkey, c_custkey, 0, 'retry', CASE WHEN c_nationkey % 2 = 0 OR c_mktsegment <> 'BUILDING' THEN c_name ELSE 'x' END FROM customer WHERE c_nationkey <> 4 OR c_mktsegment <> 'BUILDING'""", ("customer",))

fx.define("evidence_parts", """
SELECT task_id, step_index, 0 AS part_no, '[' || action || '] rows: ' || CAST(step_index % 9 AS STRING) AS part FROM trace_steps WHERE action <> 'read_doc'
UNION ALL SELECT task_id, step_index, 1, '[' || action || '] summary: ' || action_key FROM trace_steps WHERE action = 'execute_python'""", ("trace_steps",))

fx.define("run_tasks", """
SELECT c_custkey AS task_id, CASE c_custkey % 4 WHEN 0 THEN 'easy' WHEN 1 THEN 'medium' WHEN 2 THEN 'hard' END AS difficulty, CASE c_nationkey % 3 WHEN 0 THEN 'sql_first' WHEN 1 THEN 'python_first' ELSE 'hybrid_doc_table' END AS route,
 CASE c_nationkey % 5 WHEN 0 THEN 'threshold_count' WHEN 1 THEN 'rank_lookup' WHEN 2 THEN 'aggregation' WHEN 3 THEN 'lookup' ELSE 'ratio_or_percentage' END AS task_type, CASE c_custkey % 2 WHEN 0 THEN 'count' ELSE 'ratio' END AS operation,
 CASE c_custkey % 3 WHEN 0 THEN 'scalar' ELSE 'table' END AS output_shape, CASE c_custkey % 3 WHEN 0 THEN 'school' WHEN 1 THEN 'school,superhero' ELSE '' END AS domain_list FROM customer""", ("customer",))
fx.define("run_scores", "SELECT c_custkey AS task_id, (c_custkey % 11) / 10.0 AS score FROM customer WHERE c_nationkey <> 5", ("customer",))


@query("trace_tool_usage", "SELECT task_id, action, count(*) AS calls, round(avg(ok::INT), 6) AS success_rate FROM trace_steps GROUP BY 1, 2", ["trace_steps"])
def trace_tool_usage(t: Tables):
    return R.tool_usage(t.trace_steps).withColumn("success_rate", F.round("success_rate", 6))


_CAT = """ct AS (SELECT r.*, coalesce(n, 0) AS total_steps, CASE WHEN succeeded THEN 'none' WHEN contains(lower(failure_reason), 'timed out') THEN 'timeout' WHEN contains(failure_reason, 'max_steps') THEN 'exceeded_max_steps' WHEN bad THEN 'tool_error' ELSE 'no_answer' END AS failure_category
FROM task_runs r LEFT JOIN (SELECT task_id, count(*) AS n, bool_or(NOT ok) AS bad FROM trace_steps GROUP BY 1) s ON s.task_id = r.task_id)"""
_RUNS = ["task_runs", "trace_steps"]


def _categories(t: Tables):
    return R.failure_category(t.task_runs, t.trace_steps)


@query("trace_failure_category", f"WITH {_CAT} SELECT * FROM ct", _RUNS)
def trace_failure_category(t: Tables):
    return _categories(t)


@query("run_summary", f"""WITH {_CAT}, g AS (SELECT count(*)::DOUBLE AS n, count(*) FILTER (succeeded)::DOUBLE AS ok, avg(total_steps) AS st, avg(elapsed_seconds) AS se FROM ct)
SELECT 'figure' AS kind, unnest(['task_count', 'succeeded_count', 'failed_count', 'success_rate', 'avg_steps_per_task', 'avg_elapsed_seconds']) AS name, unnest([n, ok, n - ok, round(ok / n, 3), round(st, 1), round(se, 1)]) AS value FROM g
UNION ALL SELECT * FROM (SELECT 'tool', action, count(*)::DOUBLE AS c FROM trace_steps GROUP BY action ORDER BY c DESC, action LIMIT 5)
UNION ALL SELECT 'failure', failure_category, count(*)::DOUBLE FROM ct WHERE NOT succeeded GROUP BY 2""", _RUNS)
def run_summary(t: Tables):
    return R.run_summary(_categories(t), t.trace_steps)


@query("case_pick", f"""WITH {_CAT} SELECT (SELECT task_id FROM ct WHERE succeeded ORDER BY total_steps, task_id LIMIT 1) AS best_task,
(SELECT task_id FROM ct WHERE NOT succeeded ORDER BY length(failure_reason) DESC, task_id LIMIT 1) AS worst_task""", _RUNS)
def case_pick(t: Tables):
    return R.case_pick(_categories(t))


FLAGS_SQL = """w AS (SELECT *, list(action_key) OVER (PARTITION BY task_id ORDER BY step_index ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS prev,
 sum((NOT ok)::INT) OVER (PARTITION BY task_id ORDER BY step_index ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS errs,
 sum((action IN ('search_doc', 'read_doc', 'profile_context'))::INT) OVER p6 AS scout, sum((action IN ('execute_data_sql', 'execute_python'))::INT) OVER p6 AS comp,
 sum((action = 'execute_data_sql' AND rows_returned <= 2)::INT) OVER (PARTITION BY task_id ORDER BY step_index ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS emp,
 sum((action = 'profile_context')::INT) OVER (PARTITION BY task_id ORDER BY step_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prof
 FROM trace_steps WINDOW p6 AS (PARTITION BY task_id ORDER BY step_index ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING)),
fl AS (SELECT task_id, step_index, action, CAST(coalesce(len(list_filter(prev, lambda k: k = action_key)), 0) AS INT) AS repeat_count,
 coalesce(len(list_filter(prev, lambda k: k = action_key)), 0) >= 2 AS repeated, errs >= 3 AS error_run,
 action IN ('search_doc', 'read_doc') AND coalesce(scout, 0) >= 4 AND coalesce(comp, 0) = 0 AS scout_excess,
 action = 'execute_data_sql' AND coalesce(emp, 0) >= 3 AS empty_sql_run, step_index <= 2 AND coalesce(prof, 0) = 0 AND action <> 'profile_context' AS profile_missing FROM w)"""


def _flags(t: Tables, size: int = 512):
    return R.step_flags(t.trace_steps, size)


def _flag_query(name: str, flag: str, extra: str = ""):
    cols = "task_id, step_index, action" + extra

    @query(name, f"WITH {FLAGS_SQL} SELECT {cols} FROM fl WHERE {flag}", ["trace_steps"])
    def run(t: Tables):
        return _flags(t).filter(flag).select(*[c.strip() for c in cols.split(",")])

    return run


_flag_query("trace_repetition", "repeated", ", repeat_count")
_flag_query("trace_error_runs", "error_run")
_flag_query("trace_scout_excess", "scout_excess")
_flag_query("trace_empty_sql_runs", "empty_sql_run")
_flag_query("trace_profile_first", "profile_missing")


@query("trace_step_flags", f"WITH {FLAGS_SQL} SELECT task_id, step_index, repeated, error_run, scout_excess, empty_sql_run, profile_missing FROM fl", ["trace_steps"])
def trace_step_flags(t: Tables):
    # Small slices here, so that the overlap is exercised.
    return _flags(t, 16).select(
        "task_id", "step_index", "repeated", "error_run", "scout_excess", "empty_sql_run", "profile_missing"
    )


@query("trace_low_budget", """WITH f AS (SELECT task_id, min(step_index) AS first FROM trace_steps WHERE action = 'profile_context' GROUP BY 1)
SELECT s.task_id, s.step_index, s.action, 40 - s.step_index AS steps_left FROM trace_steps s LEFT JOIN f ON f.task_id = s.task_id
WHERE 40 - s.step_index BETWEEN 1 AND 3 AND action IN ('search_doc', 'read_doc', 'profile_context') AND (action <> 'profile_context' OR first < step_index)
AND s.task_id NOT IN (SELECT task_id FROM customer_questions WHERE difficulty = 'easy')""", ["trace_steps", "customer_questions"])
def trace_low_budget(t: Tables):
    light = t.customer_questions.filter(F.col("difficulty") == "easy")
    return R.low_budget(t.trace_steps, 40, light).select("task_id", "step_index", "action", "steps_left")


_AEV = ", ".join(f"bool_or({D.any_contains('lower(text)', ts)}) AS e_{n}" for n, ts in X.AUDIT_EVIDENCE)
_LIGHT = "(difficulty IN ('easy', 'medium') AND has_table AND NOT has_doc)"


def _e(n: str) -> str:
    return f"coalesce(e_{n}, FALSE)"


@query("trace_answer_audit", f"""WITH ev AS (SELECT task_id, {_AEV}, bool_or(action IN {X.COMPUTE}) AS uc, bool_or(action IN {X.STRUCTURED}) AS us, max(step_index) AS last_step FROM trace_texts GROUP BY 1),
ph AS (SELECT task_id, count(*) FILTER (trim(v) <> '') = count(*) FILTER (trim(v) <> '' AND lower(trim(v)) IN {X.PLACEHOLDERS}) AS placeholder FROM answer_words GROUP BY 1)
SELECT t.task_id, CASE WHEN coalesce(placeholder, TRUE) THEN 'placeholder_answer_blocked' WHEN greatest(60 - coalesce(last_step, 0) - 1, 0) = 0 THEN 'allow'
WHEN has_table AND NOT coalesce(us, FALSE) THEN 'tabular_answer_without_evidence' WHEN {D.like('question', X.NUMERIC)} AND has_table AND NOT coalesce(uc, FALSE) THEN 'numeric_answer_without_computation'
WHEN NOT {_LIGHT} AND {D.like('question', W.RATIO)} AND NOT ({_e('numerator')} AND {_e('denominator')}) THEN 'denominator_evidence_missing'
WHEN NOT {_LIGHT} AND {D.like('question', W.AVERAGE_MONTHLY)} AND NOT ({_e('avg')} AND {_e('sum')} AND {_e('candidates')}) THEN 'average_monthly_candidates_missing'
WHEN {D.like('question', X.RANKED)} AND {_e('position')} AND NOT {_e('rank')} THEN 'rank_field_evidence_missing'
WHEN NOT {_LIGHT} AND {D.like('question', W.THRESHOLD)} AND NOT {_e('threshold')} THEN 'threshold_evidence_missing'
WHEN NOT {_LIGHT} AND {D.like('question', W.COUNT)} AND {_e('count_star')} AND NOT {_e('distinct')} AND {_e('many')} THEN 'count_target_evidence_missing' ELSE 'allow' END AS code
FROM audit_tasks t LEFT JOIN ev ON ev.task_id = t.task_id LEFT JOIN ph ON ph.task_id = t.task_id""", ["audit_tasks", "trace_texts", "answer_words"])
def trace_answer_audit(t: Tables):
    return R.answer_audit(
        t.audit_tasks, R.audit_evidence(t.trace_texts, "text"), R.placeholder_answers(t.answer_words), 60
    )


_ERRS = "CASE " + " ".join(f"WHEN contains(lower(error), '{k}') THEN {{'p': '{n}', 's': 'medium', 'h': '{h}'}}" for n, k, h in X.ERROR_CLASSES) + f" ELSE {{'p': 'unknown', 's': 'high', 'h': '{X.UNKNOWN_ERROR}'}} END"


@query("error_classes", f"SELECT event_id, error, x.p AS pattern, x.s AS severity, x.h AS hint FROM (SELECT *, {_ERRS} AS x FROM error_texts)", ["error_texts"])
def error_classes(t: Tables):
    return R.error_classes(t.error_texts, "error")


_CODES = "CASE \"check\" " + " ".join(f"WHEN '{n}' THEN '{c}'" for n, c in X.CHECK_CODES) + " ELSE 'verification_error' END"
_NUM = D.names_of([(n, D.like("question", p)) for n, p in W.LOG_INTENTS])
SIGNALS_SQL = f"""{REPORT_SQL}, {SEM_CHECKS_SQL},
es AS (SELECT task_id, 0 AS source, {_CODES} AS code, 'error' AS severity FROM rp WHERE d IS NOT NULL
 UNION ALL SELECT task_id, 1, CASE WHEN contains(lower(failure_reason), 'timeout') THEN 'runtime_timeout' WHEN contains(lower(failure_reason), 'max_steps') THEN 'budget_exhaustion' ELSE 'runner_failure' END, 'error' FROM signal_tasks WHERE trim(failure_reason) <> ''
 UNION ALL SELECT task_id, 2, 'no_grounded_answer', 'error' FROM signal_tasks WHERE NOT answer_present
 UNION ALL SELECT task_id, 3, 'budget_exhaustion', 'warning' FROM signal_tasks WHERE budget_exhausted
 UNION ALL SELECT task_id, 4, 'numeric_grounding_error', 'warning' FROM signal_tasks WHERE list_has_any({_NUM}, {list(X.NUMERIC_INTENTS)}) AND filled_cells > 0 AND numeric_cells = 0
 UNION ALL SELECT task_id, check_no + 10, code, severity FROM semc WHERE NOT (code IN {X.INFO_ONLY} AND severity = 'info')),
eb AS (SELECT * FROM es QUALIFY row_number() OVER (PARTITION BY task_id, code ORDER BY source, severity) = 1),
sg AS (SELECT * FROM eb UNION ALL SELECT task_id, 9, 'passed_no_obvious_risk', 'info' FROM signal_tasks WHERE task_id NOT IN (SELECT task_id FROM eb))"""
SIGNAL_USES = ["check_cells", "check_headers", "check_tasks", "check_contracts", *SEM_USES, "signal_tasks"]


def _signals(t: Tables):
    tasks = t.signal_tasks.withColumn("intents", C.intents(F.col("question")))
    return R.failure_signals(tasks, review(t))


@query("failure_signals", f"WITH {SIGNALS_SQL} SELECT task_id, code, severity, CAST(source AS INT) AS source FROM sg", SIGNAL_USES)
def failure_signals(t: Tables):
    return _signals(t)


_NOTE = "CASE code " + " ".join(f"WHEN '{c}' THEN '{n}'" for c, n in X.NOTES) + " END"
_NOTES = f"""nn AS (SELECT DISTINCT task_id, {_NOTE} AS note FROM {{src}} WHERE {_NOTE} IS NOT NULL),
nt AS (SELECT * FROM nn UNION ALL SELECT DISTINCT task_id, '{X.NO_NOTE}' FROM {{src}} WHERE task_id NOT IN (SELECT task_id FROM nn))"""


@query("signal_notes", f"WITH {_NOTES.format(src='task_signals')} SELECT * FROM nt", ["task_signals"])
def signal_notes(t: Tables):
    return R.signal_notes(t.task_signals)


@query("failure_taxonomy", f"""WITH {_NOTES.format(src='task_signals')} SELECT 'signal' AS kind, code AS name, count(*) AS n FROM task_signals GROUP BY code UNION ALL SELECT 'severity', severity, count(*) FROM task_signals GROUP BY severity
UNION ALL SELECT 'route', route, count(*) FROM run_tasks GROUP BY route UNION ALL SELECT * FROM (SELECT 'note', note, count(*) AS n FROM nt GROUP BY note ORDER BY n DESC, note LIMIT 20)""", ["task_signals", "run_tasks"])
def failure_taxonomy(t: Tables):
    return R.failure_taxonomy(t.task_signals, t.run_tasks)


@query("taxonomy_tasks", "SELECT DISTINCT code, task_id FROM task_signals", ["task_signals"])
def taxonomy_tasks(t: Tables):
    return R.tasks_by_signal(t.task_signals)


_TRIG = f"""h AS (SELECT task_id, code, CAST(length(code) AS INT) AS source, severity FROM task_signals WHERE code IN {X.RETRY_CODES} AND NOT (code IN {X.SEMANTIC_CODES} AND severity = 'info')),
hg AS (SELECT task_id, code, min(source) AS source FROM h GROUP BY 1, 2), tg AS (SELECT task_id, list(code ORDER BY source, code) AS codes FROM hg GROUP BY 1),
l6 AS (SELECT * FROM trace_steps QUALIFY row_number() OVER (PARTITION BY task_id ORDER BY step_index DESC) <= 6),
stk AS (SELECT task_id, bool_and(action = 'search_doc') OR bool_and(action = 'read_csv') AS stuck FROM l6 GROUP BY 1)"""


def _triggers(t: Tables):
    signals = t.task_signals.withColumn("source", F.length("code"))
    return R.retry_triggers(signals, t.trace_steps)


@query("retry_triggers", f"WITH {_TRIG} SELECT tg.task_id, array_to_string(codes, '|') AS trigger_codes, NOT coalesce(stuck, FALSE) AS should_retry FROM tg LEFT JOIN stk ON stk.task_id = tg.task_id", ["task_signals", "trace_steps"])
def retry_triggers(t: Tables):
    return _triggers(t).withColumn("trigger_codes", F.array_join("trigger_codes", "|"))


_PEN = f"""wc AS (SELECT task_id, attempt, count(*) FILTER (severity = 'warning') AS w, count(DISTINCT CASE WHEN code IN {X.HARD_CODES} THEN code END) AS h, count(DISTINCT CASE WHEN code IN {X.SEMANTIC_CODES} THEN code END) AS s,
 bool_or(code IN ('no_grounded_answer', 'output_shape_error')) AS bad FROM attempt_signals GROUP BY 1, 2),
pe AS (SELECT a.task_id, a.attempt, answer_present, data_row_count, (NOT answer_present)::BIGINT AS no_answer, coalesce(h, 0) AS hard_errors, coalesce(w, 0) AS warnings, coalesce(s, 0) AS semantic_risks,
 (cols = 'answer' AND data_row_count <= 1)::BIGINT + coalesce(bad, FALSE)::BIGINT AS suspicious, (answer_present AND data_row_count = 0)::BIGINT AS no_rows FROM attempts a LEFT JOIN wc ON wc.task_id = a.task_id AND wc.attempt = a.attempt)"""
_ATT = ["attempts", "attempt_signals"]


def _penalties(t: Tables):
    attempts = t.attempts.withColumn("columns", F.split("cols", ",")).drop("cols")
    return R.attempt_penalty(t.attempt_signals, attempts)


@query("attempt_penalty", f"WITH {_PEN} SELECT * FROM pe", _ATT)
def attempt_penalty(t: Tables):
    return _penalties(t).select("task_id", "attempt", "answer_present", "data_row_count", "penalty.*")


@query("attempt_select", f"""WITH {_PEN}, {_TRIG}, j AS (SELECT o.task_id, [o.no_answer, o.hard_errors, o.warnings, o.semantic_risks, o.suspicious, o.no_rows] AS ot, [r.no_answer, r.hard_errors, r.warnings, r.semantic_risks, r.suspicious, r.no_rows] AS rt,
 o.data_row_count AS orow, r.data_row_count AS rrow, r.answer_present AS ra, coalesce(list_has_any(codes, {list(X.SEMANTIC_CODES)}), FALSE) AS sem FROM pe o JOIN pe r ON o.task_id = r.task_id LEFT JOIN tg ON tg.task_id = o.task_id WHERE o.attempt = 'original' AND r.attempt = 'retry'),
k AS (SELECT task_id, CASE WHEN ra AND orow > 0 AND rrow > orow AND ot[2:4] = rt[2:4] AND rrow > floor(orow * 1.25) AND rrow - orow > 10 THEN 'kept original: only more rows' WHEN ra AND rt < ot THEN 'retry: lower penalty'
 WHEN ra AND sem AND rt[2] <= ot[2] AND (rt[3] < ot[3] OR rt[4] < ot[4]) THEN 'retry: fewer semantic risks' ELSE 'kept original: no improvement' END AS rationale FROM j)
SELECT task_id, CASE WHEN rationale LIKE 'retry%' THEN 'retry' ELSE 'original' END AS selected, rationale FROM k""", [*_ATT, "task_signals", "trace_steps"])
def attempt_select(t: Tables):
    return R.attempt_select(_penalties(t), _triggers(t))


@query("attempt_same", """WITH c AS (SELECT task_id, row_idx, col_idx, v, count(*) FILTER (attempt = 'original') AS o, count(*) FILTER (attempt = 'retry') AS r FROM attempt_cells GROUP BY 1, 2, 3, 4)
SELECT task_id, bool_and(o = r) AS same_answer FROM c GROUP BY 1""", ["attempt_cells"])
def attempt_same(t: Tables):
    return R.attempt_same(t.attempt_cells)


@query("evidence_summary", """WITH s AS (SELECT task_id, string_agg(part, chr(10) ORDER BY step_index, part_no) AS s FROM evidence_parts GROUP BY 1)
SELECT task_id, CASE WHEN length(s) > 1500 THEN substr(s, 1, 1500) || chr(10) || '... <' || (length(s) - 1500) || ' more chars truncated>' ELSE s END AS summary FROM s""", ["evidence_parts"])
def evidence_summary(t: Tables):
    return R.evidence_summary(t.evidence_parts, "part", max_chars=1500)


_ROWS = """mr AS (SELECT t.task_id, coalesce(difficulty, 'unknown') AS difficulty, coalesce(route, 'unknown') AS route, task_type, operation, output_shape, domain_list, coalesce(s.score, 1.0)::DOUBLE AS score FROM run_tasks t LEFT JOIN run_scores s ON s.task_id = t.task_id),
lo AS (SELECT * FROM mr WHERE score < 1.0)"""
_MINE = ["run_tasks", "run_scores"]


def _rows(t: Tables):
    none = F.expr("cast(array() as array<string>)")
    runs = t.run_tasks.withColumn(
        "domains", F.when(F.col("domain_list") == "", none).otherwise(F.split("domain_list", ","))
    )
    return M.task_rows(runs, t.run_scores.withColumn("score", F.col("score").cast("double")))


@query("mining_rows", f"WITH {_ROWS} SELECT task_id, difficulty, route, task_type, operation, output_shape, replace(domain_list, ',', '|') AS domains, score FROM mr", _MINE)
def mining_rows(t: Tables):
    return _rows(t).withColumn("domains", F.array_join("domains", "|"))


@query("mining_low_scores", f"WITH {_ROWS} SELECT task_id, difficulty, score FROM lo", _MINE)
def mining_low_scores(t: Tables):
    return M.low_scores(_rows(t)).select("task_id", "difficulty", "score")


@query("mining_groups", f"""WITH {_ROWS} {' UNION ALL '.join(f"SELECT '{g}' AS kind, {g} AS name, count(*) AS n FROM lo GROUP BY {g}" for g in M.GROUPS)}
UNION ALL SELECT 'domain', d, count(*) FROM (SELECT unnest(string_split(domain_list, ',')) AS d FROM lo WHERE domain_list <> '') GROUP BY d
UNION ALL SELECT 'signal', code, count(*) FROM (SELECT DISTINCT task_id, code FROM task_signals) WHERE task_id IN (SELECT task_id FROM lo) GROUP BY code""", [*_MINE, "task_signals"])
def mining_groups(t: Tables):
    return M.group_counts(M.low_scores(_rows(t)), t.task_signals)


@query("mining_tasks_by", f"WITH {_ROWS} SELECT task_type AS label, task_id FROM lo", _MINE)
def mining_tasks_by(t: Tables):
    return M.tasks_by(M.low_scores(_rows(t)), "task_type")


def _rule(pairs, column: str) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in pairs) + " END"


@query("mining_recommendations", f"""WITH {_ROWS}, b AS (SELECT 'signal' AS kind, code AS key, {_rule(X.SIGNAL_RULES, 'code')} AS area, lo.task_id, 1 - score AS loss FROM lo JOIN (SELECT DISTINCT task_id, code FROM task_signals) s ON s.task_id = lo.task_id
UNION ALL SELECT 'task_type', task_type, {_rule(X.TYPE_RULES, 'task_type')}, task_id, 1 - score FROM lo),
g AS (SELECT kind, key, area, count(DISTINCT task_id) AS task_count, round(sum(loss), 4) AS total_score_loss FROM b WHERE area IS NOT NULL GROUP BY 1, 2, 3)
SELECT *, round(task_count * 10 + total_score_loss * 5, 4) AS priority FROM g""", [*_MINE, "task_signals"])
def mining_recommendations(t: Tables):
    return M.recommendations(M.low_scores(_rows(t)), t.task_signals)
