"""Answer verification and repair plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from questloom.operators import classify as C
from questloom.operators import verify as V
from questloom.plans import duck as D
from questloom.plans import fixtures as fx
from questloom.plans.q_classify import SEMANTIC_SQL, TRIGGER_SQL, triggers
from questloom.plans.q_sources import scratch
from questloom.plans.registry import Tables, query
from questloom.rules import wording as R

fx.define("check_cells", """
SELECT task_id, row_idx, 0 AS col_idx, CASE WHEN task_id = 7 THEN 'same' WHEN task_id = 9 THEN ' ' WHEN task_id = 8 THEN 'Traceback: ' || v ELSE v END AS v FROM messy_cells
UNION ALL SELECT c_nationkey, c_custkey, 1, CASE WHEN c_nationkey IN (7, 9) THEN '' ELSE c_mktsegment END FROM customer WHERE NOT (c_nationkey % 5 = 1 AND c_mktsegment = 'BUILDING')
UNION ALL SELECT task_id, row_idx, 2, CASE WHEN task_id IN (7, 9) THEN '' ELSE v END FROM messy_cells
UNION ALL SELECT c_nationkey, c_custkey, 3, 'x' || CAST(c_custkey AS STRING) FROM customer WHERE c_nationkey % 4 = 0
UNION ALL SELECT 1000000 + s_suppkey, 0, 0, CASE WHEN s_suppkey % 2 = 0 THEN ' ' ELSE '5%' END FROM supplier""", ("messy_cells", "customer", "supplier"), ("customer",))

fx.define("check_headers", """
SELECT DISTINCT task_id, col_idx, CASE WHEN col_idx = 3 AND task_id = 12 THEN 'Name' WHEN task_id = 13 THEN ' ' WHEN col_idx = 0 THEN 'Name' WHEN col_idx = 1 THEN 'Customer  ID' WHEN col_idx = 2 THEN 'text' ELSE 'url' END AS name FROM check_cells
UNION ALL SELECT 2000000 + n_nationkey, 0, 'lonely' FROM nation""", ("check_cells", "nation"))

fx.define("check_tasks", "SELECT DISTINCT task_id FROM check_headers UNION ALL SELECT 3000000 + r_regionkey FROM region", ("check_headers", "region"))

fx.define("check_contracts", """
SELECT task_id, CASE task_id % 5 WHEN 0 THEN 'name|customer id|TEXT' WHEN 1 THEN 'Name|Nope' WHEN 2 THEN 'text|Name|Customer ID' ELSE '' END AS cols,
 CAST(CASE task_id % 5 WHEN 0 THEN 3 WHEN 2 THEN 3 WHEN 3 THEN 1 END AS BIGINT) AS expected_column_count, CAST(CASE task_id % 7 WHEN 3 THEN 5 END AS BIGINT) AS min_rows,
 CAST(CASE task_id % 7 WHEN 4 THEN 3 END AS BIGINT) AS max_rows, task_id % 2 = 0 AS exact_columns FROM check_tasks WHERE task_id % 6 <> 5""", ("check_tasks",))

fx.define("trace_texts", """
SELECT task_id, step_index, action, action || ' ' || CASE action_key WHEN 'view:0' THEN 'SELECT count(*) FROM t' WHEN 'view:1' THEN 'numerator over denominator' WHEN 'click:0' THEN 'sum(x)' WHEN 'click:1' THEN 'select c.id from t'
 WHEN 'purchase:0' THEN 'avg(x) where x > 0' WHEN 'purchase:1' THEN 'x between 1 and 2' WHEN 'error:0' THEN 'distinct' ELSE 'thinking' END AS text FROM trace_steps""", ("trace_steps",))

_BASE = ["check_cells", "check_headers", "check_tasks"]
_S = D.trimmed("coalesce(v, '')")


@query("answer_precheck", f"""WITH h AS (SELECT task_id, count(*) AS columns FROM check_headers GROUP BY 1),
c AS (SELECT task_id, count(DISTINCT row_idx) AS rows, count(*) FILTER ({D.num('v')} IS NOT NULL AND length(split_part({D.trimmed('v')}, '.', 2)) > 2) AS long_decimals, count(*) FILTER (regexp_matches({_S}, '{V.NON_ISO_DATE}')) AS non_iso_dates FROM check_cells GROUP BY 1),
v AS (SELECT task_id, col_idx, list_sort(list(DISTINCT coalesce(v, ''))) AS vs FROM check_cells GROUP BY 1, 2),
p AS (SELECT a.task_id, count(*) AS same FROM v a JOIN v b ON a.task_id = b.task_id AND a.col_idx < b.col_idx AND a.vs = b.vs GROUP BY 1)
SELECT coalesce(h.task_id, c.task_id) AS task_id, coalesce(columns, 0) AS columns, coalesce(rows, 0) AS rows, coalesce(same, 0) AS redundant_pairs, coalesce(long_decimals, 0) AS long_decimals, coalesce(non_iso_dates, 0) AS non_iso_dates,
coalesce(columns, 0) > 10 AS many_columns, coalesce(columns, 0) > 0 AS ok FROM h FULL JOIN c ON h.task_id = c.task_id LEFT JOIN p ON p.task_id = coalesce(h.task_id, c.task_id)""", _BASE)
def answer_precheck(t: Tables):
    return V.precheck(t.check_headers, t.check_cells)


@query("verify_readable", """SELECT DISTINCT 'task_id=' || task_id AS answer, 'readability_check' AS "check", TRUE AS passed, 'readable' AS detail FROM check_cells
UNION ALL SELECT r_name, 'readability_check', FALSE, 'missing' FROM region""", _BASE)
def verify_readable(t: Tables):
    """Answers written as lines of few files, each behind its name, and names that no answer has."""
    folder = scratch(t, "predictions")
    name = F.concat(F.lit("task_id="), F.col("task_id").cast("string"))
    rows = t.check_cells.select(F.concat_ws("\t", name, F.concat_ws(",", "row_idx", "v")).alias("value"))
    rows.write.mode("overwrite").text(folder)
    lines = t.spark.read.text(folder).select(
        F.substring_index("value", "\t", 1).alias("answer"), F.expr("substr(value, instr(value, '\t') + 1)").alias("line")
    )
    names = t.check_cells.select(name.alias("answer")).distinct()
    lost = t.region.select(F.col("r_name").alias("answer"))
    return V.line_readability(lines, names.unionByName(lost), "answer", "line")


_CONTRACT = """hn AS (SELECT task_id, trim(name) AS name, count(*) AS k FROM check_headers GROUP BY 1, 2),
hf AS (SELECT task_id, sum(k) AS width, count(*) FILTER (name <> '') AS named, count(*) FILTER (name <> '' AND k > 1) AS dupes, sum(CASE WHEN length(name) > 512 THEN k ELSE 0 END) AS long_names FROM hn GROUP BY 1),
rw AS (SELECT task_id, row_idx, count(*) AS w FROM check_cells GROUP BY 1, 2),
bw AS (SELECT rw.task_id, count(*) FILTER (w <> width) AS bad FROM rw JOIN hf ON rw.task_id = hf.task_id GROUP BY 1),
cc AS (SELECT t.task_id, 'contract_check' AS "check", CASE WHEN width IS NULL THEN 'header missing' WHEN named = 0 THEN 'header has no names' WHEN dupes > 0 THEN 'duplicate headers' WHEN long_names > 0 THEN 'header too long' WHEN bad > 0 THEN 'inconsistent width' END AS d
 FROM check_tasks t LEFT JOIN hf ON hf.task_id = t.task_id LEFT JOIN bw ON bw.task_id = t.task_id)"""
_TASK = f"""hd AS (SELECT task_id, list(lower({D.squash('name')}) ORDER BY col_idx) AS header FROM check_headers GROUP BY 1),
nr AS (SELECT task_id, count(DISTINCT row_idx) AS n_rows FROM check_cells GROUP BY 1),
tj AS (SELECT t.task_id, header, coalesce(n_rows, 0) AS n_rows, c.*  EXCLUDE (task_id), c.task_id IS NOT NULL AS has, CASE WHEN cols = '' THEN [] ELSE list_transform(string_split(cols, '|'), lambda x: lower({D.squash('x')})) END AS want
 FROM check_tasks t LEFT JOIN hd ON hd.task_id = t.task_id LEFT JOIN nr ON nr.task_id = t.task_id LEFT JOIN check_contracts c ON c.task_id = t.task_id),
tc AS (SELECT task_id, 'task_contract_check' AS "check", CASE WHEN NOT has THEN NULL WHEN header IS NULL THEN 'no header' WHEN len(header) <> expected_column_count THEN 'column count differs'
 WHEN len(want) > 0 AND NOT list_has_all(header, want) THEN 'missing columns' WHEN len(want) > 0 AND exact_columns AND header <> want THEN 'header mismatch' WHEN n_rows < min_rows THEN 'too few rows' WHEN n_rows > max_rows THEN 'too many rows' END AS d FROM tj)"""
_SANE = f"""sr AS (SELECT task_id, row_idx, bool_or({_S} <> '') AS filled, count(*) FILTER (length({_S}) > 20000) AS lc, count(*) FILTER ({D.any_contains(f'lower({_S})', R.SUSPICIOUS)}) AS ec, list({{'c': col_idx, 'v': v}} ORDER BY col_idx, v) AS mark FROM check_cells GROUP BY 1, 2),
sf AS (SELECT task_id, count(*) AS n, count(*) FILTER (NOT filled) AS empty, count(DISTINCT mark) AS uniq, sum(lc) AS lc, sum(ec) AS ec FROM sr GROUP BY 1),
sc AS (SELECT t.task_id, 'sanity_check' AS "check", CASE WHEN n IS NULL THEN 'no data rows' WHEN n > 1000000 THEN 'too many rows' WHEN empty / n > 0.95 THEN 'too many empty rows' WHEN uniq / n < 0.05 AND n >= 20 THEN 'too many duplicates' WHEN lc > 0 THEN 'cell too long' WHEN ec > 0 THEN 'error-like text' END AS d
 FROM check_tasks t LEFT JOIN sf ON sf.task_id = t.task_id)"""
_SHAPE = f"""hw AS (SELECT task_id, count(*) AS width FROM check_headers GROUP BY 1), shr AS (SELECT task_id, count(DISTINCT row_idx) AS n, bool_or({_S} <> '') AS filled FROM check_cells GROUP BY 1),
sh AS (SELECT t.task_id, 'shape_check' AS "check", CASE WHEN width IS NULL THEN 'no header' WHEN width > 1000 THEN 'too many columns' WHEN n = 1 AND width = 1 AND NOT filled THEN 'single empty cell' END AS d
 FROM check_tasks t LEFT JOIN hw ON hw.task_id = t.task_id LEFT JOIN shr ON shr.task_id = t.task_id)"""


def _out(name: str) -> str:
    return f'SELECT task_id, "check", d IS NULL AS passed, coalesce(d, \'ok\') AS detail FROM {name}'


def _contracts(t: Tables):
    none = F.expr("cast(array() as array<string>)")
    return t.check_contracts.withColumn(
        "expected_columns", F.when(F.col("cols") == "", none).otherwise(F.split("cols", r"\|"))
    ).drop("cols")


@query("verify_contract", f"WITH {_CONTRACT} {_out('cc')}", _BASE)
def verify_contract(t: Tables):
    return V.contract_check(t.check_tasks, t.check_headers, t.check_cells)


@query("verify_task_contract", f"WITH {_TASK} {_out('tc')}", [*_BASE, "check_contracts"])
def verify_task_contract(t: Tables):
    return V.task_contract_check(t.check_tasks, t.check_headers, t.check_cells, _contracts(t))


@query("verify_sanity", f"WITH {_SANE} {_out('sc')}", _BASE)
def verify_sanity(t: Tables):
    return V.sanity_check(t.check_tasks, t.check_cells)


@query("verify_shape", f"WITH {_SHAPE} {_out('sh')}", _BASE)
def verify_shape(t: Tables):
    return V.shape_check(t.check_tasks, t.check_headers, t.check_cells)


REPORT_SQL = f"""{_CONTRACT}, {_TASK}, {_SANE}, {_SHAPE},
rd AS (SELECT task_id, 'readability_check' AS "check", CASE WHEN task_id >= 3000000 THEN 'missing' END AS d FROM check_tasks),
rp AS (SELECT * FROM rd UNION ALL SELECT x.* FROM (SELECT * FROM cc UNION ALL SELECT * FROM tc UNION ALL SELECT * FROM sc UNION ALL SELECT * FROM sh) x WHERE x.task_id < 3000000)"""


def _readable(t: Tables):
    gone = F.col("task_id") >= 3000000
    return t.check_tasks.select(
        "task_id", F.lit("readability_check").alias("check"), (~gone).alias("passed"),
        F.when(gone, F.lit("missing")).otherwise(F.lit("ok")).alias("detail"),
    )


def report(t: Tables):
    return V.full_report(_readable(t), t.check_headers, t.check_cells, _contracts(t))


def review(t: Tables):
    return V.review(
        _readable(t), t.check_headers, t.check_cells, _contracts(t),
        C.semantic_contract(t.mixed_questions, "question"), "question", V.trace_evidence(t.trace_texts, "text"),
    )


@query("verification_report", f"WITH {REPORT_SQL} {_out('rp')}", [*_BASE, "check_contracts"])
def verification_report(t: Tables):
    return report(t)


@query("verification_summary", f"WITH {REPORT_SQL} SELECT task_id, bool_and(d IS NULL) AS all_passed, count(*) FILTER (d IS NOT NULL) AS failed_checks FROM rp GROUP BY 1", [*_BASE, "check_contracts"])
def verification_summary(t: Tables):
    return V.all_passed(report(t))


_ACTIONS = "CASE \"check\" " + " ".join(f"WHEN '{n}' THEN {{'p': {p}, 'a': '{a}'}}" for n, p, a in R.CHECK_ACTIONS) + " END"


@query("repair_plan", f"""WITH {REPORT_SQL}, {TRIGGER_SQL}, f AS (SELECT task_id, {_ACTIONS} AS r, d FROM rp WHERE d IS NOT NULL),
e AS (SELECT task_id, r.p AS priority, r.a AS action_type, d AS detail, TRUE AS blocking FROM f UNION ALL SELECT task_id, priority, action_type, 'question wording', blocking FROM trig),
u AS (SELECT task_id, action_type, detail, min(priority) AS priority, bool_or(blocking) AS blocking FROM e GROUP BY 1, 2, 3)
SELECT task_id, action_type, detail, CAST(priority AS INT) AS priority, blocking, CAST(row_number() OVER (PARTITION BY task_id ORDER BY priority, action_type, detail) AS INT) AS step,
row_number() OVER (PARTITION BY task_id ORDER BY priority, action_type, detail) <= 5 AS applied FROM u""", [*_BASE, "check_contracts", "answer_shapes"])
def repair_plan(t: Tables):
    return V.repair_plan(report(t), triggers(t))


_EV = ", ".join(f"bool_or({D.any_contains('lower(text)', ts)}) AS e_{n}" for n, ts in V.EVIDENCE)


def _checks_sql() -> str:
    def ev(n: str) -> str:
        return f"coalesce(e_{n}, FALSE)"

    def risk(c: str) -> str:
        return f"list_contains(risks, '{c}')"

    def lv(c: str) -> str:
        return f"CASE WHEN {c} THEN 'warning' ELSE 'info' END"

    w, n = "coalesce(width, 0)", "coalesce(data_rows, 0)"
    packed = f"({n} > 0 AND {w} = 1 AND coalesce(packed, FALSE))"
    comment = "contains(q, 'comment') AND NOT regexp_matches(q, '\\bcomment\\s+id\\b|\\bid\\s+of\\s+the\\s+comment\\b')"
    rules = [
        ("target_noun_count_risk", risk("target_noun_count_risk"), lv(f"{ev('count_star')} AND NOT {ev('distinct')}")),
        ("denominator_risk", risk("denominator_risk"), lv(f"NOT ({ev('numerator')} AND {ev('denominator')})")),
        ("temporal_aggregation_risk", risk("temporal_aggregation_risk"), lv(f"{ev('sum')} AND NOT {ev('avg')} AND contains(q, 'average')")),
        ("rank_semantics_risk", risk("rank_semantics_risk"), "'info'"),
        ("threshold_grounding_risk", risk("threshold_grounding_risk"), lv(f"NOT ({ev('limits')} AND NOT {ev('outside')})")),
        ("output_shape_semantic_risk", risk("output_shape_semantic_risk"), lv(f"{w} < len(req) OR {packed}")),
        ("output_shape_semantic_risk", f"NOT {risk('output_shape_semantic_risk')} AND {packed} AND regexp_matches(question, '(?i)\\b(score|result|tally|record)\\b')", "'warning'"),
        ("target_field_semantic_risk", f"{comment} AND (({w} = 1 AND coalesce(h_id, FALSE) AND NOT coalesce(h_text, FALSE)) OR ({ev('selected_id')} AND NOT {ev('text')}))", "'warning'"),
        ("target_field_semantic_risk", f"{D.any_contains('q', R.URL_WORDS)} AND NOT coalesce(h_url, FALSE) AND NOT coalesce(v_url, FALSE)", "'warning'"),
        ("target_field_semantic_risk", f"contains(q, 'final score') AND {D.any_contains('q', ('home', 'away', 'between'))} AND {packed}", "'warning'"),
        ("scalar_format_semantic_risk", f"{D.any_contains('q', R.PERCENT_WORDS)} AND coalesce(v_percent, FALSE)", "'warning'"),
        ("population_filter_semantic_risk", f"aggregation = 'average' AND regexp_matches(question, '(?i)\\ball\\b') AND {ev('filters')}", "'warning'"),
        ("field_attachment_risk", risk("field_attachment_risk"), lv(f"NOT {D.like('question', R.GROUPING)} AND {n} > 1")),
        ("entity_identity_risk", risk("entity_identity_risk"), "'info'"),
        ("long_doc_metric_risk", risk("long_doc_metric_risk"), lv(f"NOT {ev('doc_tool')}")),
    ]
    items = ", ".join(f"CASE WHEN {c} THEN {{'code': '{k}', 'severity': {s}}} END" for k, c, s in rules)
    return f"list_filter([{items}], lambda x: x IS NOT NULL)"


SEM_CHECKS_SQL = f"""{SEMANTIC_SQL}, ls AS (SELECT * FROM trace_texts QUALIFY row_number() OVER (PARTITION BY task_id ORDER BY step_index DESC) <= 12),
ev AS (SELECT task_id, {_EV}, bool_or(regexp_matches(lower(text), '{V.SELECTED_ID}')) AS e_selected_id FROM ls GROUP BY 1),
hh AS (SELECT task_id, count(*) AS width, bool_or({D.any_contains('lower(name)', ('text', 'comment'))}) AS h_text, bool_or(contains(lower(name), 'id')) AS h_id, bool_or({D.any_contains('lower(name)', R.URL_WORDS)}) AS h_url FROM check_headers GROUP BY 1),
bb AS (SELECT task_id, count(DISTINCT row_idx) AS data_rows, bool_or(col_idx = 0 AND regexp_matches(v, '{R.PACKED_CELL}')) AS packed, bool_or(regexp_matches({_S}, '{R.URL}')) AS v_url, bool_or({_S} LIKE '%\\%' ESCAPE '\\') AS v_percent FROM check_cells GROUP BY 1),
aa AS (SELECT coalesce(hh.task_id, bb.task_id) AS task_id, hh.* EXCLUDE (task_id), bb.* EXCLUDE (task_id) FROM hh FULL JOIN bb ON hh.task_id = bb.task_id),
jj AS (SELECT s2.*, lower(question) AS q, aa.* EXCLUDE (task_id), ev.* EXCLUDE (task_id) FROM s2 LEFT JOIN aa ON aa.task_id = s2.task_id LEFT JOIN ev ON ev.task_id = s2.task_id),
ck AS (SELECT task_id, {_checks_sql()} AS l FROM jj), un AS (SELECT task_id, CAST(generate_subscripts(l, 1) - 1 AS INT) AS check_no, unnest(l) AS c FROM ck),
semc AS (SELECT task_id, check_no, c.code AS code, c.severity AS severity FROM un)"""
SEM_USES = ["mixed_questions", "check_cells", "check_headers", "trace_texts"]


@query("semantic_checks", f"WITH {SEM_CHECKS_SQL} SELECT * FROM semc", SEM_USES)
def semantic_checks(t: Tables):
    contracts = C.semantic_contract(t.mixed_questions, "question")
    return V.semantic_checks(
        contracts, "question", t.check_headers, t.check_cells, V.trace_evidence(t.trace_texts, "text")
    )


fx.define("step_outputs", """
SELECT event_id, user_id AS task_id, CASE event_type WHEN 'view' THEN 'max_age' WHEN 'click' THEN 'size_bytes_score' WHEN 'purchase' THEN 'success_rate' ELSE 'value' END AS name, value,
 CAST(FLOOR(value) AS INT) % 3 AS n_rows, CASE event_type WHEN 'error' THEN 'Query Failed: cannot bind' ELSE 'fine' END AS output FROM events""", ("events",))

_RULE = "CASE " + " ".join(f"WHEN contains(lower(name), '{w}') OR contains(lower(question), '{w}') THEN {{'m': '{w}', 'lo': {lo}::DOUBLE, 'hi': {hi}::DOUBLE}}" for w, lo, hi in R.RANGES) + " END"
_ERR = "CASE " + " ".join(f"WHEN contains(lower(output), '{p}') THEN '{p}'" for p in R.OUTPUT_ERRORS) + " END"


@query("critic_range_audit", f"""WITH r AS (SELECT o.event_id, o.name, o.value, q.question, {_RULE} AS r FROM step_outputs o JOIN mixed_questions q ON q.task_id = o.task_id)
SELECT event_id, name, value, question, r.m AS metric, r.lo AS low, r.hi AS high FROM r WHERE r IS NOT NULL AND NOT contains(lower(name), 'bytes') AND (value < r.lo OR value > r.hi)""", ["step_outputs", "mixed_questions"])
def critic_range_audit(t: Tables):
    rows = t.step_outputs.select("event_id", "task_id", "name", "value").join(
        t.mixed_questions.select("task_id", "question"), "task_id"
    ).drop("task_id")
    return V.range_audit(rows, "name", "value", "question")


@query("critic_output_warnings", f"SELECT event_id, n_rows, output, n_rows = 0 AS empty_result, {_ERR} AS error_pattern FROM step_outputs", ["step_outputs"])
def critic_output_warnings(t: Tables):
    return V.output_warnings(t.step_outputs.select("event_id", "n_rows", "output"), "n_rows", "output")
