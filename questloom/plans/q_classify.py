"""Question labels, contracts, risks and triggers."""

from __future__ import annotations

from pyspark.sql import functions as F

from questloom.operators import answers as N
from questloom.operators import classify as C
from questloom.plans import duck as D
from questloom.plans import fixtures as fx
from questloom.plans.registry import Tables, query
from questloom.rules import wording as R

# More wordings, so that every rule fires somewhere.
fx.define("mixed_questions", """
SELECT task_id, question, difficulty FROM customer_questions
UNION ALL SELECT 1000000000 + c_custkey, CASE c_custkey % 16
 WHEN 0 THEN 'Give the school name, funding type and average SAT math in Riverside for 1998.'
 WHEN 1 THEN 'Among the patients who are male, how many of them have abnormal fibrinogen and white blood level?'
 WHEN 2 THEN 'What is the final score between home and away?' WHEN 3 THEN 'Compute the percentage of hero height published by Acme'
 WHEN 4 THEN 'Columns: id, Name, id and total where x' WHEN 5 THEN 'What is the website url and name of the constructor champion?'
 WHEN 6 THEN 'Show the comment text with the highest score on posts with views' WHEN 7 THEN 'What is the average of all female superhero weight per month?'
 WHEN 8 THEN 'Identify the type of expense and total value approved for the event' WHEN 9 THEN 'Explain the policy: correlation trend, rolling sum by group'
 WHEN 10 THEN 'Which member full name has rank 2 finish time in the race?' WHEN 11 THEN 'List all records; the 3 largest by score result'
 WHEN 12 THEN 'Count of those rows?' WHEN 13 THEN 'How many times more than the budget in Food was spent?'
 WHEN 14 THEN 'Return the customer id, the name & date of joining' ELSE 'Describe it' END,
 CASE c_custkey % 3 WHEN 0 THEN 'easy' WHEN 1 THEN 'hard' ELSE 'medium' END FROM customer""", ("customer_questions", "customer"), ("customer",))

fx.define("sized_files", """
SELECT c_custkey AS task_id, 'csv/sales.csv' AS path, 1000 * (c_custkey % 9) * (c_custkey % 9) * 100 AS size FROM customer WHERE c_nationkey % 3 <> 0
UNION ALL SELECT c_custkey, 'db/x.SQLITE', 10 FROM customer WHERE c_nationkey % 4 = 0
UNION ALL SELECT c_custkey, 'json/y.json', 10 FROM customer WHERE c_nationkey % 5 = 0
UNION ALL SELECT c_custkey, 'doc/notes.md', 10 FROM customer WHERE c_nationkey % 6 = 0
UNION ALL SELECT c_custkey, 'knowledge.md', 10 FROM customer WHERE c_nationkey % 2 = 0
UNION ALL SELECT c_custkey, 'readme', 10 FROM customer""", ("customer",))

fx.define("task_payloads", """
SELECT c_custkey AS task_id, CASE c_custkey % 9
 WHEN 0 THEN '{"question":"q","expected_columns":["Name"," Total  Cost ","name"],"min_rows":2}'
 WHEN 1 THEN '{"output_columns":"Columns: a, b , A","max_rows":5}' WHEN 2 THEN '{"columns":[{"name":"x"},{"column":"y"},{"field":"z"},{"other":1}],"exact_columns":false}'
 WHEN 3 THEN '{"output_schema":{"properties":{"p1":{},"p2":{}}}}' WHEN 4 THEN '{"schema":{"fields":["f1",{"name":"f2"}]},"expected_min_rows":3,"min_rows":0}'
 WHEN 5 THEN '{"answer_schema":{"columns":"only"},"expected_max_rows":7}' WHEN 6 THEN '{"expected_columns":[],"schema":"s1"}' WHEN 7 THEN '{"question":"q"}'
 ELSE '{"headers":"' || c_mktsegment || ', n"}' END AS v FROM customer""", ("customer",))

_Q = ["mixed_questions"]


def _sig(c: str, words) -> str:
    t = D.squash(f"lower({c})")
    return D.names_of([(w, f"contains({t}, '{w}')" if " " in w else D.like(t, rf"\b{w}\b")) for w in words])


@query("question_signals", f"""SELECT task_id, array_to_string({_sig('question', R.SQL_SIGNALS)}, '|') AS sql_signals,
array_to_string({_sig('question', R.PYTHON_SIGNALS)}, '|') AS python_signals, array_to_string({_sig('question', R.DOCUMENT_SIGNALS)}, '|') AS document_signals FROM mixed_questions""", _Q)
def question_signals(t: Tables):
    q = F.col("question")
    return t.mixed_questions.select(
        "task_id", *[
            F.array_join(C.signals(q, w), "|").alias(n)
            for n, w in (("sql_signals", R.SQL_SIGNALS), ("python_signals", R.PYTHON_SIGNALS), ("document_signals", R.DOCUMENT_SIGNALS))
        ],
    )


_COUNTS = """SELECT task_id, count(*) FILTER (lower(path) LIKE '%.csv') AS csv_files, count(*) FILTER (lower(path) LIKE '%.csv' AND size >= 5242880) AS large_csv_files,
count(*) FILTER (regexp_matches(lower(path), '\\.(sqlite|db|sqlite3|db3|duckdb)$')) AS db_files, count(*) FILTER (lower(path) LIKE '%.json') AS json_files,
count(*) FILTER (regexp_matches(lower(path), '\\.(md|txt|pdf)$') AND NOT regexp_matches(lower(path), '(^|/)knowledge\\.md$')) AS doc_files,
count(*) FILTER (regexp_matches(lower(path), '(^|/)knowledge\\.md$')) AS knowledge_files FROM sized_files GROUP BY task_id"""


@query("route_scores", f"""WITH f AS ({_COUNTS}), g AS (SELECT q.task_id, question, difficulty, coalesce(csv_files, 0) AS csv_files, coalesce(large_csv_files, 0) AS large_csv_files, coalesce(db_files, 0) AS db_files, coalesce(json_files, 0) AS json_files, coalesce(doc_files, 0) AS doc_files, coalesce(knowledge_files, 0) AS knowledge_files FROM mixed_questions q LEFT JOIN f ON f.task_id = q.task_id), x AS (SELECT *, len({_sig('question', R.SQL_SIGNALS)}) AS s, len({_sig('question', R.PYTHON_SIGNALS)}) AS p, len({_sig('question', R.DOCUMENT_SIGNALS)}) AS d,
 csv_files > 0 AS csv, large_csv_files > 0 AS lg, db_files > 0 AS db, json_files > 0 AS js, doc_files > 0 AS doc, knowledge_files > 0 AS kn FROM g),
y AS (SELECT *, (db OR csv OR js) AS tb, difficulty IN ('easy', 'medium') AND (db OR csv OR js) AND NOT doc AS fast FROM x),
z AS (SELECT *, db::INT * 4 + lg::INT * 5 + CASE WHEN s > 0 THEN s + 2 ELSE 0 END + (fast AND (db OR lg))::INT * 4 AS sql_first,
 csv::INT * 3 + js::INT * 2 + CASE WHEN p > 0 THEN p + 2 ELSE 0 END + (NOT tb AND NOT (doc OR kn))::INT + (fast AND NOT db AND NOT lg)::INT * 4 AS python_first,
 CASE WHEN fast THEN least(1, doc::INT * 3 + (kn AND doc AND d > 0)::INT + CASE WHEN d > 0 THEN d + 2 ELSE 0 END) ELSE doc::INT * 3 + (kn AND doc AND d > 0)::INT + CASE WHEN d > 0 THEN d + 2 ELSE 0 END END AS document_first,
 db::INT * 2 + csv::INT + lg::INT * 3 + s + p + (db AND csv)::INT * 3 + (db AND p > 0)::INT * 3 + (fast AND (db OR lg))::INT * 2 + (fast AND NOT db AND NOT lg)::INT AS hybrid_sql_python,
 CASE WHEN fast THEN 0 ELSE doc::INT * 2 + d + (doc AND tb)::INT * 3 + (doc AND s > 0)::INT * 2 END AS hybrid_doc_table FROM y)
SELECT task_id, sql_first::INT AS sql_first, python_first::INT AS python_first, document_first::INT AS document_first, hybrid_sql_python::INT AS hybrid_sql_python, hybrid_doc_table::INT AS hybrid_doc_table,
CASE greatest(sql_first, python_first, document_first, hybrid_sql_python, hybrid_doc_table) WHEN 0 THEN 'python_first' WHEN sql_first THEN 'sql_first' WHEN python_first THEN 'python_first' WHEN document_first THEN 'document_first' WHEN hybrid_sql_python THEN 'hybrid_sql_python' ELSE 'hybrid_doc_table' END AS route FROM z""", [*_Q, "sized_files"])
def route_scores(t: Tables):
    counts = C.file_counts(t.sized_files, "task_id", "path", "size")
    out = C.route_scores(C.with_file_counts(t.mixed_questions, counts, "task_id"), "question", "difficulty")
    return out.select("task_id", *R.ROUTES, "route")


_P = {n: D.like("q", p) for n, p in R.PROFILE_FLAGS}
_TB, _DC = "contains(difficulty, 'e')", "difficulty = 'hard' OR difficulty = 'medium'"
_PROFILE = f"""p0 AS (SELECT *, {D.squash('lower(question)')} AS q, {_TB} AS tb, {_DC} AS dc FROM mixed_questions),
p1 AS (SELECT *, {', '.join(f'{c} AS {n}' for n, c in _P.items())} FROM p0),
p2 AS (SELECT *, CASE WHEN is_threshold AND is_count THEN 'threshold_count' WHEN is_ratio THEN 'ratio' WHEN is_average THEN 'aggregate_average' WHEN is_sum AND NOT is_count THEN 'aggregate_sum' WHEN is_rank THEN 'rank_lookup' WHEN is_count THEN 'count' WHEN is_lookup THEN 'lookup' ELSE 'analysis' END AS operation,
 CASE WHEN is_table THEN 'table' WHEN is_lookup AND is_pair THEN 'single_record' ELSE 'scalar' END AS output_shape FROM p1),
p3 AS (SELECT *, CASE operation WHEN 'ratio' THEN 'ratio_or_percentage' WHEN 'aggregate_average' THEN 'aggregation' WHEN 'aggregate_sum' THEN 'aggregation' WHEN 'lookup' THEN CASE WHEN tb AND dc THEN 'document_table_lookup' ELSE 'lookup' END WHEN 'analysis' THEN 'general_analysis' ELSE operation END AS task_type FROM p2)"""
_FOCUS = D.names_of([(x, f"task_type IN ({', '.join(repr(k) for k in ks)})") for ks, x in R.FOCUS] + [("extract document rules first, then apply them to table rows", "tb AND dc")])


def task_profiles(t: Tables):
    d = F.col("difficulty")
    return C.task_profile(t.mixed_questions, "question", d.contains("e"), d.isin("hard", "medium"))


@query("task_profile", f"""WITH {_PROFILE} SELECT task_id, operation, task_type, output_shape,
array_to_string({D.names_of([('join_likely', 'is_join OR (tb AND dc)'), ('doc_table_grounding', 'tb AND dc'), ('single_value_expected', "output_shape = 'scalar' AND task_type IN ('count', 'aggregation', 'ratio_or_percentage', 'threshold_count')")])}, '|') AS flags,
array_to_string({_FOCUS}, '|') AS validation_focus FROM p3""", _Q)
def task_profile(t: Tables):
    return task_profiles(t).select(
        "task_id", "operation", "task_type", "output_shape", F.array_join("flags", "|").alias("flags"),
        F.array_join("validation_focus", "|").alias("validation_focus"),
    )


@query("domain_tags", f"""WITH n AS (SELECT task_id, {', '.join(f"bool_or({D.any_contains('lower(column_name)', ts)}) AS {d}" for d, ts in R.DOMAINS)} FROM task_columns GROUP BY task_id)
SELECT q.task_id, array_to_string({D.names_of([(d, f"{D.any_contains('lower(q.question)', ts)} OR coalesce(n.{d}, FALSE)") for d, ts in R.DOMAINS])}, '|') AS domains
FROM mixed_questions q LEFT JOIN n ON n.task_id = q.task_id""", [*_Q, "task_columns"])
def domain_tags(t: Tables):
    out = C.domain_tags(t.mixed_questions, t.task_columns, "task_id", "question", "column_name")
    return out.select("task_id", F.array_join("domains", "|").alias("domains"))


@query("schema_hints", "SELECT task_id, table_name, string_agg(trim(column_name), '|' ORDER BY ordinal) AS columns FROM task_columns GROUP BY 1, 2", ["task_columns"])
def schema_hints(t: Tables):
    # The array is as long as the table is wide.
    cols = F.array_sort(F.collect_list(F.struct("ordinal", F.trim("column_name").alias("c"))))
    return t.task_columns.groupBy("task_id", "table_name").agg(cols.alias("x")).select(
        "task_id", "table_name", F.array_join(F.transform("x", lambda i: i["c"]), "|").alias("columns")
    )


@query("question_intents", f"SELECT task_id, array_to_string({D.names_of([(n, D.like('question', p)) for n, p in R.LOG_INTENTS])}, '|') AS intents FROM mixed_questions", _Q)
def question_intents(t: Tables):
    return t.mixed_questions.select("task_id", F.array_join(C.intents(F.col("question")), "|").alias("intents"))


def _cols(items: str) -> str:
    clean = f"list_filter(list_transform({items}, lambda x: {D.squash('x')}), lambda x: x <> '')"
    return D.distinct_ignoring_case(clean)


def _wording() -> str:
    named = "CASE " + " ".join(
        f"WHEN len({c}) > 0 THEN {c}" for c in (
            _cols(f"string_split(regexp_replace(regexp_extract(question, '{p}', 1), '{R.NAMED_END}', ''), ',')") for p in R.NAMED_COLUMNS)
    ) + " ELSE [] END"

    def listed(p: str) -> str:
        phrase = f"trim(regexp_replace(regexp_extract(q, '{p}', 1), '\\b(and\\s+)?their\\b', '', 'g'), ' ,')"
        parts = f"list_transform(regexp_split_to_array({phrase}, '{R.LIST_GAP}'), lambda x: trim(x, ' ,'))"
        kept = f"list_filter({parts}, lambda x: x <> '' AND NOT list_contains({list(R.LIST_STOP)}, x) AND len(regexp_split_to_array(x, '\\s+')) <= 6)"
        return f"CASE WHEN len({kept}) >= 2 THEN len({kept}) END"

    two = D.holds("q", (("type",), ("expense",), ("total value", "total cost", "sum", "total"))) + " OR " + D.holds("q", (("website", "web site", "url"), ("name", "reference", "ref")))
    single = " OR ".join(D.like("q", p) for p in R.SINGLE_FIELD)
    cap = ", ".join(f"CASE WHEN TRY_CAST(regexp_extract(q, '{p}', 1) AS BIGINT) > 0 THEN TRY_CAST(regexp_extract(q, '{p}', 1) AS BIGINT) END" for p in R.ROW_CAPS)
    return f"""WITH r AS (SELECT *, lower(trim(question)) AS q FROM mixed_questions), n AS (SELECT *, {named} AS cols FROM r)
SELECT task_id, array_to_string(cols, '|') AS expected_columns, CAST(CASE WHEN len(cols) > 0 THEN len(cols) WHEN {two} THEN 2 ELSE coalesce({', '.join(listed(p) for p in R.LISTED_FIELDS)}, CASE WHEN {single} THEN 1 END) END AS BIGINT) AS expected_column_count,
coalesce({cap}) AS max_rows FROM n"""


@query("contract_from_wording", _wording(), _Q)
def contract_from_wording(t: Tables):
    return C.contract_from_wording(t.mixed_questions, "question").select(
        "task_id", F.array_join("expected_columns", "|").alias("expected_columns"), "expected_column_count", "max_rows"
    )


@query("contract_from_fields", """SELECT task_id,
CASE task_id % 9 WHEN 0 THEN 'expected_columns' WHEN 1 THEN 'output_columns' WHEN 2 THEN 'columns' WHEN 3 THEN 'output_schema' WHEN 4 THEN 'schema' WHEN 5 THEN 'answer_schema' WHEN 6 THEN 'schema' WHEN 8 THEN 'headers' END AS source,
CASE task_id % 9 WHEN 0 THEN 'Name|Total Cost' WHEN 1 THEN 'a|b' WHEN 2 THEN 'x|y|z' WHEN 3 THEN 'p1|p2' WHEN 4 THEN 'f1|f2' WHEN 5 THEN 'only' WHEN 6 THEN 's1' WHEN 8 THEN trim(split_part(json_extract_string(v, '$.headers'), ',', 1)) || '|n' END AS expected_columns,
CAST(CASE task_id % 9 WHEN 0 THEN 2 WHEN 4 THEN 3 END AS BIGINT) AS min_rows, CAST(CASE task_id % 9 WHEN 1 THEN 5 WHEN 5 THEN 7 END AS BIGINT) AS max_rows, task_id % 9 <> 2 AS exact_columns FROM task_payloads""", ["task_payloads"])
def contract_from_fields(t: Tables):
    return C.contract_from_fields(t.task_payloads, "v").select(
        "task_id", "source", F.array_join("expected_columns", "|").alias("expected_columns"), "min_rows", "max_rows", "exact_columns"
    )


def _semantic() -> str:
    def clean(c: str) -> str:
        return f"NULLIF({D.squash(f'regexp_replace(trim(lower({c}), $$ ?.,:;$$), $${R.TARGET_LEAD}$$, $$$$)')}, '')"

    ante = clean(f"regexp_extract(question, '{R.ANTECEDENT}', 1)")
    targets = ", ".join(
        f"CASE WHEN {x} IN {R.PRONOUNS} THEN coalesce({ante}, {x}) ELSE {x} END" for x in (clean(f"regexp_extract(question, '{p}', 1)") for p in R.COUNT_TARGETS)
    )

    def req(p: str) -> str:
        span = f"regexp_extract(trim(question), '{p}', 1)"
        kept = (
            f"list_filter(list_transform(regexp_split_to_array({span}, '{R.REQUEST_GAP}'), lambda x: trim(regexp_replace(trim(x, ' .,:;'), '(?i)^(?:the|a|an)\\s+', ''))),"
            f" lambda x: x <> '' AND NOT regexp_matches(x, '{R.COUNT}'))"
        )
        return f"CASE WHEN length({span}) <= 120 AND len({kept}) >= 2 THEN {D.distinct_ignoring_case(kept)} END"

    agg = "CASE " + " ".join(f"WHEN {D.like('question', p)} THEN '{n}'" for n, p in R.AGGREGATIONS) + " END"
    risks = D.names_of([
        ("target_noun_count_risk", f"target_noun IS NOT NULL AND target_noun NOT IN {R.ROW_NOUNS}"), ("denominator_risk", D.like("question", R.RATIO)),
        ("temporal_aggregation_risk", f"{D.like('question', R.AVERAGE)} AND {D.like('question', R.TEMPORAL)}"), ("rank_semantics_risk", D.like("question", R.RANK)),
        ("threshold_grounding_risk", D.like("question", R.THRESHOLD)), ("output_shape_semantic_risk", "len(req) > 0"),
        ("field_attachment_risk", f"{D.like('question', R.ATTACHMENT)} AND {D.like('question', R.METRIC)}"), ("entity_identity_risk", D.like("question", R.IDENTITY)),
        ("long_doc_metric_risk", D.like("question", R.DOCUMENT))])
    return f"""s0 AS (SELECT *, {agg} AS aggregation, coalesce({', '.join(req(p) for p in R.REQUESTED)}, []) AS req FROM mixed_questions),
s1 AS (SELECT *, CASE WHEN aggregation = 'count' THEN coalesce({targets}) END AS target_noun FROM s0),
s2 AS (SELECT *, {risks} AS risks FROM s1)"""


SEMANTIC_SQL = _semantic()


@query("semantic_contract", f"""WITH {SEMANTIC_SQL} SELECT task_id, array_to_string({D.names_of([(n, D.like('question', p)) for n, p in R.INTENTS])}, '|') AS intents, aggregation, target_noun, array_to_string(req, '|') AS requested_fields,
CASE WHEN aggregation IS NOT NULL AND len(req) = 0 THEN 'scalar' WHEN len(req) > 0 THEN len(req) || ' requested field(s)' ELSE 'unknown' END AS output_shape, array_to_string(risks, '|') AS risk_codes FROM s2""", _Q)
def semantic_contract(t: Tables):
    out = C.semantic_contract(t.mixed_questions, "question")
    return out.select(
        "task_id", F.array_join("intents", "|").alias("intents"), "aggregation", "target_noun",
        F.array_join("requested_fields", "|").alias("requested_fields"), "output_shape",
        F.array_join("risk_codes", "|").alias("risk_codes"),
    )


_PERSON = f"(contains(q, 'full name') OR {D.holds('q', (('name',), R.IDENTITY_HINT))})"
_HINTS = [(n, D.holds("q", g)) for n, g in R.RISK_HINTS]
_HINTS[2:2] = [("entity_identity_risk: split columns", f"{_PERSON} AND split"), ("entity_identity_risk: check source", f"{_PERSON} AND NOT split")]


@query("schema_risk_hints", f"WITH r AS (SELECT *, lower(question) AS q, difficulty = 'hard' AS split FROM mixed_questions) SELECT task_id, array_to_string({D.names_of(_HINTS)}, '|') AS risk_hints FROM r", _Q)
def schema_risk_hints(t: Tables):
    out = C.schema_risk_hints(t.mixed_questions, "question", F.col("difficulty") == "hard")
    return out.select("task_id", F.array_join("risk_hints", "|").alias("risk_hints"))


fx.define("answer_shapes", """
SELECT task_id, question, 1 + task_id % 3 AS width, task_id % 3 AS data_rows, CASE WHEN task_id % 3 = 0 THEN 0 ELSE 4 END AS text_cells, task_id % 2 AS numeric_cells,
 CASE task_id % 4 WHEN 0 THEN '3 - 1' WHEN 1 THEN '12.5 %' ELSE 'x' END AS first_cell, CASE task_id % 5 WHEN 0 THEN 'Full_Name,x' WHEN 1 THEN 'id,name' ELSE 'trans_id,total,event_name' END AS headers
FROM mixed_questions""", ("mixed_questions",))


def triggers(t: Tables):
    rows = t.answer_shapes.withColumn("headers", F.split("headers", ","))
    keep = N.keep_column_choice(rows, "question", "headers")
    return C.repair_triggers(keep.withColumn("keep_column", F.coalesce("keep_single", "keep_tally")), "question")


def _trigger_sql() -> str:
    from questloom.plans.q_answers import keep_column_sql

    words = lambda ws: f"regexp_matches(q, '\\b({'|'.join(ws)})\\b')"
    acts = [
        ("recompute_numeric", 30, True, f"{words(R.NUMERIC_WORDS)} AND text_cells > 0 AND numeric_cells = 0"),
        ("regenerate_comparison", 31, True, f"{words(R.COMPARE_WORDS)} AND data_rows = 0"),
        ("split_full_name", 12, False, "contains(q, 'full name') AND list_has_any(cols, ['full_name', 'full name', 'name'])"),
        ("prune_redundant_columns", 14, False, "coalesce(keep_single, keep_tally) IS NOT NULL"),
        ("split_final_score", 12, False, "contains(q, 'final score') AND width = 1 AND data_rows >= 1 AND regexp_matches(first_cell, '^\\d+\\s*[-:]\\s*\\d+$')"),
        ("strip_percent_symbol", 12, False, f"{D.any_contains('q', ('percentage', 'percent', 'how much faster'))} AND width = 1 AND data_rows = 1 AND regexp_matches(first_cell, '^[-+]?\\d+(?:\\.\\d+)?\\s*%$')"),
    ] + [(n, p, False, D.holds("q", g)) for n, p, g in R.WORD_TRIGGERS]
    parts = " UNION ALL ".join(f"SELECT task_id, {p} AS priority, '{n}' AS action_type, {str(b).upper()} AS blocking FROM a WHERE {c}" for n, p, b, c in acts)
    return f"""k AS ({keep_column_sql('answer_shapes')}), a AS (SELECT s.*, lower(s.question) AS q, list_transform(string_split(s.headers, ','), lambda c: lower(trim(c))) AS cols, k.keep_single, k.keep_tally FROM answer_shapes s JOIN k ON k.task_id = s.task_id),
trig AS ({parts})"""


TRIGGER_SQL = _trigger_sql()


@query("repair_triggers", f"WITH {TRIGGER_SQL} SELECT task_id, CAST(priority AS INT) AS priority, action_type, blocking FROM trig", ["answer_shapes"])
def repair_triggers(t: Tables):
    return triggers(t)

