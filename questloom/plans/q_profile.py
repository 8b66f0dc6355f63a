"""Profiling and schema discovery."""

from __future__ import annotations

from pyspark.sql import functions as F

from questloom.operators import profile as P
from questloom.plans import duck as D
from questloom.plans import fixtures as fx
from questloom.plans.registry import Tables, query
from questloom.rules import profile as R

fx.define("all_docs", """SELECT doc_id, text FROM narratives UNION ALL SELECT -1 - doc_id, text FROM documents""", ("narratives", "documents"))

fx.define("task_columns", """
SELECT c_custkey AS task_id, 'csv__orders' AS table_name, 0 AS table_order, 'OrderID' AS column_name, 0 AS ordinal, 'BIGINT' AS type_name FROM customer
UNION ALL SELECT c_custkey, 'csv__orders', 0, 'CustomerID', 1, 'BIGINT' FROM customer
UNION ALL SELECT c_custkey, 'csv__orders', 0, 'Price', 2, 'DOUBLE' FROM customer WHERE c_nationkey % 3 <> 1
UNION ALL SELECT c_custkey, 'csv__orders', 0, 'YearMonth', 3, 'VARCHAR' FROM customer
UNION ALL SELECT c_custkey, 'db_customers', 1, 'customerid', 0, 'BIGINT' FROM customer
UNION ALL SELECT c_custkey, 'db_customers', 1, 'Segment', 1, 'VARCHAR' FROM customer
UNION ALL SELECT c_custkey, 'db_customers', 1, 'orderid', 2, 'BIGINT' FROM customer WHERE c_nationkey % 2 = 0
UNION ALL SELECT c_custkey, 'json_prices', 2, 'price', 0, 'DECIMAL(10,2)' FROM customer WHERE c_mktsegment <> 'BUILDING'
UNION ALL SELECT c_custkey, 'json_prices', 2, 'total amount', 1, 'INTEGER' FROM customer
UNION ALL SELECT c_custkey, 'json_prices', 2, 'updated_date', 2, 'DATE' FROM customer""", ("customer",))


def _col(name: str, text: str, number: str, i: int, table: str, missing: str | None = None) -> str:
    missing = missing or f"{name} IS NULL OR {D.trimmed(text)} = ''"
    return f"""SELECT {i}::BIGINT AS ordinal, '{name}' AS "column", count(*) FILTER ({missing}) AS missing_count,
round(count(*) FILTER ({missing}) / count(*), 3) AS missing_rate, count({number}) AS numeric_count, round(min({number}), 4) AS min, round(max({number}), 4) AS max, round(avg({number}), 4) AS avg FROM {table}"""


@query("profile_columns", " UNION ALL ".join([
    _col("task_id", "CAST(task_id AS VARCHAR)", "CAST(task_id AS DOUBLE)", 0, "messy_cells"),
    _col("row_idx", "CAST(row_idx AS VARCHAR)", "CAST(row_idx AS DOUBLE)", 1, "messy_cells"),
    _col("v", "v", D.num("v"), 2, "messy_cells"),
]), ["messy_cells"])
def profile_columns(t: Tables):
    return P.profile_columns(t.messy_cells)


_FACT = {
    **{n: f"CAST({n} AS DOUBLE)" for n in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")},
    **{n: D.num(f"CAST({n} AS VARCHAR)") for n in ("l_returnflag", "l_linestatus", "l_shipdate")},
}


@query("profile_columns_fact", " UNION ALL ".join(_col(n, f"CAST({n} AS VARCHAR)", x, i, "lineitem") for i, (n, x) in enumerate(_FACT.items())))
def profile_columns_fact(t: Tables):
    return P.profile_columns(t.lineitem)


_ALL = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)
_COUNTS = " UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS row_count FROM {n}" for n in _ALL)


def _tables(t: Tables):
    return {n: getattr(t, n) for n in _ALL}


@query("profile_row_counts", _COUNTS)
def profile_row_counts(t: Tables):
    return P.row_counts(_tables(t))


_ORDER_COLUMNS = ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")


@query("profile_samples", f"""WITH h AS (SELECT row_number() OVER (ORDER BY o_orderkey) AS row_no, * FROM (SELECT * FROM orders ORDER BY o_orderkey LIMIT 5))
SELECT CAST(row_no AS INT) AS row_no, c."column", CASE c."column" {" ".join(f"WHEN '{x}' THEN CAST({x} AS VARCHAR)" for x in _ORDER_COLUMNS)} END AS value
FROM h, (SELECT unnest({list(_ORDER_COLUMNS)}) AS "column") c""")
def profile_samples(t: Tables):
    return P.sample_values(t.orders, ["o_orderkey"])


@query("json_key_paths", """WITH n AS (SELECT t.fullkey, t.type, t.value FROM mixed_json, json_tree(v) t WHERE NOT regexp_matches(t.fullkey, '\\[[1-9]\\d*\\]')),
p AS (SELECT replace(fullkey, '"', '') AS f, type, value FROM n),
e AS (SELECT f AS path FROM p WHERE f <> '$' AND NOT f LIKE '%]' UNION ALL SELECT f || ' (value)' FROM p WHERE f <> '$' AND NOT f LIKE '%]' AND type NOT IN ('OBJECT', 'ARRAY')
UNION ALL SELECT f || '[0..' || (json_array_length(value) - 1) || ']' FROM p WHERE type = 'ARRAY')
SELECT path, count(*) AS documents FROM e GROUP BY path""", ["mixed_json"])
def json_key_paths(t: Tables):
    return P.json_key_paths(t.mixed_json, "v")


@query("json_depth", """SELECT id, v, CAST(max(length(fullkey) - length(regexp_replace(fullkey, '[.\\[]', '', 'g')) + 1) AS INT) AS depth
FROM (SELECT m.id, m.v, replace(t.fullkey, '"', '') AS fullkey FROM (SELECT DISTINCT id, v FROM mixed_json) m, json_tree(m.v) t) GROUP BY id, v""", ["mixed_json"])
def json_depth(t: Tables):
    return t.mixed_json.select("id", "v").distinct().withColumn("depth", P.json_depth(F.col("v")))


@query("json_common_keys", """WITH k AS (SELECT unnest(json_keys(v)) AS key FROM json_wrapped), n AS (SELECT count(*) AS c FROM json_wrapped)
SELECT key FROM k GROUP BY key HAVING count(*) = (SELECT c FROM n)""", ["json_wrapped"])
def json_common_keys(t: Tables):
    return P.json_common_keys(t.json_wrapped, "v")


@query("json_wrapper_detect", """SELECT id, v, CASE WHEN json_type(v, '$.records') = 'ARRAY' THEN coalesce(json_extract_string(v, '$.table'), 'file_' || id)
WHEN json_type(v, '$[0].records') = 'ARRAY' THEN coalesce(json_extract_string(v, '$[0].table'), 'file_' || id) END AS records_table,
CASE WHEN regexp_matches(substr(v, 1, 20000), '"records"\\s*:') THEN NULLIF(regexp_extract(substr(v, 1, 20000), '"table"\\s*:\\s*"([^"]+)"', 1), '') END AS records_table_by_head FROM mixed_json""", ["mixed_json"])
def json_wrapper_detect(t: Tables):
    return P.json_wrapper(t.mixed_json, "v", F.concat(F.lit("file_"), F.col("id").cast("string")))


_TYPES = "CASE data_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'VARCHAR' THEN 'string' WHEN 'DOUBLE' THEN 'double' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' WHEN 'FLOAT[]' THEN 'array<float>' ELSE data_type END"


@query("catalog_profile", f"""WITH n AS ({_COUNTS}) SELECT c.table_name, c.column_name, CAST(c.column_index - 1 AS INT) AS ordinal, {_TYPES} AS type_name, c.is_nullable AS nullable, n.row_count
FROM duckdb_columns() c JOIN n ON n.table_name = c.table_name WHERE NOT c.internal""")
def catalog_profile(t: Tables):
    return P.table_catalogue(t.spark, _tables(t))


_BLOCKS = f"list_filter(string_split(text, chr(10) || chr(10)), lambda p: {D.trimmed('p')} <> '')"


@query("doc_profile", f"SELECT doc_id, CAST(length(text) AS INT) AS size_chars, CAST(len({_BLOCKS}) AS INT) AS paragraph_count, substr(text, 1, 3000) AS preview FROM all_docs", ["all_docs"])
def doc_profile(t: Tables):
    return P.doc_profile(t.all_docs, "doc_id", "text")


@query("doc_headings", f"""WITH h AS (SELECT doc_id, (list_filter(list_transform(string_split(text, chr(10)), lambda x: {D.trimmed('x')}), lambda x: starts_with(x, '#'))) AS l FROM all_docs)
SELECT doc_id, CAST(generate_subscripts(l, 1) - 1 AS INT) AS heading_index, unnest(l) AS heading FROM h""", ["all_docs"])
def doc_headings(t: Tables):
    return P.doc_headings(t.all_docs, "doc_id", "text")


@query("doc_terms", f"""WITH w AS (SELECT doc_id, list_transform(regexp_split_to_array(text, '\\s+'), lambda x: replace(trim(x, '.,;:()[]{{}}''"!?'), '-', '_')) AS l FROM all_docs),
k AS (SELECT doc_id, (list_sort(list_distinct(list_filter(l, lambda x: regexp_matches(x, '^\\p{{Lu}}.') AND length(x) > 1)))) AS l FROM w)
SELECT doc_id, CAST(generate_subscripts(l, 1) - 1 AS INT) AS term_index, unnest(l) AS term FROM k""", ["all_docs"])
def doc_terms(t: Tables):
    return P.doc_terms(t.all_docs, "doc_id", "text")


def _duck_ranges() -> str:
    def pair(p: str, prefix: str) -> str:
        a, b = (f"CAST(regexp_extract(m, '{p}', {g}) AS DOUBLE)" for g in (2, 3))
        return (
            f"list_transform(regexp_extract_all(text, '{p}', 0), lambda m: {{'label': '{prefix}' || lower(trim(regexp_extract(m, '{p}', 1))),"
            f" 'lo': least({a}, {b}), 'hi': greatest({a}, {b}), 'op': '', 'val': NULL::DOUBLE}})"
        )

    c = R.RANGE_COMPARE
    limits = (
        f"list_transform(regexp_extract_all(text, '{c}', 0), lambda m: {{'label': lower(trim(regexp_extract(m, '{c}', 1))), 'lo': NULL::DOUBLE, 'hi': NULL::DOUBLE,"
        f" 'op': regexp_extract(m, '{c}', 2), 'val': CAST(regexp_extract(m, '{c}', 3) AS DOUBLE)}})"
    )
    return f"""WITH r AS (SELECT doc_id, {pair(R.RANGE_BETWEEN, '')} AS a, {limits} AS b, {pair(R.RANGE_NORMAL, 'normal ')} AS c FROM all_docs),
u AS (SELECT doc_id, a, unnest(list_concat(a, b, c)) AS x, generate_subscripts(list_concat(a, b, c), 1) AS i FROM r),
d AS (SELECT doc_id, x, min(i) AS i, bool_or(list_contains(a, x)) AS plain FROM u GROUP BY doc_id, x),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS range_index FROM d)
SELECT doc_id, CAST(range_index AS INT) AS range_index, CASE WHEN x.op LIKE '>%' THEN 'gt' WHEN x.op <> '' THEN 'lt' WHEN plain THEN 'range' ELSE 'normal_range' END AS type,
x.label AS label, x.lo AS lo, x.hi AS hi, x.op AS op, x.val AS val FROM k"""


fx.define("range_docs", """SELECT doc_id, text FROM all_docs
UNION ALL SELECT 1000000000 + p_partkey, 'Normal size range: ' || CAST(p_size AS STRING) || '-' || CAST(p_size + 5 AS STRING) || chr(10) || 'retail price >= ' || CAST(p_size AS STRING) || '.5 and weight < 7. The size is 9 to ' || CAST(p_size AS STRING) FROM part""", ("all_docs", "part"), ("part",))


@query("doc_numeric_ranges", _duck_ranges().replace("FROM all_docs", "FROM range_docs"), ["range_docs"])
def doc_numeric_ranges(t: Tables):
    return P.doc_ranges(t.range_docs, "doc_id", "text")


@query("profile_context", f"""WITH n AS ({_COUNTS}), w AS (SELECT table_name, count(*) AS c FROM duckdb_columns() WHERE NOT internal GROUP BY 1)
SELECT 'table' AS type, n.table_name AS path, 'Table ''' || n.table_name || ''': ' || w.c || ' cols x ' || n.row_count || ' rows (view: ' || n.table_name || ')' AS summary FROM n JOIN w ON n.table_name = w.table_name
UNION ALL SELECT 'doc', CAST(doc_id AS VARCHAR), 'Doc ''' || doc_id || ''': ' || length(text) || ' chars, ' || len({_BLOCKS}) || ' paragraphs' FROM all_docs""", ["all_docs"])
def profile_context(t: Tables):
    tables = P.table_catalogue(t.spark, _tables(t)).groupBy("table_name", "row_count").agg(F.count(F.lit(1)).alias("c"))
    a = tables.select(
        F.lit("table").alias("type"), F.col("table_name").alias("path"),
        F.format_string("Table '%s': %d cols x %d rows (view: %s)", "table_name", "c", "row_count", "table_name").alias("summary"),
    )
    d = P.doc_profile(t.all_docs, "doc_id", "text")
    b = d.select(
        F.lit("doc").alias("type"), F.col("doc_id").cast("string").alias("path"),
        F.format_string("Doc '%d': %d chars, %d paragraphs", "doc_id", "size_chars", "paragraph_count").alias("summary"),
    )
    return a.unionByName(b)


@query("schema_terms", """SELECT DISTINCT term FROM (SELECT lower(table_name) AS term FROM task_columns UNION ALL SELECT lower(trim(column_name)) FROM task_columns
UNION ALL SELECT lower(unnest(json_keys(props))) FROM events) WHERE term <> ''""", ["task_columns"])
def schema_terms(t: Tables):
    return P.schema_terms(t.task_columns, t.events, "props")


@query("tables_with_columns", """SELECT task_id, table_name FROM task_columns WHERE lower(trim(column_name)) IN ('orderid', 'customerid') GROUP BY 1, 2 HAVING count(DISTINCT lower(trim(column_name))) = 2""", ["task_columns"])
def tables_with_columns(t: Tables):
    return P.tables_with_columns(t.task_columns, ["task_id"], ["CustomerID", "OrderID"])


@query("join_key_candidates", """SELECT a.task_id, a.column_name AS left_column, b.column_name AS right_column FROM task_columns a JOIN task_columns b ON a.task_id = b.task_id AND lower(a.column_name) = lower(b.column_name)
WHERE a.table_name = 'csv__orders' AND b.table_name = 'db_customers'
QUALIFY row_number() OVER (PARTITION BY a.task_id ORDER BY CASE WHEN lower(a.column_name) LIKE '%id' THEN 0 ELSE 1 END, a.ordinal, b.ordinal) = 1""", ["task_columns"])
def join_key_candidates(t: Tables):
    return P.join_keys(t.task_columns, ["task_id"], "csv__orders", "db_customers")


_NW = "trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'))"


@query("fact_column_choice", f"""WITH c AS (SELECT *, string_split(lower(regexp_replace(column_name, '([a-z])([A-Z])', '\\1_\\2', 'g')), '_') AS tk FROM task_columns),
d AS (SELECT task_id, table_name, arg_min(column_name, ordinal) AS date_column FROM c WHERE regexp_matches(type_name, 'DATE|TIMESTAMP') OR list_has_any(tk, ['date', 'month', 'yearmonth', 'period']) GROUP BY 1, 2),
s AS (SELECT c.task_id, c.table_name, c.column_name AS metric_column, d.date_column, 10 + CASE WHEN c.table_name LIKE 'csv\\_\\_%' ESCAPE '\\' THEN 3 ELSE 0 END AS score, c.table_order, c.ordinal
FROM c JOIN d ON c.task_id = d.task_id AND c.table_name = d.table_name JOIN customer_questions q ON q.task_id = c.task_id
WHERE regexp_matches(c.type_name, 'INT|DOUBLE|FLOAT|DECIMAL|REAL|NUMERIC') AND lower(c.column_name) NOT IN ('id', 'rowid') AND NOT lower(c.column_name) LIKE '%id'
AND contains(' ' || {_NW.format('q.question')} || ' ', ' ' || {_NW.format('c.column_name')} || ' '))
SELECT task_id, table_name, metric_column, date_column, CAST(score AS INT) AS score FROM s QUALIFY row_number() OVER (PARTITION BY task_id ORDER BY score DESC, table_order, ordinal) = 1""", ["task_columns", "customer_questions"])
def fact_column_choice(t: Tables):
    return P.fact_columns(t.task_columns, t.customer_questions.select("task_id", "question"), ["task_id"])


#: Every text column of the catalogue: table, its order, column, its place.
_VALUES = tuple(
    (table, order, column, place)
    for order, (table, columns) in enumerate((
        ("region", {"r_name": 1}), ("nation", {"n_name": 1}), ("customer", {"c_name": 1, "c_mktsegment": 4}), ("supplier", {"s_name": 1}),
        ("part", {"p_name": 1, "p_brand": 2, "p_type": 3}), ("orders", {"o_orderstatus": 2, "o_orderpriority": 5}),
        ("lineitem", {"l_returnflag": 8, "l_linestatus": 9}), ("events", {"event_type": 3, "props": 5}),
        ("documents", {"text": 1, "lang": 2, "source": 3}), ("pages", {"url": 1, "html": 2}), ("benchmark", {"text": 1}),
        ("conversations", {"role": 2, "text": 3}),
    ))
    for column, place in columns.items()
)


@query("filter_value_discovery", "WITH v AS (" + " UNION ALL ".join(
    f"SELECT DISTINCT '{a}' AS table_name, {b} AS table_order, '{c}' AS column_name, {d} AS ordinal, trim({c}) AS value FROM {a}" for a, b, c, d in _VALUES) + f"""),
long AS (SELECT max(length(question)) AS m FROM customer_questions),
v0 AS (SELECT *, {_NW.format('value')} AS nv FROM v WHERE length(value) <= 4 * (SELECT m FROM long)),
qs AS (SELECT DISTINCT question FROM customer_questions),
m AS (SELECT question, nv FROM qs JOIN (SELECT DISTINCT nv FROM v0 WHERE nv <> '') ON contains(' ' || {_NW.format('question')} || ' ', ' ' || nv || ' ')),
h AS (SELECT q.task_id, v.*, 10 + CASE WHEN table_name <> 'orders' THEN 2 ELSE 0 END + CASE WHEN regexp_replace(column_name, '^.*_', '') IN ('segment', 'category', 'type', 'status') THEN 3 ELSE 0 END AS score
FROM customer_questions q JOIN m ON m.question = q.question JOIN v0 v ON v.nv = m.nv)
SELECT task_id, table_name, column_name, value, CAST(score AS INT) AS score FROM h QUALIFY row_number() OVER (PARTITION BY task_id ORDER BY score DESC, table_order, ordinal, value) = 1""", ["customer_questions"])
def filter_value_discovery(t: Tables):
    questions = t.customer_questions
    tables = {a: t.load(a) for a, *_ in _VALUES}
    d = P.value_dictionary([(a, b, c, o, tables[a]) for a, b, c, o in _VALUES], P.longest_question(questions))
    return P.filter_values(d, questions, "task_id", "orders")


# Terms and their forms.
_TERMS = {
    "Price": ["price"], "total amount": ["total amount", "totalamount", "ta"], "year month": ["year month", "yearmonth", "ym"],
    "white blood cells": ["white blood cells", "whitebloodcells", "whitebloodcell", "wbc"],
}


@query("term_column_match", f"""WITH v AS (SELECT *, list_distinct([regexp_replace(lower(column_name), '[^a-z0-9]+', '', 'g'), lower(column_name),
CASE WHEN len(regexp_extract_all(column_name, '[A-Za-z]+')) > 1 THEN lower(array_to_string(list_transform(regexp_extract_all(column_name, '[A-Za-z]+'), lambda p: p[1]), '')) ELSE '' END]) AS vs FROM task_columns),
m AS (SELECT *, list_filter([{', '.join(f"CASE WHEN list_has_any(vs, {forms}) THEN '{x}' END" for x, forms in _TERMS.items())}], lambda x: x IS NOT NULL) AS ts FROM v)
SELECT task_id, table_name, column_name, array_to_string(ts, '|') AS matched_terms FROM m WHERE len(ts) > 0""", ["task_columns"])
def term_column_match(t: Tables):
    return P.match_terms(t.task_columns, list(_TERMS)).select(
        "task_id", "table_name", "column_name", F.array_join("matched_terms", "|").alias("matched_terms")
    )
