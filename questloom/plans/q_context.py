"""One profile over CSV files, JSON, documents, pages and tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from questloom.operators import context as X
from questloom.operators import profile as P
from questloom.plans import duck as D
from questloom.plans import fixtures as fx
from questloom.plans.q_sources import doc_pages, scratch
from questloom.plans.registry import Tables, query
from questloom.sources import files as S
from questloom.sources import pages as PG

# Every document stands for one JSON file: wrapped records, a list, an object, broken text.
fx.define("json_docs", """
SELECT 'json/order-' || CAST(o_orderkey AS STRING) || '.json' AS path, '{"table":"orders","records":[{"id":' || CAST(o_orderkey AS STRING) || ',"status":"' || o_orderstatus || '"},{"id":' || CAST(o_orderkey + 1 AS STRING) || ',"status":null}]}' AS v FROM orders
UNION ALL SELECT 'json/customer-' || CAST(c_custkey AS STRING) || '.json', '[{"id":' || CAST(c_custkey AS STRING) || ',"status":"L"},7,"x"]' FROM customer
UNION ALL SELECT 'json/' || CAST(s_suppkey AS STRING) || '.json', '{"name":"' || s_name || '","tags":["a","b"],"at":{"nation":' || CAST(s_nationkey AS STRING) || '}}' FROM supplier
UNION ALL SELECT 'json/part-' || CAST(p_partkey AS STRING) || '.json', '{"name":' FROM part""", ("orders", "customer", "supplier", "part"), ("orders", "customer"))

#: Tables whose cells read the same as text on both engines, with their columns.
_TABLES = {
    "region": ("r_regionkey", "r_name"), "nation": ("n_nationkey", "n_name", "n_regionkey"),
    "customer": ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"),
    "supplier": ("s_suppkey", "s_name", "s_nationkey", "s_acctbal"),
    "part": ("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"),
    "orders": ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"),
    "lineitem": ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"),
    "documents": ("doc_id", "text", "lang", "source", "n_chars"), "labels": ("doc_id", "quality", "toxic"),
    "benchmark": ("item_id", "text"), "conversations": ("conv_id", "turn", "role", "text"),
}
_CSV = (
    ("customer", "c_mktsegment", {n: n for n in ("c_custkey", "c_name", "c_nationkey", "c_acctbal")}),
    ("orders", "o_orderstatus", {
        "o_orderkey": "o_orderkey", "o_totalprice": "o_totalprice", "o_orderdate": "o_orderdate",
        "day": "concat(month(o_orderdate), '/', day(o_orderdate), '/', year(o_orderdate))",
        "flag": "CASE WHEN o_orderkey % 5 = 0 THEN '' WHEN o_orderkey % 2 = 0 THEN 'true' ELSE 'False' END",
        "mixed": "CASE WHEN o_orderkey % 97 = 0 THEN 'n/a' ELSE CAST(o_orderkey AS STRING) END",
    }),
)


def _written(t: Tables) -> str:
    """Two tables as CSV folders by a key, like the files of a context."""
    root = scratch(t, "context")
    for table, by, columns in _CSV:
        rows = getattr(t, table).select(by, *[F.expr(x).alias(n) for n, x in columns.items()])
        S.write_answer_csv(rows, f"{root}/csv/{table}", by=[by])
    return root


def _csv_oracle() -> str:
    """The same cells in SQL. Dates are written with their time of day."""
    def text(x: str) -> str:
        return "strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.000')" if x == "o_orderdate" else f"CAST({x} AS VARCHAR)"

    return " UNION ALL ".join(
        f"SELECT 'csv/{table}/{by}=' || {by} AS path, 'csv' AS type, {i} AS ordinal, '{n}' AS \"column\", {text(x)} AS value FROM {table}"
        for table, by, columns in _CSV for i, (n, x) in enumerate(columns.items())
    )


_TABLE_CELLS = " UNION ALL ".join(
    f"SELECT '{table}', 'table', {i}, '{c}', CAST({c} AS VARCHAR) FROM {table}" for table, columns in _TABLES.items() for i, c in enumerate(columns)
)
_JSON_CELLS = """SELECT j.path, 'json', 0, e.key, e.value ->> '$' FROM (
SELECT path, unnest(list_filter(CASE WHEN json_type(o, '$.records') = 'ARRAY' THEN json_extract(o, '$.records[*]') WHEN json_type(o) = 'ARRAY' THEN json_extract(o, '$[*]') ELSE [o] END, lambda x: json_type(x) = 'OBJECT')) AS o
FROM (SELECT path, CASE WHEN json_valid(v) THEN v::JSON END AS o FROM json_docs) WHERE o IS NOT NULL) j, json_each(j.o) e"""
_DOC_CELLS = "SELECT CAST(doc_id AS VARCHAR), 'doc', 0, 'text', text FROM narratives"


def _states(cells: str) -> str:
    x = D.num("value")
    blank = f"(value IS NULL OR {D.trimmed('value')} = '')"
    return f"""WITH k(path, type, ordinal, "column", value) AS ({cells}),
s AS (SELECT path, type, "column", min(ordinal) AS ordinal, count(*) AS rows, count(*) FILTER ({blank}) AS missing, count(DISTINCT CASE WHEN NOT {blank} THEN value END) AS distinct_count,
 count({x}) AS numeric_count, round(min({x}), 4) AS lo, round(max({x}), 4) AS hi FROM k GROUP BY 1, 2, 3),
m AS (SELECT path, type, "column", value AS common FROM (SELECT path, type, "column", value, count(*) AS n FROM k WHERE NOT {blank} GROUP BY ALL)
 QUALIFY row_number() OVER (PARTITION BY path, type, "column" ORDER BY n DESC, value) = 1)
SELECT s.path, s.type, s."column", s.rows, s.missing, s.distinct_count, s.numeric_count, s.lo, s.hi, CASE WHEN s.numeric_count <> s.rows - s.missing THEN m.common END AS common,
 s.missing = 0 AND s.distinct_count = s.rows AS is_key, s.distinct_count = 1 AS constant
FROM s LEFT JOIN m ON m.path = s.path AND m.type = s.type AND m."column" = s."column\""""


@query("context_columns", _states(f"{_csv_oracle()} UNION ALL {_JSON_CELLS} UNION ALL {_DOC_CELLS} UNION ALL {_TABLE_CELLS}"), ["json_docs", "narratives"])
def context_columns(t: Tables):
    """State of every column of every source, whatever its kind."""
    cells = X.all_cells([
        X.csv_cells(t.spark, _written(t)), X.json_cells(t.json_docs, "path", "v"), X.document_cells(t.narratives, "doc_id", "text"),
        X.table_counts({n: getattr(t, n) for n in _TABLES}),
    ])
    return X.column_states(cells).drop("ordinal")


@query("csv_type_votes", f"""WITH k AS ({_csv_oracle()}),
t(col, type_name, form) AS (VALUES ('c_custkey', 'bigint', ''), ('c_name', 'string', ''), ('c_nationkey', 'bigint', ''), ('c_acctbal', 'double', ''), ('o_orderkey', 'bigint', ''),
 ('o_totalprice', 'double', ''), ('o_orderdate', 'timestamp_ntz', 'iso'), ('day', 'date', 'month/day'), ('flag', 'boolean', ''), ('mixed', 'string', ''))
SELECT path, "column", ordinal, type_name, form, CAST(0 AS BIGINT) AS misfits FROM (SELECT DISTINCT path, "column", ordinal FROM k) JOIN t ON t.col = "column\"""")
def csv_type_votes(t: Tables):
    """Types of all columns of all CSV sources in one job."""
    return X.type_votes(X.csv_cells(t.spark, _written(t)))


@query("scan_csv_voted", """SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, CAST(o_orderdate AS DATE) AS day,
o_orderkey % 2 = 0 AS flag, CASE WHEN o_orderkey % 97 <> 0 THEN o_orderkey END AS number FROM orders""")
def scan_csv_voted(t: Tables):
    """Dates of two spellings, booleans and numbers with a few bad cells come back typed."""
    folder = scratch(t, "csv")
    key = F.col("o_orderkey")
    S.write_answer_csv(t.orders.select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate",
        F.date_format("o_orderdate", "d.M.yyyy").alias("day"), (key % 2 == 0).alias("flag"),
        F.when(key % 97 == 0, F.lit("n/a")).otherwise(key.cast("string")).alias("number"),
    ), folder)
    return X.scan_csv_voted(t.spark, folder, share=0.9)


_VIEW = "trim(regexp_replace(lower(regexp_replace(regexp_replace({}, '\\.[^./]+$', ''), '/+', '__', 'g')), '\\W+', '_', 'g'), '_')"
_STEM = "regexp_replace(regexp_replace(path, '^.*/', ''), '\\.[^.]+$', '')"


@query("context_sources", f"""WITH c AS ({_csv_oracle()}), cs AS (SELECT path, count(DISTINCT "column") AS w, count(*) FILTER (ordinal = 0) AS n FROM c GROUP BY path),
j AS (SELECT path, v, json_valid(v) AS ok, CASE WHEN json_valid(v) THEN v::JSON END AS o FROM json_docs),
jd AS (SELECT j.path, max(length(f) - length(regexp_replace(f, '[.\\[]', '', 'g')) + 1) AS depth FROM (SELECT j.path, replace(t.fullkey, '"', '') AS f FROM j, json_tree(j.o) t WHERE j.ok) j GROUP BY 1),
js AS (SELECT j.path, CASE json_type(o) WHEN 'OBJECT' THEN 'dict' WHEN 'ARRAY' THEN 'list' ELSE 'invalid' END AS top, coalesce(jd.depth, 0) AS depth,
 CASE WHEN json_type(o, '$.records') = 'ARRAY' THEN coalesce(o ->> '$.table', {_STEM.replace('path', 'j.path')}) END AS r, {_VIEW.format('j.path')} AS b FROM j LEFT JOIN jd ON jd.path = j.path),
jv AS (SELECT *, CASE WHEN regexp_matches(b, '^\\d') THEN 't_' || b ELSE b END || CASE WHEN r IS NOT NULL THEN '_records' ELSE '' END AS view FROM js),
p AS (SELECT doc_id, generate_subscripts(l, 1) AS page_no, unnest(l) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))
SELECT path, 'csv' AS type, {_VIEW.format("path || '.csv'")} AS view, 'CSV ''' || path || ''': ' || w || ' cols x ' || n || ' rows (view: ' || {_VIEW.format("path || '.csv'")} || ')' AS summary FROM cs
UNION ALL SELECT path, 'json', view, 'JSON ''' || path || ''': ' || top || ', depth ' || depth || CASE WHEN r IS NOT NULL THEN ', records table: ' || r ELSE '' END || ' (view: ' || view || ')' FROM jv
UNION ALL SELECT CAST(doc_id AS VARCHAR), 'doc', NULL, 'Doc ''' || doc_id || ''': ' || length(text) || ' chars, ' || len(list_filter(string_split(text, chr(10) || chr(10)), lambda p: {D.trimmed('p')} <> '')) || ' paragraphs' FROM narratives
UNION ALL SELECT CAST(doc_id AS VARCHAR), 'pages', NULL, 'Pages ''' || doc_id || ''': ' || count(*) || ' pages, ' || CAST(sum(CASE WHEN page_no <= 3 THEN len(regexp_extract_all(text, ',')) ELSE 0 END) AS BIGINT) || ' tables estimated' FROM p GROUP BY doc_id
UNION ALL {' UNION ALL '.join(f"SELECT '{n}', 'table', '{n}', 'Table ''{n}'': {len(c)} cols x ' || count(*) || ' rows (view: {n})' FROM {n}" for n, c in _TABLES.items())}""", ["json_docs", "narratives"])
def context_sources(t: Tables):
    """One line per source of a mixed context, dispatched by kind."""
    csv = X.csv_sources(t.spark, _written(t))
    docs = P.doc_profile(t.narratives, "doc_id", "text").select(
        F.col("doc_id").cast("string").alias("path"), F.lit("doc").alias("type"), F.lit(None).cast("string").alias("view"),
        F.format_string("Doc '%d': %d chars, %d paragraphs", "doc_id", "size_chars", "paragraph_count").alias("summary"),
    )
    pages = PG.profile(doc_pages(t).withColumn("n_tables", F.size(F.regexp_extract_all("text", F.lit(","), F.lit(0)))), "doc_id", "n_tables").select(
        F.col("doc_id").cast("string").alias("path"), F.lit("pages").alias("type"), F.lit(None).cast("string").alias("view"),
        F.format_string("Pages '%d': %d pages, %d tables estimated", "doc_id", "page_count", "table_count_estimate").alias("summary"),
    )
    tables = {n: getattr(t, n) for n in _TABLES}
    widths = F.create_map(*[F.lit(x) for n, df in tables.items() for x in (n, len(df.columns))])
    counts = P.row_counts(tables).select(
        F.col("table_name").alias("path"), F.lit("table").alias("type"), F.col("table_name").alias("view"),
        F.format_string("Table '%s': %d cols x %d rows (view: %s)", "table_name", widths[F.col("table_name")], "row_count", "table_name").alias("summary"),
    )
    return csv.unionByName(X.json_sources(t.json_docs, "path", "v")).unionByName(docs).unionByName(pages).unionByName(counts)


@query("context_hints", f"""WITH c AS ({_csv_oracle()})
SELECT path, 'csv' AS type, string_agg("column", '|' ORDER BY ordinal) AS hint FROM (SELECT DISTINCT path, "column", ordinal FROM c) GROUP BY path
UNION ALL SELECT path, 'json', CASE WHEN json_valid(v) AND starts_with(v, '{{') THEN array_to_string(json_keys(CASE WHEN json_valid(v) THEN v END), '|') ELSE '' END FROM json_docs
UNION ALL SELECT CAST(doc_id AS VARCHAR), 'doc', substr(text, 1, 500) FROM documents
UNION ALL {' UNION ALL '.join(f"SELECT '{n}', 'table', '{'|'.join(c)}'" for n, c in _TABLES.items())}""", ["json_docs"])
def context_hints(t: Tables):
    """Header, columns, top keys or preview of each source."""
    tables = t.spark.createDataFrame(
        [(n, "table", i, f) for n in _TABLES for i, f in enumerate(getattr(t, n).columns)], "path string, type string, ordinal int, column string"
    )
    csv = X.csv_cells(t.spark, _written(t)).drop("value")
    return X.column_hints(csv.unionByName(tables)).unionByName(X.json_hints(t.json_docs, "path", "v")).unionByName(
        X.document_hints(t.documents, "doc_id", "text")
    )


_KEYS = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey"}


@query("catalog_samples", " UNION ALL ".join(
    f"SELECT '{n}' AS table_name, CAST(row_no AS INT) AS row_no, '{c}' AS \"column\", CAST({c} AS VARCHAR) AS value FROM (SELECT row_number() OVER (ORDER BY {k}) AS row_no, * FROM {n} ORDER BY {k} LIMIT 3)"
    for n, k in _KEYS.items() for c in _TABLES[n]))
def catalog_samples(t: Tables):
    """The first three rows of each table by its key, all columns."""
    parts = [P.sample_values(getattr(t, n), [k], 3).select(F.lit(n).alias("table_name"), "row_no", "column", "value") for n, k in _KEYS.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
