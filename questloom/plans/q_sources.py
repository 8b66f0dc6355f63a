"""Sources, scans and sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from questloom.operators import context as X
from questloom.plans import duck as D
from questloom.plans import fixtures as fx
from questloom.plans.registry import Tables, query
from questloom.session import shared_folder
from questloom.sources import files as S
from questloom.sources import pages as P
from questloom.sources import tables as TB
from questloom.sources import tasks as K


def scratch(t: Tables, name: str) -> str:
    """A new folder below the shared folder, so every executor can reach it."""
    return f"{shared_folder(t.spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


fx.define("mixed_json", """
SELECT id, v FROM json_wrapped
UNION ALL SELECT c_custkey, '[{"id":' || CAST(c_custkey AS STRING) || ',"status":"L"},7,"x"]' FROM customer
UNION ALL SELECT s_suppkey, '{"other":1}' FROM supplier
UNION ALL SELECT -1, repeat('{"k":', 200) || '"' || repeat('x', 20000) || '"' || repeat('}', 200)""", ("json_wrapped", "customer", "supplier"), ("customer",))

fx.define("context_files", """
SELECT c_custkey AS task_id, 'csv/' || c_mktsegment || '-' || CAST(c_nationkey AS STRING) || '.csv' AS path FROM customer
UNION ALL SELECT c_custkey, 'csv/' || c_mktsegment || ' ' || CAST(c_nationkey AS STRING) || '.csv' FROM customer
UNION ALL SELECT c_custkey, CAST(c_nationkey AS STRING) || 'data.v2.json' FROM customer
UNION ALL SELECT c_custkey, '___.md' FROM customer WHERE c_nationkey % 2 = 0""", ("customer",))

fx.define("task_json", """
SELECT 'task_' || CAST(task_id AS STRING) AS folder,
 CASE task_id % 6 WHEN 1 THEN '{"task_id":"task_' || CAST(task_id AS STRING) || '","difficulty":"easy"}'
  WHEN 2 THEN '{"task_id":"task_x","difficulty":"easy","question":"q"}' WHEN 3 THEN 'not json'
  ELSE '{"task_id":"task_' || CAST(task_id AS STRING) || '","difficulty":"' || difficulty || '","question":"' || replace(question, '"', chr(92) || '"') || '"' ||
   CASE WHEN task_id % 6 = 4 THEN ',"extra":1' ELSE '' END || '}' END AS v
FROM customer_questions""", ("customer_questions",))

fx.define("trace_json", """
SELECT o_orderkey AS run_id, '{"task_id":"task_' || CAST(o_custkey AS STRING) || '","succeeded":' || CASE WHEN o_orderstatus = 'F' THEN 'true' ELSE 'false' END ||
 ',"steps":[{"step_index":1,"action":"profile_context","ok":true,"observation":{"rows":3}},{"step_index":2,"action":"execute_data_sql","ok":' ||
 CASE WHEN o_orderpriority = '1-URGENT' THEN 'false' ELSE 'true' END || ',"observation":{}}]}' AS v FROM orders""", ("orders",))


@query("catalog_files", "SELECT DISTINCT 'json' AS kind, 'source=' || source AS folder, 2 AS depth FROM documents")
def catalog_files(t: Tables):
    """The folders of a table written by source, from a catalogue of its files."""
    folder = scratch(t, "context")
    S.write_jsonl(t.documents.select("doc_id", "source"), folder, by=["source"])
    return S.catalogue(t.spark, folder).filter("kind = 'json'").select(
        "kind", F.split_part("path", F.lit("/"), F.lit(1)).alias("folder"), "depth"
    ).distinct()


@query("scan_csv_rejected", "SELECT count(*) AS rejected FROM orders WHERE o_orderkey % 7 = 0")
def scan_csv_rejected(t: Tables):
    """Rows whose number is no number, counted by a typed scan."""
    folder = scratch(t, "csv")
    key = F.col("o_orderkey")
    bad = F.when(key % 7 == 0, F.concat(F.lit("no"), key.cast("string"))).otherwise(key.cast("string"))
    S.write_answer_csv(t.orders.select(bad.alias("o_orderkey"), "o_totalprice"), folder)
    return S.rejected_rows(t.spark, folder, "o_orderkey long, o_totalprice double")


@query("scan_csv_typed", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def scan_csv_typed(t: Tables):
    folder = scratch(t, "csv")
    S.write_answer_csv(t.customer, folder)
    return S.scan_csv(t.spark, folder, "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string")


@query("scan_csv_inferred", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders")
def scan_csv_inferred(t: Tables):
    folder = scratch(t, "csv")
    S.write_answer_csv(t.orders, folder)
    return X.scan_csv_voted(t.spark, folder)


@query("scan_csv_raw", "SELECT CAST(task_id AS VARCHAR) AS task_id, CASE WHEN row_idx % 3 = 0 THEN '' ELSE 'x' END AS mark, trim(v) AS v FROM messy_cells", ["messy_cells"])
def scan_csv_raw(t: Tables):
    folder = scratch(t, "csv")
    rows = t.messy_cells.select(
        "task_id", F.when(F.col("row_idx") % 3 != 0, F.lit("x")).alias("mark"), "v"
    )
    S.write_answer_csv(rows, folder)
    return S.scan_csv_text(t.spark, folder)


@query("scan_json_props", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def scan_json_props(t: Tables):
    return S.parse_json(t.events.select("event_id", "props"), "props").select("event_id", "doc.k")


@query("json_records_flatten", """SELECT j.id AS id, CAST(json_extract(r.value, '$.id') AS BIGINT) AS _rec_id, json_extract_string(r.value, '$.status') AS status
FROM json_wrapped j, json_each(j.v, '$.records') r""", ["json_wrapped"])
def json_records_flatten(t: Tables):
    return S.flatten_records(t.json_wrapped, "v")


@query("json_records_normalise", """WITH l AS (SELECT id, CASE WHEN json_type(v, '$.records') = 'ARRAY' THEN json_extract(v, '$.records') WHEN json_type(v) = 'ARRAY' THEN v::JSON END AS a FROM mixed_json),
k AS (SELECT id, list_filter(json_extract(a, '$[*]'), lambda x: json_type(x) = 'OBJECT') AS items FROM l WHERE a IS NOT NULL)
SELECT id, CAST(generate_subscripts(items, 1) - 1 AS INT) AS item_idx, CAST(unnest(items) AS VARCHAR) AS item FROM k""", ["mixed_json"])
def json_records_normalise(t: Tables):
    return S.normalise_records(t.mixed_json, "v")


@query("register_tables", "SELECT 'shop_orders' AS view_name, count(*) AS n FROM orders UNION ALL SELECT 'shop_customer', count(*) FROM customer")
def register_tables(t: Tables):
    views = TB.register_namespace("shop", {"orders": t.orders, "customer": t.customer})
    parts = [f"SELECT '{v}' AS view_name, count(*) AS n FROM {v}" for _, v in views]
    return t.spark.sql(" UNION ALL ".join(parts))


@query("safe_view_names", """WITH b AS (SELECT task_id, path, lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(path, '\\.[^./]+$', ''), '/+', '__', 'g'), '\\W+', '_', 'g'), '^_+|_+$', '', 'g')) AS n FROM context_files),
c AS (SELECT task_id, path, substr(CASE WHEN n = '' THEN 'table' WHEN regexp_matches(n, '^\\d') THEN 't_' || n ELSE n END, 1, 96) AS n FROM b),
k AS (SELECT *, row_number() OVER (PARTITION BY task_id, n ORDER BY path) AS r FROM c)
SELECT task_id, path, CASE WHEN r = 1 THEN n ELSE n || '_' || r END AS view_name FROM k""", ["context_files"])
def safe_view_names(t: Tables):
    return TB.unique_names(t.context_files, "path", by=["task_id"])


_PARTS = "list_filter(list_transform(string_split(text, chr(10) || chr(10)), lambda p: " + D.trimmed("p") + "), lambda p: p <> '')"


@query("doc_paragraphs", f"""WITH d AS (SELECT doc_id, {_PARTS} AS ps FROM (SELECT doc_id, text FROM narratives UNION ALL SELECT -1 - doc_id, text FROM documents))
SELECT doc_id, CAST(generate_subscripts(ps, 1) - 1 AS INT) AS paragraph_index, unnest(ps) AS paragraph FROM d""", ["narratives"])
def doc_paragraphs(t: Tables):
    docs = t.narratives.union(t.documents.select(-1 - F.col("doc_id"), "text"))
    return S.paragraphs(docs, "text", keep=["doc_id"])


_PAGES = """p AS (SELECT doc_id, generate_subscripts(l, 1) AS page_no, unnest(l) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))"""


def doc_pages(t: Tables):
    return P.split_pages(t.documents.select("doc_id", "text"), "doc_id", "text", "\n")


@query("paged_read_bounded", f"""WITH {_PAGES}, c AS (SELECT doc_id, count(*) AS page_count FROM p GROUP BY 1),
r AS (SELECT *, 8000 - coalesce(sum(least(length(text), 2000)) OVER (PARTITION BY doc_id ORDER BY page_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest FROM p WHERE page_no <= 5)
SELECT r.doc_id, CAST(page_no AS INT) AS page_no, substr(text, 1, CAST(least(length(text), 2000, rest) AS BIGINT)) AS excerpt, length(text) > least(length(text), 2000, rest) AS truncated, page_count
FROM r JOIN c ON r.doc_id = c.doc_id WHERE rest > 0""")
def paged_read_bounded(t: Tables):
    return P.read_bounded(doc_pages(t), "doc_id")


@query("page_search", f"""WITH {_PAGES}, h AS (SELECT doc_id, page_no, text, instr(lower(text), 'the') - 1 AS a FROM p WHERE contains(lower(text), 'the')),
e AS (SELECT doc_id, page_no, {D.trimmed('substr(text, greatest(a - 180, 0) + 1, least(a + 323, length(text)) - greatest(a - 180, 0))')} AS excerpt FROM h)
SELECT doc_id, CAST(page_no AS INT) AS page_no, excerpt FROM e""")
def page_search(t: Tables):
    return P.search(doc_pages(t), "doc_id", " The".strip())


@query("page_tables", """WITH t AS (SELECT page_id, unnest(l) AS body, generate_subscripts(l, 1) AS table_index FROM (SELECT page_id, (regexp_extract_all(html, '(?is)<ul(?:\\s[^>]*)?>(.*?)</ul>', 1)) AS l FROM pages)),
r AS (SELECT page_id, table_index, regexp_extract_all(body, '(?is)<li(?:\\s[^>]*)?>(.*?)</li>', 1) AS rows FROM t),
x AS (SELECT page_id, table_index, len(rows) AS row_count, FALSE AS truncated, generate_subscripts(rows, 1) - 1 AS row_index, unnest(rows) AS row FROM r)
SELECT page_id, CAST(table_index AS INT) AS table_index, CAST(row_count AS INT) AS row_count, truncated, CAST(row_index AS INT) AS row_index,
array_to_string(list_transform(regexp_extract_all(row, '(?is)<a(?:\\s[^>]*)?>(.*?)</a>', 1), lambda c: trim(regexp_replace(c, '<[^>]*>', '', 'g'))), '|') AS cells FROM x""")
def page_tables(t: Tables):
    return P.html_tables(t.pages, "page_id", "html", "ul", "li", "a")


@query("paged_profile", f"""WITH {_PAGES} SELECT doc_id, count(*) AS page_count, CAST(sum(CASE WHEN page_no <= 3 THEN length(text) ELSE 0 END) AS BIGINT) AS preview_chars,
CAST(sum(CASE WHEN page_no <= 3 THEN len(regexp_extract_all(text, ',')) ELSE 0 END) AS BIGINT) AS table_count_estimate, max(page_no) > 3 AS truncated FROM p GROUP BY doc_id""")
def paged_profile(t: Tables):
    pages = doc_pages(t).withColumn("n_tables", F.size(F.regexp_extract_all("text", F.lit(","), F.lit(0))))
    return P.profile(pages, "doc_id", "n_tables")


@query("task_scan_strict", """WITH j AS (SELECT folder, v, json_valid(v) AS valid, CASE WHEN json_valid(v) THEN v END AS o FROM task_json),
k AS (SELECT folder, json_extract_string(o, '$.task_id') AS task_id, json_extract_string(o, '$.difficulty') AS difficulty, json_extract_string(o, '$.question') AS question,
 CASE WHEN NOT valid THEN 'not an object' WHEN list_sort(json_keys(o)) <> ['difficulty', 'question', 'task_id'] THEN 'wrong keys' WHEN json_extract_string(o, '$.task_id') <> folder THEN 'id differs from folder' END AS fault FROM j)
SELECT folder, task_id, difficulty, question, fault, CASE WHEN fault IS NULL THEN TRY_CAST(regexp_extract(task_id, '(\\d+)$', 1) AS BIGINT) END AS task_no FROM k""", ["task_json"])
def task_scan_strict(t: Tables):
    return K.scan_strict(t.task_json, "folder", "v")


@query("task_counts", """SELECT difficulty, count(*) AS n FROM customer_questions WHERE difficulty IN ('easy', 'hard') GROUP BY difficulty""", ["customer_questions"])
def task_counts(t: Tables):
    return K.counts(K.select_tasks(t.customer_questions, difficulties=["easy", "hard"]))


@query("trace_steps", """SELECT j.run_id, json_extract_string(j.v, '$.task_id') AS task_id, CAST(json_extract(s.value, '$.step_index') AS BIGINT) AS step_index,
json_extract_string(s.value, '$.action') AS action, CAST(json_extract(s.value, '$.ok') AS BOOLEAN) AS ok, CAST(json_extract(s.value, '$.observation') AS VARCHAR) AS observation
FROM trace_json j, json_each(j.v, '$.steps') s""", ["trace_json"])
def trace_steps(t: Tables):
    return K.trace_steps(t.trace_json, "v", keep=["run_id"])


@query("preview_rows", """(SELECT 'orders' AS source, o_orderkey AS k, o_orderstatus AS first_text FROM orders ORDER BY o_orderkey LIMIT 20)
UNION ALL (SELECT 'customer', c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 20)""")
def preview_rows(t: Tables):
    a = t.orders.select(F.lit("orders").alias("source"), F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("first_text"))
    b = t.customer.select(F.lit("customer").alias("source"), F.col("c_custkey").alias("k"), F.col("c_name").alias("first_text"))
    return a.orderBy("k").limit(20).union(b.orderBy("k").limit(20))


@query("preview_text", "SELECT doc_id, substr(text, 1, 4000) AS preview, length(text) > 4000 AS truncated FROM documents")
def preview_text(t: Tables):
    return t.documents.select(
        "doc_id", F.substring("text", 1, 4000).alias("preview"), (F.length("text") > 4000).alias("truncated")
    )


@query("sink_answer_csv", "SELECT c_mktsegment, count(*) AS n, round(sum(c_acctbal), 2) AS total FROM customer GROUP BY 1")
def sink_answer_csv(t: Tables):
    folder = scratch(t, "answers")
    S.write_answer_csv(t.customer.select("c_mktsegment", "c_custkey", "c_acctbal"), folder, by=["c_mktsegment"])
    back = S.scan_csv(t.spark, folder, "c_custkey long, c_acctbal double, c_mktsegment string")
    return back.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("c_acctbal"), 2).alias("total"))


@query("sink_jsonl", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
def sink_jsonl(t: Tables):
    folder = scratch(t, "jsonl")
    S.write_jsonl(t.orders.select("o_orderkey", "o_orderstatus"), folder)
    return t.spark.read.schema("o_orderkey long, o_orderstatus string").json(folder).groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


@query("sink_evidence", "SELECT CAST(c_custkey AS VARCHAR) AS entity_id, c_acctbal AS balance FROM customer")
def sink_evidence(t: Tables):
    folder = scratch(t, "evidence")
    S.write_evidence(t.customer.select(F.col("c_custkey").cast("string").alias("entity_id"), F.col("c_acctbal").alias("balance")), folder)
    return t.spark.read.parquet(folder)
