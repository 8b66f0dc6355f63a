"""Query surface: projection, filter, join, aggregate, sort, limit, JSON, normalisation."""

from __future__ import annotations

from pyspark.sql import functions as F

from questloom.operators import query as Q
from questloom.plans.registry import Tables, query

_BOUNDED = (
    "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'"
    " ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 1000"
)


@query("sql_bounded", f"""
WITH r AS (SELECT *, row_number() OVER (ORDER BY o_totalprice DESC NULLS LAST, o_orderkey) AS rn, count(*) OVER () AS n
  FROM ({_BOUNDED}))
SELECT o_orderkey, o_totalprice, n > 200 AS truncated FROM r WHERE rn <= 200""")
def sql_bounded(t: Tables):
    t.orders.createOrReplaceTempView("orders")
    return Q.bounded_sql(t.spark, "-- biggest finished orders\n" + _BOUNDED, limit=200)


@query("sql_bounded_ns", """
SELECT c_mktsegment, count(*) AS n, FALSE AS truncated FROM customer GROUP BY c_mktsegment""")
def sql_bounded_ns(t: Tables):
    from questloom.sources.tables import register_namespace

    register_namespace("shop", {"customer": t.customer, "orders": t.orders})
    return Q.bounded_sql(
        t.spark,
        "/* one namespace */ SELECT c_mktsegment, count(*) AS n FROM shop_customer GROUP BY 1 ORDER BY 1",
        limit=50, listing=True,
    )


@query("q_project", "SELECT o_orderkey AS order_id, o_totalprice AS price, o_orderstatus FROM orders")
def q_project(t: Tables):
    return t.orders.select(
        F.col("o_orderkey").alias("order_id"), F.col("o_totalprice").alias("price"), "o_orderstatus"
    )


@query("q_filter", """SELECT l_orderkey, l_linenumber FROM lineitem
WHERE l_quantity > 40 AND l_returnflag = 'R' AND (l_discount <= 0.02 OR l_tax >= 0.07) AND l_linestatus <> 'F'""")
def q_filter(t: Tables):
    c = F.col
    return t.lineitem.filter(
        (c("l_quantity") > 40) & (c("l_returnflag") == "R")
        & ((c("l_discount") <= 0.02) | (c("l_tax") >= 0.07)) & (c("l_linestatus") != "F")
    ).select("l_orderkey", "l_linenumber")


@query("q_like", "SELECT p_partkey, p_name FROM part WHERE lower(p_name) LIKE '%ring%'")
def q_like(t: Tables):
    return t.part.filter(F.lower("p_name").like("%ring%")).select("p_partkey", "p_name")


@query("q_in_list", "SELECT event_id FROM events WHERE lower(event_type) IN ('click','purchase')")
def q_in_list(t: Tables):
    return t.events.filter(F.lower("event_type").isin("click", "purchase")).select("event_id")


@query("q_between", "SELECT p_partkey FROM part WHERE p_size BETWEEN 10 AND 20")
def q_between(t: Tables):
    return t.part.filter(F.col("p_size").between(10, 20)).select("p_partkey")


@query("q_not_null", """SELECT d.doc_id FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
WHERE l.quality IS NOT NULL AND d.lang IS NOT NULL""")
def q_not_null(t: Tables):
    return (
        t.documents.select("doc_id", "lang").join(t.labels, "doc_id", "left")
        .filter(F.col("quality").isNotNull() & F.col("lang").isNotNull()).select("doc_id")
    )


@query("q_join_inner", """SELECT o.o_orderkey, c.c_name, c.c_mktsegment FROM orders o
JOIN customer c ON o.o_custkey = c.c_custkey WHERE o.o_totalprice > 200000""")
def q_join_inner(t: Tables):
    return (
        t.orders.filter(F.col("o_totalprice") > 200000)
        .join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
        .select("o_orderkey", "c_name", "c_mktsegment")
    )


@query("q_join_left", """SELECT c.c_custkey, count(o.o_orderkey) AS n FROM customer c
LEFT JOIN orders o ON o.o_custkey = c.c_custkey GROUP BY c.c_custkey""")
def q_join_left(t: Tables):
    per = t.orders.groupBy("o_custkey").agg(F.count("o_orderkey").alias("k"))
    return t.customer.join(per, F.col("c_custkey") == F.col("o_custkey"), "left").select(
        "c_custkey", F.coalesce("k", F.lit(0)).alias("n")
    )


@query("q_join_cast_key", """SELECT c.c_name, t.n FROM customer c
JOIN (SELECT CAST(o_custkey AS VARCHAR) AS k, count(*) AS n FROM orders GROUP BY 1) t
ON CAST(c.c_custkey AS VARCHAR) = CAST(t.k AS VARCHAR)""")
def q_join_cast_key(t: Tables):
    per = t.orders.groupBy(F.col("o_custkey").cast("string").alias("k")).agg(
        F.count(F.lit(1)).alias("n")
    )
    return t.customer.join(per, F.col("c_custkey").cast("string") == F.col("k")).select("c_name", "n")


@query("q_join_semi", """SELECT c_custkey FROM customer WHERE c_custkey IN
(SELECT DISTINCT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')""")
def q_join_semi(t: Tables):
    urgent = t.orders.filter(F.col("o_orderpriority") == "1-URGENT")
    return t.customer.join(
        urgent, F.col("c_custkey") == F.col("o_custkey"), "left_semi"
    ).select("c_custkey")


@query("q_scalar_subquery", """SELECT o_orderkey FROM orders
WHERE o_totalprice > (SELECT AVG(CAST(o_totalprice AS DECIMAL(18,2))) FROM orders)""")
def q_scalar_subquery(t: Tables):
    return t.sql(
        "SELECT o_orderkey FROM orders WHERE o_totalprice >"
        " (SELECT CAST(AVG(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) FROM orders)",
        "orders",
    )


@query("q_cte_group_rejoin", """WITH g AS (SELECT o_custkey, max(o_totalprice) AS top FROM orders GROUP BY o_custkey)
SELECT o.o_orderkey, g.top FROM orders o JOIN g ON o.o_custkey = g.o_custkey AND o.o_totalprice = g.top""")
def q_cte_group_rejoin(t: Tables):
    return t.sql(
        "WITH g AS (SELECT o_custkey, max(o_totalprice) AS top FROM orders GROUP BY o_custkey)"
        " SELECT o.o_orderkey, g.top FROM orders o JOIN g"
        " ON o.o_custkey = g.o_custkey AND o.o_totalprice = g.top", "orders",
    )


@query("q_agg_global", """SELECT count(*) AS n, round(avg(l_quantity), 6) AS avg_quantity,
max(l_extendedprice) AS max_price, min(l_extendedprice) AS min_price, round(sum(l_quantity), 2) AS sum_quantity FROM lineitem""")
def q_agg_global(t: Tables):
    return t.lineitem.agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("l_quantity"), 6).alias("avg_quantity"),
        F.max("l_extendedprice").alias("max_price"), F.min("l_extendedprice").alias("min_price"),
        F.round(F.sum("l_quantity"), 2).alias("sum_quantity"),
    )


@query("q_agg_group", """SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS sum_quantity,
round(avg(l_discount), 6) AS avg_discount FROM lineitem GROUP BY l_returnflag, l_linestatus""")
def q_agg_group(t: Tables):
    return t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("sum_quantity"),
        F.round(F.avg("l_discount"), 6).alias("avg_discount"),
    )


@query("q_count_variants", """SELECT event_type, count(*) AS n_rows,
count(CASE WHEN value > 50 THEN value END) AS n_big, count(DISTINCT user_id) AS n_users FROM events GROUP BY event_type""")
def q_count_variants(t: Tables):
    return t.events.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count(F.when(F.col("value") > 50, F.col("value"))).alias("n_big"),
        F.count_distinct("user_id").alias("n_users"),
    )


@query("q_having", """SELECT l_suppkey, round(avg(l_quantity), 6) AS avg_quantity FROM lineitem
GROUP BY l_suppkey HAVING avg(l_quantity) > 25.5""")
def q_having(t: Tables):
    return (
        t.lineitem.groupBy("l_suppkey").agg(F.avg("l_quantity").alias("a"))
        .filter(F.col("a") > 25.5).select("l_suppkey", F.round("a", 6).alias("avg_quantity"))
    )


@query("q_sort", "SELECT p_brand, p_size, p_partkey FROM part ORDER BY p_brand ASC NULLS LAST, p_size DESC NULLS LAST, p_partkey")
def q_sort(t: Tables):
    return t.part.select("p_brand", "p_size", "p_partkey").orderBy(
        F.asc_nulls_last("p_brand"), F.desc_nulls_last("p_size"), "p_partkey"
    )


@query("q_topk", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey ASC LIMIT 10")
def q_topk(t: Tables):
    return t.orders.select("o_orderkey", "o_totalprice").orderBy(
        F.desc("o_totalprice"), F.asc("o_orderkey")
    ).limit(10)


@query("q_distinct", "SELECT DISTINCT CAST(l_shipdate AS DATE) AS ship_day, l_returnflag FROM lineitem")
def q_distinct(t: Tables):
    return t.lineitem.select(F.to_date("l_shipdate").alias("ship_day"), "l_returnflag").distinct()


@query("q_try_cast", """SELECT task_id, row_idx, TRY_CAST(v AS DOUBLE) AS number,
CAST(row_idx AS VARCHAR) AS row_text FROM messy_cells""", ["messy_cells"])
def q_try_cast(t: Tables):
    return t.messy_cells.select(
        "task_id", "row_idx", F.col("v").try_cast("double").alias("number"),
        F.col("row_idx").cast("string").alias("row_text"),
    )


@query("q_nullif_div", """SELECT c_nationkey, round(sum(CASE WHEN c_acctbal > 0 THEN c_acctbal END)
/ NULLIF(count(DISTINCT CASE WHEN c_mktsegment = 'BUILDING' THEN c_custkey END), 0), 4) AS ratio FROM customer GROUP BY c_nationkey""")
def q_nullif_div(t: Tables):
    return t.customer.groupBy("c_nationkey").agg(
        F.round(
            F.try_divide(
                F.sum(F.when(F.col("c_acctbal") > 0, F.col("c_acctbal"))),
                F.count_distinct(F.when(F.col("c_mktsegment") == "BUILDING", F.col("c_custkey"))),
            ), 4,
        ).alias("ratio")
    )


@query("q_text_fn", """SELECT o_orderkey, lower(o_orderpriority) AS priority FROM orders
WHERE CAST(o_orderdate AS VARCHAR) LIKE '1997%'""")
def q_text_fn(t: Tables):
    # A year prefix test on a date is a date range: the scan can skip row groups.
    return t.orders.filter(
        (F.col("o_orderdate") >= F.lit("1997-01-01").cast("timestamp_ntz"))
        & (F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp_ntz"))
    ).select("o_orderkey", F.lower("o_orderpriority").alias("priority"))


@query("json_dot_path", """SELECT id, v,
json_extract(v, '$.records[1].id')::VARCHAR AS result,
CASE WHEN json_extract(v, '$.records[1].id') IS NULL THEN 'path ''records.1.id'' not found' END AS error FROM json_wrapped
UNION ALL SELECT id, v, json_extract(v, '$.records[0].missing')::VARCHAR,
CASE WHEN json_extract(v, '$.records[0].missing') IS NULL THEN 'path ''records.0.missing'' not found' END FROM json_wrapped""",
       ["json_wrapped"])
def json_dot_path(t: Tables):
    j = t.json_wrapped
    return Q.json_dot_path(j, "v", "records.1.id").unionByName(
        Q.json_dot_path(j, "v", "records.0.missing")
    )


@query("result_normalise", """WITH r AS (SELECT d.doc_id, d.text, string_split(d.text, ' ') AS words, CAST(d.n_chars AS DECIMAL(18,2)) AS size_dec FROM documents d)
SELECT doc_id, CASE WHEN length(text) > 4000 THEN substr(text, 1, 4000) || '... <truncated ' || (length(text) - 4000) || ' chars>' ELSE text END AS text,
array_to_string(CASE WHEN len(words) > 20 THEN list_append(list_transform(words[1:20], lambda w: CASE WHEN length(w) > 4000 THEN substr(w, 1, 4000) || '... <truncated ' || (length(w) - 4000) || ' chars>' ELSE w END), '... <' || (len(words) - 20) || ' more items>')
 ELSE list_transform(words, lambda w: CASE WHEN length(w) > 4000 THEN substr(w, 1, 4000) || '... <truncated ' || (length(w) - 4000) || ' chars>' ELSE w END) END, '|') AS words,
CAST(size_dec AS DOUBLE) AS size_dec FROM r""")
def result_normalise(t: Tables):
    raw = t.documents.select(
        "doc_id", "text", F.split("text", " ").alias("words"),
        F.col("n_chars").cast("decimal(18,2)").alias("size_dec"),
    )
    return Q.normalise_result(raw).withColumn("words", F.array_join("words", "|"))


@query("result_normalise_time", """SELECT event_id, CASE WHEN date_part('microsecond', ts) % 1000000 = 0
THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') END AS ts,
strftime(CAST(ts AS DATE), '%Y-%m-%d') AS day FROM events""")
def result_normalise_time(t: Tables):
    return Q.normalise_result(t.events.select("event_id", "ts", F.to_date("ts").alias("day")))
