"""Analytical patterns on the star schema."""

from __future__ import annotations

from pyspark.sql import functions as F

from questloom.operators import patterns as A
from questloom.plans import fixtures as fx
from questloom.plans.registry import Tables, query

fx.define("race_results", """
SELECT c_nationkey AS race_id, c_custkey AS entity_id, CAST(c_custkey % 7 AS STRING) || '.0' AS rank_text,
  (c_custkey * 7) % 11 + 1 AS position_order, '+' || CAST(CAST(c_acctbal AS DECIMAL(12,2)) AS STRING) AS time_text
FROM customer""", ("customer",))

fx.define("segment_amounts", """
SELECT c_nationkey, c_mktsegment, SUM(CAST(c_acctbal AS DECIMAL(18,2))) AS amt
FROM customer GROUP BY c_nationkey, c_mktsegment""", ("customer",))

fx.define("submitted_values", """
SELECT c_nationkey, CASE WHEN c_nationkey % 3 = 0 THEN CAST(NULL AS DOUBLE) ELSE CAST(1.5 AS DOUBLE) END AS submitted
FROM (SELECT DISTINCT c_nationkey FROM customer)""", ("customer",))

fx.define("expenses", """
SELECT l_orderkey, CASE WHEN l_extendedprice >= 1000 THEN CAST(CAST(FLOOR(l_extendedprice / 1000) AS BIGINT) AS STRING) || ',' ||
  substr(CAST(CAST(1000000 + l_extendedprice - FLOOR(l_extendedprice / 1000) * 1000 AS DECIMAL(12,2)) AS STRING), 5)
  ELSE CAST(CAST(l_extendedprice AS DECIMAL(12,2)) AS STRING) END AS cost,
  CASE l_returnflag WHEN 'R' THEN ' Approved ' WHEN 'A' THEN 'no' ELSE 'true' END AS approved
FROM lineitem""", ("lineitem",))

_FILTERED = """SELECT o.o_totalprice AS m, strftime(o.o_orderdate, '%Y%m') AS p, o.o_custkey AS e, c.c_nationkey AS k
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey WHERE year(o.o_orderdate) = 1997 AND lower(c.c_mktsegment) = 'building'"""


def _orders_1997(t: Tables):
    return A.filter_by_dimension(
        t.orders, t.customer, F.col("o_custkey") == F.col("c_custkey"), "o_orderdate", 1997,
        "c_mktsegment", "BUILDING",
    ).withColumn("month", F.date_format("o_orderdate", "yyyyMM"))


@query("avg_monthly_candidates", f"""WITH f AS ({_FILTERED})
SELECT 'avg_metric_div_12' AS formula, round(avg(m) / 12, 2) AS value FROM f
UNION ALL SELECT 'sum_metric_div_12', round(sum(m) / 12, 2) FROM f
UNION ALL SELECT 'sum_metric_div_distinct_month', round(sum(m) / NULLIF(count(DISTINCT p), 0), 2) FROM f
UNION ALL SELECT 'avg_entity_annual_div_12', round(avg(s) / 12, 2) FROM (SELECT sum(m) AS s FROM f GROUP BY e)""")
def avg_monthly_candidates(t: Tables):
    return A.average_monthly(_orders_1997(t), "o_totalprice", "month", "o_custkey").select(
        "formula", F.round("value", 2).alias("value")
    )


@query("avg_monthly_choice", f"""WITH f AS ({_FILTERED}),
w AS (SELECT k, avg(m) / 12 AS a, sum(m) / 12 AS o1, sum(m) / NULLIF(count(DISTINCT p), 0) AS o2 FROM f GROUP BY k),
e AS (SELECT k, avg(s) / 12 AS o3 FROM (SELECT k, e, sum(m) AS s FROM f GROUP BY k, e) GROUP BY k),
c AS (SELECT w.k AS c_nationkey, a, o1, o2, o3, CASE WHEN s.submitted IS NULL THEN NULL WHEN w.k % 3 = 1 THEN o1 ELSE 1.5 END AS v
 FROM w JOIN e ON w.k = e.k JOIN submitted_values s ON s.c_nationkey = w.k),
d AS (SELECT *, v IS NULL OR ((abs(v - a) > greatest(1e-6 * greatest(abs(v), abs(a)), 1e-6)) AND
 (abs(v - o1) <= greatest(1e-6 * greatest(abs(v), abs(o1)), 1e-6) OR abs(v - o2) <= greatest(1e-6 * greatest(abs(v), abs(o2)), 1e-6) OR
  abs(v - o3) <= greatest(1e-6 * greatest(abs(v), abs(o3)), 1e-6))) AS repaired FROM c)
SELECT c_nationkey, round(v, 4) AS submitted, round(a, 4) AS candidate, repaired, round(CASE WHEN repaired THEN a ELSE v END, 4) AS final_value FROM d""",
       ["submitted_values"])
def avg_monthly_choice(t: Tables):
    cands = A.average_monthly(
        _orders_1997(t), "o_totalprice", "month", "o_custkey", by=["c_nationkey"]
    )
    sums = cands.filter(F.col("formula") == "sum_metric_div_12").select(
        "c_nationkey", F.col("value").alias("_sum")
    )
    given = t.submitted_values.join(sums, "c_nationkey").select(
        "c_nationkey",
        F.when(F.col("submitted").isNotNull() & (F.col("c_nationkey") % 3 == 1), F.col("_sum"))
        .otherwise(F.col("submitted")).alias("submitted"),
    )
    out = A.choose_average_monthly(cands, given, "c_nationkey", "submitted")
    return out.select(
        "c_nationkey", F.round("submitted", 4).alias("submitted"),
        F.round("candidate", 4).alias("candidate"), "repaired",
        F.round("final_value", 4).alias("final_value"),
    )


@query("fact_dim_filter", f"SELECT e AS o_custkey, p AS month, count(*) AS n FROM ({_FILTERED}) GROUP BY e, p")
def fact_dim_filter(t: Tables):
    return _orders_1997(t).groupBy("o_custkey", "month").agg(F.count(F.lit(1)).alias("n"))


@query("filtered_join_avg", """SELECT round(avg(c.c_acctbal), 4) AS average FROM customer c
JOIN nation n ON c.c_nationkey = n.n_nationkey WHERE lower(n.n_name) = 'nation_3'""")
def filtered_join_avg(t: Tables):
    return A.filtered_join_average(
        t.customer, t.nation, F.col("c_nationkey") == F.col("n_nationkey"), "n_name", "NATION_3",
        "c_acctbal",
    ).select(F.round("average", 4).alias("average"))


@query("entity_count_semi", """SELECT count(DISTINCT l_partkey) AS entity_count FROM lineitem
WHERE lower(l_returnflag) IN ('r', 'a') AND l_orderkey IN (SELECT DISTINCT o_orderkey FROM orders WHERE o_orderstatus = 'P')""")
def entity_count_semi(t: Tables):
    return A.count_related_entities(
        t.lineitem.filter(F.lower("l_returnflag").isin("r", "a")),
        t.orders.filter(F.col("o_orderstatus") == "P"), "l_orderkey", "o_orderkey", ["l_partkey"],
    )


@query("joined_filter_project", """SELECT coalesce(CASE WHEN s.s_acctbal > 5000 THEN s.s_name END, '') AS name, n.n_name
FROM supplier s JOIN nation n ON CAST(s.s_nationkey AS VARCHAR) = CAST(n.n_nationkey AS VARCHAR)
WHERE lower(n.n_name) LIKE '%nation_1%' AND TRY_CAST(s.s_acctbal AS DOUBLE) > 1000 ORDER BY 1""")
def joined_filter_project(t: Tables):
    return A.joined_filter(
        t.supplier, t.nation, ("s_nationkey", "n_nationkey"),
        [F.col("s_acctbal").try_cast("double") > 1000, F.lower("n_name").like("%nation_1%")],
        [F.coalesce(F.when(F.col("s_acctbal") > 5000, F.col("s_name")), F.lit("")).alias("name"), F.col("n_name")],
    ).orderBy("name", "n_name")


def _ranged(t: Tables, by=()):
    return A.top_text_in_range(
        t.orders.select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority"),
        t.customer.select("c_custkey", "c_acctbal", "c_nationkey"),
        F.col("o_custkey") == F.col("c_custkey"), "c_acctbal", 1000, 6000, "o_totalprice",
        "o_orderkey", by,
    )


@query("ranged_top1_text", """SELECT o_orderkey, o_orderpriority AS text FROM orders JOIN customer ON o_custkey = c_custkey
WHERE c_acctbal BETWEEN 1000 AND 6000 ORDER BY o_totalprice DESC, o_orderkey ASC LIMIT 1""")
def ranged_top1_text(t: Tables):
    return _ranged(t).select("o_orderkey", F.col("o_orderpriority").alias("text"))


@query("ranged_top1_text_by_group", """SELECT c_nationkey, o_orderkey, o_orderpriority AS text FROM orders JOIN customer ON o_custkey = c_custkey
WHERE c_acctbal BETWEEN 1000 AND 6000 QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY o_totalprice DESC, o_orderkey ASC) = 1""")
def ranged_top1_text_by_group(t: Tables):
    return _ranged(t, ["c_nationkey"]).select(
        "c_nationkey", "o_orderkey", F.col("o_orderpriority").alias("text")
    )


@query("rank_attached_field", """SELECT race_id, entity_id, time_text, position_order, position_order <> 2 AS differs FROM race_results
WHERE TRY_CAST(rank_text AS DOUBLE) = 2""", ["race_results"])
def rank_attached_field(t: Tables):
    return A.rank_attached(t.race_results, "rank_text", 2).select(
        "race_id", "entity_id", "time_text", "position_order",
        (F.col("position_order") != 2).alias("differs"),
    )


@query("ranked_entity_reference", """WITH w AS (SELECT race_id, min(entity_id) AS entity_id FROM race_results WHERE position_order = 1 GROUP BY race_id)
SELECT n.n_name, c.c_name AS ref, 'http://ref/' || c.c_custkey AS url FROM nation n JOIN w ON w.race_id = n.n_nationkey
JOIN customer c ON c.c_custkey = w.entity_id""", ["race_results"])
def ranked_entity_reference(t: Tables):
    return A.ranked_entity_reference(
        t.nation.select(F.col("n_nationkey").alias("race_id"), "n_name"), t.race_results,
        t.customer.select(
            F.col("c_custkey").alias("entity_id"), F.col("c_name").alias("ref"),
            F.concat(F.lit("http://ref/"), F.col("c_custkey").cast("string")).alias("url"),
        ), "race_id", "entity_id", "position_order",
    ).select("n_name", "ref", "url")


@query("unit_ratio_first_seen", """SELECT s.s_acctbal, min(l.l_orderkey * 10 + l.l_linenumber) AS first_id FROM lineitem l
JOIN supplier s ON l.l_suppkey = s.s_suppkey WHERE l.l_returnflag = 'R' AND l.l_quantity <> 0 AND l.l_extendedprice / l.l_quantity > 2500
GROUP BY s.s_acctbal""")
def unit_ratio_first_seen(t: Tables):
    tx = t.lineitem.filter(F.col("l_returnflag") == "R").withColumn(
        "tx_id", F.col("l_orderkey") * 10 + F.col("l_linenumber")
    )
    return A.unit_ratio_first_seen(
        tx, t.supplier, F.col("l_suppkey") == F.col("s_suppkey"), "l_extendedprice", "l_quantity",
        2500.0, "s_acctbal", "tx_id",
    )


@query("linked_total_by_entity_type", """WITH x AS (SELECT o.o_custkey AS k, sum(TRY_CAST(replace(e.cost, ',', '') AS DECIMAL(18,2))) AS a
FROM expenses e JOIN orders o ON e.l_orderkey = o.o_orderkey WHERE lower(trim(e.approved)) IN ('true','1','yes','y','approved') GROUP BY o.o_custkey)
SELECT c.c_name, c.c_mktsegment, CAST(a AS VARCHAR) AS total_value FROM x JOIN customer c ON c.c_custkey = x.k WHERE a <> 0""", ["expenses"])
def linked_total_by_entity_type(t: Tables):
    return A.linked_total(
        t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_name", "c_mktsegment"),
        t.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"),
        t.expenses, "o_custkey", "l_orderkey", "c_mktsegment", "c_name", "cost", "approved",
    )


@query("entity_by_name", """WITH s AS (SELECT lower(n_name) AS k, CAST(n_nationkey AS VARCHAR) AS entity_id, CAST(n_regionkey AS VARCHAR) AS entity_type, 0 AS o, 'nation' AS source FROM nation
UNION ALL SELECT lower(c_name), CAST(c_custkey AS VARCHAR), c_mktsegment, 1, 'customer' FROM customer
UNION ALL SELECT lower(s_name), CAST(s_suppkey AS VARCHAR), '', 2, 'supplier' FROM supplier),
w AS (SELECT DISTINCT upper(c_name) AS name FROM customer UNION SELECT s_name FROM supplier)
SELECT w.name, entity_id, entity_type, source FROM w JOIN s ON s.k = lower(w.name)
QUALIFY row_number() OVER (PARTITION BY w.name ORDER BY o, entity_id, entity_type) = 1""")
def entity_by_name(t: Tables):
    ren = {
        "nation": t.nation.select(F.col("n_name").alias("Event_Name"), F.col("n_nationkey").alias("event_id"), F.col("n_regionkey").alias("type")),
        "customer": t.customer.select(F.col("c_name").alias("name"), F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("event_type")),
        "supplier": t.supplier.select(F.col("s_name").alias("name"), F.col("s_suppkey").alias("ID")),
    }
    wanted = t.customer.select(F.upper("c_name").alias("name")).union(t.supplier.select("s_name"))
    return A.entity_by_name(list(ren.items()), wanted, "name")


@query("linked_ratio", """WITH r AS (SELECT c_nationkey, max(CASE WHEN c_mktsegment = 'BUILDING' THEN CAST(amt AS DOUBLE) END) AS amount_a,
max(CASE WHEN c_mktsegment = 'MACHINERY' THEN CAST(amt AS DOUBLE) END) AS amount_b FROM segment_amounts GROUP BY c_nationkey)
SELECT c_nationkey, amount_a, amount_b, amount_a / NULLIF(amount_b, 0) AS ratio FROM r""", ["segment_amounts"])
def linked_ratio(t: Tables):
    amounts = t.segment_amounts.withColumn("amt", F.col("amt").cast("double"))
    return A.linked_ratio(amounts, ["c_nationkey"], "c_mktsegment", "BUILDING", "MACHINERY", "amt")


@query("pct_num_den", """WITH r AS (SELECT count(*) FILTER (p_size BETWEEN 10 AND 30 AND p_size > 0) AS denominator,
count(*) FILTER (p_size BETWEEN 10 AND 30 AND p_size > 0 AND p_brand = 'Brand#4') AS numerator FROM part)
SELECT denominator, numerator, numerator * 100.0::DOUBLE / NULLIF(denominator, 0) AS percentage FROM r""")
def pct_num_den(t: Tables):
    return A.percentage(
        t.part, F.col("p_size").between(10, 30) & (F.col("p_size") > 0),
        F.col("p_brand") == "Brand#4",
    )


@query("population_threshold_count", """WITH b AS (SELECT round(quantile_cont(value, 0.05), 1) AS low, round(quantile_cont(value, 0.95), 1) AS high FROM events),
u AS (SELECT user_id, low, high, max(CASE WHEN value BETWEEN low AND high THEN 1 ELSE 0 END) AS i, max(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS a FROM events CROSS JOIN b GROUP BY user_id, low, high)
SELECT low, high, CAST(count(*) FILTER (i = 1 AND a = 1) AS BIGINT) AS entity_count FROM u
WHERE user_id IN (SELECT user_id FROM events WHERE event_type = 'signup') GROUP BY low, high""")
def population_threshold_count(t: Tables):
    rows = t.events.select(
        "user_id", "value", F.when(F.col("event_type") == "purchase", F.col("value")).alias("m2")
    )
    population = t.events.filter(F.col("event_type") == "signup").select("user_id")
    return A.population_threshold_count(rows, population, "user_id", "value", "m2")


@query("population_union", """WITH d AS (SELECT unnest(regexp_extract_all(text, '(?i)client (\\d+)[^.]{0,180}?\\bcorrected\\b', 1)) AS id FROM narratives)
SELECT DISTINCT id FROM (SELECT CAST(c_custkey AS VARCHAR) AS id FROM customer WHERE upper(substr(trim(c_mktsegment), 1, 1)) = 'B' UNION ALL SELECT id FROM d)""",
       ["narratives"])
def population_union(t: Tables):
    ids = t.customer.filter(
        F.upper(F.substring(F.trim("c_mktsegment"), 1, 1)) == "B"
    ).select(F.col("c_custkey").alias("id"))
    return A.population_union(
        ids, t.narratives, "text", r"(?i)client (\d+)[^.]{0,180}?\bcorrected\b", "id"
    )


def _qp(column: str) -> str:
    from questloom.rules import questions as R

    def ex(c, p, g=1):
        p = p.replace("'", "''")
        return f"NULLIF(regexp_extract({c}, '{p}', {g}), '')"

    months = " ".join(
        f"WHEN regexp_matches(lower({column}), '\\b{m}\\b') THEN {i}" for i, m in enumerate(R.MONTHS, 1)
    )
    ranks = " ".join(
        f"WHEN regexp_matches(lower({column}), '\\b{w}\\b') THEN {k}" for w, k in R.ORDINALS
    )
    low = f"lower({column})"
    mn = f"TRY_CAST({ex(low, R.MONTH_NUMBER)} AS INT)"
    quoted = R.QUOTED.replace("'", "''")
    edges = R.QUOTE_EDGES.replace("'", "''")
    return f"""
array_to_string(list_transform(regexp_extract_all({column}, '{quoted}', 0), lambda x: trim(regexp_replace(x, '{edges}', '', 'g'))), '|') AS quoted_names,
TRY_CAST({ex(column, R.YEAR)} AS BIGINT) AS year,
CAST(CASE {months} WHEN {mn} BETWEEN 1 AND 12 THEN {mn} END AS BIGINT) AS month,
CAST(CASE {ranks} ELSE TRY_CAST({ex(low, R.RANKED_NUMBER)} AS INT) END AS BIGINT) AS rank,
TRY_CAST({ex(low, R.BETWEEN, 1)} AS DOUBLE) AS range_low, TRY_CAST({ex(low, R.BETWEEN, 2)} AS DOUBLE) AS range_high,
TRY_CAST(coalesce({', '.join(ex(column, p) for p in R.PRODUCT_ID)}) AS BIGINT) AS product_id,
TRY_CAST(coalesce({', '.join(ex(column, p) for p in R.UNIT_THRESHOLD)}) AS DOUBLE) AS unit_threshold,
trim(coalesce({', '.join(ex(column, p) for p in R.CATEGORY)})) AS category,
trim({ex(column, R.PUBLISHED_BY)}) AS publisher"""


@query("question_parameters", f"SELECT *, {_qp('question')} FROM customer_questions", ["customer_questions"])
def question_parameters(t: Tables):
    return A.question_parameters(t.customer_questions, "question")
