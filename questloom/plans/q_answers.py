"""Answer clean-up, reshaping and scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from questloom.operators import answers as N
from questloom.operators import evaluate as E
from questloom.plans import duck as D
from questloom.plans import fixtures as fx
from questloom.plans.registry import Tables, query
from questloom.rules import shapes as R

fx.define("ragged_cells", """
SELECT task_id, row_idx, 0 AS col_idx, v FROM messy_cells
UNION ALL SELECT task_id, row_idx, 1, ' NaT ' FROM messy_cells WHERE row_idx % 2 = 0
UNION ALL SELECT task_id, row_idx, 2, v || 'x' FROM messy_cells WHERE row_idx % 5 <> 1""", ("messy_cells",))

fx.define("named_cells", """
SELECT c_nationkey AS task_id, c_custkey AS row_idx, 'c_name' AS col_name, c_name AS v FROM customer
UNION ALL SELECT c_nationkey, c_custkey, 'C_Acctbal', CAST(CAST(c_acctbal AS DECIMAL(12,2)) AS STRING) FROM customer
UNION ALL SELECT c_nationkey, c_custkey, 'c_mktsegment', c_mktsegment FROM customer WHERE c_nationkey % 3 <> 0""", ("customer",))

fx.define("header_questions", """
SELECT c_custkey AS task_id, CASE c_custkey % 7
  WHEN 0 THEN 'Which customers paid most?' WHEN 1 THEN 'List the transactions above 5.' WHEN 2 THEN 'What is tallied per element?'
  WHEN 3 THEN 'List the id, name and date of each customer.' WHEN 4 THEN 'Which event was held first?'
  WHEN 5 THEN 'What is the website and reference name?' ELSE 'Show every withdrawal of the account.' END AS question,
  CASE c_custkey % 5 WHEN 0 THEN 'Customer_ID,Total' WHEN 1 THEN 'trans_id,date,amount' WHEN 2 THEN 'Element,Tally'
  WHEN 3 THEN 'event name,Cost,n' ELSE 'x_id,x_name,y' END AS headers FROM customer""", ("customer",))

fx.define("eval_values", f"""
SELECT DISTINCT task_id, side, col_idx, CASE WHEN v IS NULL OR v = '' THEN '' ELSE coalesce({D.fixed2('v')}, {D.trimmed('v')}) END AS v
FROM answer_cells""", ("answer_cells",))
fx.define("eval_pairs", """
SELECT x.task_id, x.g, x.p, x.shared, a.n + b.n - x.shared AS total, x.shared / (a.n + b.n - x.shared) AS similarity
FROM (SELECT g.task_id, g.col_idx AS g, p.col_idx AS p, count(*) AS shared FROM eval_values g JOIN eval_values p ON g.task_id = p.task_id AND g.v = p.v
 WHERE g.side = 'gold' AND p.side = 'pred' GROUP BY 1, 2, 3) x
JOIN (SELECT task_id, side, col_idx, count(*) AS n FROM eval_values GROUP BY 1, 2, 3) a ON a.task_id = x.task_id AND a.side = 'gold' AND a.col_idx = x.g
JOIN (SELECT task_id, side, col_idx, count(*) AS n FROM eval_values GROUP BY 1, 2, 3) b ON b.task_id = x.task_id AND b.side = 'pred' AND b.col_idx = x.p""",
          ("eval_values",))
_MATCH = """o AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY similarity DESC, g, p) AS rn FROM eval_pairs),
r(task_id, rn, g, p, similarity, hit, gs, ps) AS (
 SELECT task_id, 0::BIGINT, NULL::INT, NULL::INT, NULL::DOUBLE, FALSE, []::INT[], []::INT[] FROM (SELECT DISTINCT task_id FROM o)
 UNION ALL SELECT o.task_id, o.rn, o.g, o.p, o.similarity, NOT list_contains(r.gs, o.g) AND NOT list_contains(r.ps, o.p),
 CASE WHEN NOT list_contains(r.gs, o.g) AND NOT list_contains(r.ps, o.p) THEN list_append(r.gs, o.g) ELSE r.gs END,
 CASE WHEN NOT list_contains(r.gs, o.g) AND NOT list_contains(r.ps, o.p) THEN list_append(r.ps, o.p) ELSE r.ps END
 FROM r JOIN o ON o.task_id = r.task_id AND o.rn = r.rn + 1),
m AS (SELECT task_id, g, p, similarity FROM r WHERE hit)"""
_SCORE = f"""WITH RECURSIVE {_MATCH},
c AS (SELECT task_id, count(*) FILTER (side = 'gold') AS gold_columns, count(*) FILTER (side = 'pred') AS pred_columns
 FROM (SELECT DISTINCT task_id, side, col_idx FROM answer_cells) GROUP BY task_id),
k AS (SELECT task_id, count(*) AS m, avg(similarity) AS s FROM m GROUP BY task_id),
sc AS (SELECT c.task_id, gold_columns, pred_columns, coalesce(m, 0) AS matched_columns, pred_columns - coalesce(m, 0) AS redundant_columns,
 gold_columns - coalesce(m, 0) AS missing_columns, coalesce(s, 0) AS mean_similarity,
 CASE WHEN pred_columns = 0 THEN 0 ELSE greatest(0, least(1, coalesce(m, 0) / gold_columns - (pred_columns - coalesce(m, 0)) * 0.05::DOUBLE)) END AS score
 FROM c LEFT JOIN k ON c.task_id = k.task_id)"""


@query("answer_normalise", f"""WITH w AS (SELECT task_id, max(col_idx) + 1 AS w FROM ragged_cells GROUP BY task_id),
g AS (SELECT DISTINCT r.task_id, r.row_idx, unnest(range(0, w.w)) AS col_idx FROM ragged_cells r JOIN w ON r.task_id = w.task_id)
SELECT g.task_id, g.row_idx, CAST(g.col_idx AS INT) AS col_idx, CASE WHEN lower({D.trimmed("coalesce(r.v, '')")}) IN
('null','none','nan','na','n/a','nat','inf','-inf','infinity','-infinity') THEN '' ELSE {D.trimmed("coalesce(r.v, '')")} END AS v
FROM g LEFT JOIN ragged_cells r ON r.task_id = g.task_id AND r.row_idx = g.row_idx AND r.col_idx = g.col_idx""", ["ragged_cells"])
def answer_normalise(t: Tables):
    return N.normalise_cells(t.ragged_cells)


@query("answer_sanitise", f"""SELECT task_id, row_idx, CASE WHEN lower({D.trimmed('v')}) IN ('','null','none','nan','inf','-inf','infinity','-infinity') THEN ''
ELSE coalesce(CASE WHEN {D.num('v')} IS NOT NULL THEN {D.fixed2('v')} END, {D.trimmed('v')}) END AS v FROM messy_cells""", ["messy_cells"])
def answer_sanitise(t: Tables):
    return t.messy_cells.select("task_id", "row_idx", N.sanitise(F.col("v")).alias("v"))


@query("answer_round_cells", f"""WITH r AS (SELECT task_id, row_idx, v, coalesce({D.num('v')} IS NOT NULL AND length(split_part({D.trimmed('v')}, '.', 2)) > 2, FALSE) AS changed FROM messy_cells)
SELECT task_id, row_idx, CASE WHEN changed THEN {D.fixed2('v')} ELSE v END AS v, changed FROM r""", ["messy_cells"])
def answer_round_cells(t: Tables):
    return N.round_cells(t.messy_cells)


_NAME = "p_name || CASE WHEN p_size > 25 THEN ' of ' || p_brand ELSE '' END"


@query("split_full_name", f"""WITH r AS (SELECT p_partkey, {_NAME} AS full_name FROM part UNION ALL SELECT -p_partkey - 1, p_brand FROM part)
SELECT p_partkey, full_name, CASE WHEN contains(full_name, ' ') THEN split_part(full_name, ' ', 1) ELSE full_name END AS first_name,
CASE WHEN contains(full_name, ' ') THEN substr(full_name, instr(full_name, ' ') + 1) ELSE '' END AS last_name FROM r""")
def split_full_name(t: Tables):
    p = t.part
    rows = p.select("p_partkey", F.expr(_NAME).alias("full_name")).union(
        p.select(-F.col("p_partkey") - 1, "p_brand")
    )
    return N.split_full_name(rows, "full_name")


@query("prune_to_column", """SELECT c.task_id, row_idx, col_name, v FROM named_cells c
WHERE lower(col_name) = 'c_mktsegment' OR NOT EXISTS (SELECT 1 FROM named_cells x WHERE x.task_id = c.task_id AND lower(x.col_name) = 'c_mktsegment')""", ["named_cells"])
def prune_to_column(t: Tables):
    keep = t.named_cells.select("task_id").distinct().withColumn("keep_column", F.lit(" C_MktSegment"))
    return N.prune_to_column(t.named_cells, keep)


def keep_column_sql(source: str) -> str:
    hits = " + ".join(f"contains(q, '{x}')::INT" for x in R.FIELD_TERMS)
    parts = []
    for e in R.ENTITY_TERMS:
        names = R.TRANSACTION_COLUMNS if e == "transaction" else tuple(p.format(e=e) for p in R.ENTITY_COLUMNS)
        parts.append(f"CASE WHEN regexp_matches(q, '\\b{e}s?\\b') THEN {list(names)} ELSE [] END")
    parts.append(f"CASE WHEN contains(q, 'withdrawal') OR contains(q, 'transaction') THEN {list(R.TRANSACTION_COLUMNS)} ELSE [] END")
    parts.append(f"CASE WHEN contains(q, 'event') THEN {list(R.EVENT_COLUMNS)} ELSE [] END")
    cand = f"flatten([{', '.join(parts)}])"
    many = f"({D.any_contains('q', R.MANY_MARKERS)} AND {hits} >= 2)"

    def only(n: str) -> str:
        f = f"list_filter(cols, lambda c: c = '{n}' OR c LIKE '%\\_{n}' ESCAPE '\\')"
        return f"CASE WHEN len({f}) = 1 THEN ({f})[1] END"

    cnt = f"(list_contains({list(R.COUNT_COLUMNS)}, c) OR c LIKE '%\\_count' ESCAPE '\\')"
    others = f"list_filter(cols, lambda c: NOT {cnt})"
    return f"""WITH r AS (SELECT *, lower(question) AS q, list_transform(string_split(headers, ','), lambda c: lower(trim(c))) AS cols FROM {source})
SELECT task_id, question, headers, CASE WHEN len(cols) > 1 AND NOT {many} AND NOT ({D.any_contains('q', ('website', 'web site', 'url'))} AND {D.any_contains('q', ('name', 'reference', 'ref'))})
 AND regexp_matches(q, '\\b(which|what|list|show|return|give)\\b') THEN coalesce(list_filter({cand}, lambda c: list_contains(cols, c))[1], {only('id')}, {only('name')}) END AS keep_single,
CASE WHEN len(cols) > 1 AND regexp_matches(q, '\\btall(?:y|ied|ies)\\b') AND len(list_filter(cols, lambda c: {cnt})) > 0 AND len({others}) > 0
 THEN coalesce(list_filter({list(R.TALLY_PREFERRED)}, lambda n: list_contains(cols, n))[1], ({others})[1]) END AS keep_tally FROM r"""


@query("keep_column_choice", keep_column_sql("header_questions"), ["header_questions"])
def keep_column_choice(t: Tables):
    q = t.header_questions.withColumn("_h", F.split("headers", ","))
    return N.keep_column_choice(q, "question", "_h").drop("_h")


@query("split_packed_score", f"""SELECT task_id, row_idx, regexp_extract(v, '{R.PACKED_SCORE}', 1) AS home, regexp_extract(v, '{R.PACKED_SCORE}', 2) AS away
FROM messy_cells WHERE regexp_matches(v, '{R.PACKED_SCORE}')""", ["messy_cells"])
def split_packed_score(t: Tables):
    return N.split_packed_score(t.messy_cells)


@query("strip_percent", f"""WITH r AS (SELECT *, regexp_matches({D.trimmed('v')}, '{R.PERCENT_CELL}') AS changed FROM messy_cells)
SELECT task_id, row_idx, CASE WHEN changed THEN regexp_extract({D.trimmed('v')}, '{R.PERCENT_CELL}', 1) ELSE v END AS v, changed FROM r""", ["messy_cells"])
def strip_percent(t: Tables):
    return N.strip_percent(t.messy_cells)


@query("answer_shape_check", """WITH r AS (SELECT task_id, row_idx, count(*) AS w FROM ragged_cells GROUP BY 1, 2), w AS (SELECT task_id, max(w) AS width FROM r GROUP BY 1)
SELECT r.task_id, width, count(*) AS rows, count(*) FILTER (r.w <> width) AS bad_rows, count(*) FILTER (r.w <> width) = 0 AS ok
FROM r JOIN w ON r.task_id = w.task_id GROUP BY r.task_id, width""", ["ragged_cells"])
def answer_shape_check(t: Tables):
    return N.shape_check(t.ragged_cells)


@query("eval_normalise", f"""WITH r AS (SELECT task_id, row_idx, v FROM messy_cells UNION ALL SELECT task_id, row_idx, v FROM answer_cells
UNION ALL SELECT c_nationkey, c_custkey, CAST(c_acctbal / 8 AS STRING) FROM customer)
SELECT task_id, row_idx, CASE WHEN v IS NULL OR v = '' THEN '' ELSE coalesce({D.fixed2('v')}, {D.trimmed('v')}) END AS v FROM r""", ["messy_cells", "answer_cells"])
def eval_normalise(t: Tables):
    rows = t.messy_cells.select("task_id", "row_idx", "v").union(
        t.answer_cells.select("task_id", "row_idx", "v")
    ).union(t.customer.select("c_nationkey", "c_custkey", (F.col("c_acctbal") / 8).cast("string")))
    return rows.select("task_id", "row_idx", E.normal_cell(F.col("v")).alias("v"))


@query("eval_value_sets", "SELECT * FROM eval_values", ["eval_values"])
def eval_value_sets(t: Tables):
    return E.value_sets(t.answer_cells)


@query("eval_jaccard_pairs", "SELECT task_id, g, p, shared, total, round(similarity, 6) AS similarity FROM eval_pairs", ["eval_pairs"])
def eval_jaccard_pairs(t: Tables):
    return E.jaccard_pairs(E.value_sets(t.answer_cells)).withColumn(
        "similarity", F.round("similarity", 6)
    )


def _matches(t: Tables):
    return E.match_columns(E.value_sets(t.answer_cells))


@query("eval_greedy_match", f"WITH RECURSIVE {_MATCH} SELECT task_id, g, p, round(similarity, 6) AS similarity FROM m", ["eval_pairs"])
def eval_greedy_match(t: Tables):
    return _matches(t).withColumn("similarity", F.round("similarity", 6))


def _scored(t: Tables):
    return E.scores(_matches(t), E.distinct_columns(t.answer_cells))


@query("eval_score", f"{_SCORE} SELECT task_id, gold_columns, pred_columns, matched_columns, redundant_columns, missing_columns, round(mean_similarity, 6) AS mean_similarity, round(score, 6) AS score FROM sc", ["eval_pairs"])
def eval_score(t: Tables):
    return _scored(t).withColumn("mean_similarity", F.round("mean_similarity", 6)).withColumn(
        "score", F.round("score", 6)
    )


@query("eval_composite", f"""{_SCORE},
f AS (SELECT task_id, v, bool_or(side = 'gold') AS ig, bool_or(side = 'pred') AS ip FROM eval_values GROUP BY 1, 2),
ov AS (SELECT task_id, count(*) FILTER (ig AND ip) / NULLIF(count(*) FILTER (ig), 0) AS s FROM f GROUP BY 1),
rw AS (SELECT task_id, count(DISTINCT CASE WHEN side = 'gold' THEN row_idx END) AS gold_rows, count(DISTINCT CASE WHEN side = 'pred' THEN row_idx END) AS pred_rows FROM answer_cells GROUP BY 1),
x AS (SELECT sc.task_id, sc.score, ov.s, gold_rows, pred_rows, 1 - least(abs(gold_rows - pred_rows) / greatest(gold_rows, 1), 1) AS rm FROM sc JOIN ov ON ov.task_id = sc.task_id JOIN rw ON rw.task_id = sc.task_id WHERE sc.pred_columns > 0)
SELECT task_id, round(s, 4) AS value_overlap, gold_rows, pred_rows, round(rm, 4) AS row_match, round(score * 0.4::DOUBLE + s * 0.3::DOUBLE + rm * 0.3::DOUBLE, 4) AS composite FROM x""", ["eval_pairs"])
def eval_composite(t: Tables):
    return E.composites(E.value_sets(t.answer_cells), t.answer_cells, _scored(t))


@query("eval_summary", f"""{_SCORE}
SELECT difficulty, count(*) AS tasks, round(avg(score), 6) AS mean_score, count(*) FILTER (score < 0.5) AS failures
FROM sc JOIN questions q ON q.task_id = sc.task_id WHERE sc.task_id NOT IN (SELECT n_nationkey FROM nation WHERE n_name = 'NATION_5') GROUP BY ROLLUP (difficulty)""", ["eval_pairs", "questions"])
def eval_summary(t: Tables):
    out = t.nation.filter(F.col("n_name") == "NATION_5").select(F.col("n_nationkey").alias("task_id"))
    return E.summary(_scored(t), t.questions, out).withColumn("mean_score", F.round("mean_score", 6))
