"""Threshold grounding."""

from __future__ import annotations

from pyspark.sql import functions as F

from questloom.operators import thresholds as T
from questloom.plans import duck as D
from questloom.plans import fixtures as fx
from questloom.plans.registry import Tables, query
from questloom.rules import documents as R
from questloom.session import kept

fx.define("lab_rows", """
SELECT event_id, CAST(100 + user_id AS STRING) AS entity_id, value AS m1, CASE WHEN event_type = 'purchase' THEN value * 2 END AS m2,
 CASE WHEN event_type = 'view' THEN 'F' ELSE 'male' END AS sex, event_type FROM events""", ("events",), ("events",))

fx.define("ward_notes", """
SELECT c_custkey AS doc_id, 'ward_' || CAST(c_nationkey % 3 AS STRING) AS source,
 'Patient ' || CAST(100 + c_custkey AS STRING) || ' is a ' || CASE WHEN c_nationkey % 2 = 0 THEN 'female' ELSE 'Male' END || ' adult.' || chr(10) || chr(10) ||
 'The subject ' || CAST(101 + c_custkey AS STRING) || ' left early. The woman known as Patient ' || CAST(100 + c_custkey % 7 AS STRING) || ' stayed! A man identified as ' || CAST(103 + c_custkey AS STRING) || ' too.' ||
 chr(10) || ' ' || chr(10) || 'The normal balance lies between ' || CAST(c_nationkey AS STRING) || ' and 900.5, level -3.' AS text
FROM customer""", ("customer",), ("customer",))

_QS = ", ".join(f"round(quantile_cont(x, {q}), 6) AS {n}" for n, q in T.QUANTILES)


def _profile(source: str, key: str = "k") -> str:
    return (
        f'SELECT {key}, count(x) AS "count", round(min(x), 6) AS min, round(max(x), 6) AS max, round(avg(x), 6) AS mean,'
        f" round(stddev_pop(x), 6) AS std, {_QS} FROM {source} WHERE x IS NOT NULL GROUP BY {key}"
    )


fx.define("metric_rows", """
SELECT 'value' AS k, value AS x FROM events UNION ALL SELECT 'price', l_extendedprice FROM lineitem UNION ALL SELECT 'quantity', l_quantity FROM lineitem""", ("events", "lineitem"))


def _bands(profile: str, key: str = "k") -> str:
    parts = [
        f"SELECT {key}, {i} AS band, '{n}' AS name, {lo} AS low, {hi} AS high FROM {profile}"
        for i, (n, lo, hi) in enumerate(T.BANDS)
    ]
    parts.append(
        f"SELECT {key}, 4, 'mean_plus_minus_1std', round(mean - std, 6), round(mean + std, 6) FROM {profile} WHERE std > 0"
    )
    return f"SELECT * FROM ({' UNION ALL '.join(parts)}) WHERE low <= high"


_ABN = """SELECT DISTINCT k, -1 AS band, 'non_null_as_abnormal_candidate' AS name, 'non_null' AS mode, NULL::DOUBLE AS low, NULL::DOUBLE AS high FROM b
UNION ALL SELECT k, band, 'outside_' || name, 'outside_interval', low, high FROM b WHERE name <> 'all_observed_non_null'"""


@query("numeric_profile", _profile("metric_rows"), ["metric_rows"])
def numeric_profile(t: Tables):
    return T.numeric_profile(t.metric_rows, ["k"], "x")


@query("numeric_profile_text", "WITH r AS (SELECT task_id AS k, " + D.num("replace(v, ',', '')") + " AS x FROM messy_cells) " + _profile("r"), ["messy_cells"])
def numeric_profile_text(t: Tables):
    return T.numeric_profile(t.messy_cells.withColumnRenamed("task_id", "k"), ["k"], "v")


def _normal(t: Tables):
    return T.normal_candidates(T.numeric_profile(t.metric_rows, ["k"], "x"), ["k"])


@query("metric_profiles", f"""WITH r AS (SELECT 'm1' AS metric, m1 AS x FROM lab_rows UNION ALL SELECT 'm2', m2 FROM lab_rows) {_profile('r', 'metric')}""", ["lab_rows"])
def metric_profiles(t: Tables):
    return T.metric_profiles(t.lab_rows, ["m1", "m2"])


@query("normal_candidates", f"WITH p AS ({_profile('metric_rows')}) {_bands('p')}", ["metric_rows"])
def normal_candidates(t: Tables):
    return _normal(t)


@query("abnormal_candidates", f"WITH p AS ({_profile('metric_rows')}), b AS ({_bands('p')}) {_ABN}", ["metric_rows"])
def abnormal_candidates(t: Tables):
    return T.abnormal_candidates(_normal(t), ["k"])


@query("band_flags", f"""WITH p AS ({_profile("(SELECT k, x FROM metric_rows WHERE k = 'value')")}), b AS ({_bands('p')})
SELECT e.event_id, CAST(sum(CASE WHEN value BETWEEN low AND high THEN 1 << band ELSE 0 END) AS BIGINT) AS inside_mask,
CAST(sum(CASE WHEN value < low OR value > high THEN 1 << band ELSE 0 END) AS BIGINT) AS outside_mask FROM events e CROSS JOIN b GROUP BY e.event_id""", ["metric_rows"])
def band_flags(t: Tables):
    normal = T.normal_candidates(T.numeric_profile(t.events, [], "value"))
    return T.band_flags(t.events, "value", normal).select("event_id", "inside_mask", "outside_mask")


_TERMS = ("balance", "white blood cell")
# Their forms.
_FORMS = ("balance", "white blood cell", "whitebloodcell", "wbc")


def _snippets() -> str:
    flat = "regexp_replace(lower(p.p), '[^a-z0-9]+', '', 'g')"
    return f"""WITH d AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '\\n\\s*\\n'), lambda x: {D.trimmed('x')}), lambda x: x <> '') AS ps FROM notes),
p AS (SELECT doc_id, generate_subscripts(ps, 1) - 1 AS i, unnest(ps) AS p FROM d)
SELECT doc_id, CAST(i AS INT) AS paragraph_index, array_to_string(regexp_extract_all(p.p, '{R.SIGNED}'), '|') AS numbers, p.p AS excerpt, FALSE AS truncated FROM p
WHERE {D.any_contains(flat, _FORMS)} AND regexp_matches(p.p, '{R.THRESHOLD_WORD}') AND regexp_matches(p.p, '{R.SIGNED}')"""


fx.define("notes", "SELECT doc_id, text FROM ward_notes UNION ALL SELECT 1000000000 + doc_id, text FROM narratives UNION ALL SELECT -1 - doc_id, text FROM documents", ("ward_notes", "narratives", "documents"))


@query("threshold_snippets", _snippets(), ["notes"])
def threshold_snippets(t: Tables):
    return T.threshold_snippets(t.notes, "doc_id", "text", _TERMS)


_POP = f"""WITH par AS (SELECT source, unnest(regexp_split_to_array(text, '\\n\\s*\\n')) AS p FROM ward_notes),
hp AS (SELECT source, p, list_distinct(regexp_extract_all(p, '{R.ENTITY_ID}', 1)) AS ids FROM par WHERE regexp_matches(p, '(?i)\\b(female|females|woman)\\b')),
sen AS (SELECT source, unnest(string_split(regexp_replace(p, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))) AS s FROM hp WHERE len(ids) <> 1),
doc AS (SELECT source, unnest(ids) AS entity_id FROM hp WHERE len(ids) = 1 UNION ALL
 SELECT source, unnest(regexp_extract_all(s, '{R.ENTITY_ID}', 1)) FROM sen WHERE regexp_matches(s, '(?i)\\b(female|females|woman)\\b')),
src AS (SELECT DISTINCT 'csv_population' AS source_type, 'lab_rows' AS source, entity_id FROM lab_rows WHERE lower(trim(sex)) IN ('female', 'females', 'f', 'woman')
UNION ALL SELECT DISTINCT 'doc_population', source, entity_id FROM doc)"""
_WANTED = ["Females", "woman"]


def _sources(t: Tables):
    a = T.table_population(t.lab_rows, F.lit("lab_rows"), "entity_id", "sex", _WANTED)
    b = T.document_population(t.ward_notes, F.col("source"), "text", _WANTED)
    return a.unionByName(b)


@query("population_sources", f"{_POP} SELECT * FROM src", ["lab_rows", "ward_notes"])
def population_sources(t: Tables):
    return _sources(t)


_GRID = f"""{_POP}, pn AS ({_profile("(SELECT 'm1' AS k, m1 AS x FROM lab_rows)")}), pa AS ({_profile("(SELECT 'm2' AS k, m2 AS x FROM lab_rows)")}),
nb AS ({_bands('pn')}), b AS ({_bands('pa')}), ab AS ({_ABN}),
hit AS (SELECT l.event_id, l.entity_id, nb.band AS n_pos, l.m1 BETWEEN nb.low AND nb.high AS nh FROM lab_rows l CROSS JOIN nb),
ahit AS (SELECT l.event_id, l.entity_id, ab.band + 1 AS a_pos, l.m2 IS NOT NULL AND (ab.mode = 'non_null' OR l.m2 < ab.low OR l.m2 > ab.high) AS ah FROM lab_rows l CROSS JOIN ab),
pr AS (SELECT h.entity_id, h.n_pos, a.a_pos, bool_or(nh AND ah) AS same, bool_or(nh) AND bool_or(ah) AS any_row FROM hit h JOIN ahit a ON h.event_id = a.event_id GROUP BY 1, 2, 3),
g AS (SELECT s.source_type, s.source, n.n_pos, a.a_pos, n.normal_name, a.abnormal_name, a.mode,
 count(*) FILTER (pr.same) AS same_row_count, count(*) FILTER (pr.any_row) AS entity_count
 FROM src s CROSS JOIN (SELECT band AS n_pos, name AS normal_name FROM nb) n CROSS JOIN (SELECT band + 1 AS a_pos, name AS abnormal_name, mode FROM ab) a
 LEFT JOIN pr ON pr.entity_id = s.entity_id AND pr.n_pos = n.n_pos AND pr.a_pos = a.a_pos GROUP BY ALL)"""


def _grid(t: Tables, sources=None):
    lab = t.lab_rows
    bands = kept(T.normal_candidates(T.metric_profiles(lab, ["m1", "m2"]), ["metric"]), "metric_bands")
    normal = bands.filter(F.col("metric") == "m1").drop("metric")
    abnormal = T.abnormal_candidates(bands.filter(F.col("metric") == "m2").drop("metric"))
    return T.probe_grid(lab, "entity_id", "m1", "m2", normal, abnormal, _sources(t) if sources is None else sources)


@query("threshold_probe_grid", f"{_GRID} SELECT * FROM g", ["lab_rows", "ward_notes"])
def threshold_probe_grid(t: Tables):
    return _grid(t)


_ORDER = "ORDER BY source_type <> 'doc_population', mode <> 'non_null', entity_count DESC, same_row_count DESC, source, n_pos, a_pos"


@query("threshold_probe_rank", f"{_GRID} SELECT * FROM g {_ORDER} LIMIT 20", ["lab_rows", "ward_notes"])
def threshold_probe_rank(t: Tables):
    return T.rank_probes(_grid(t))


@query("threshold_recommendation", f"""{_GRID}, best AS (SELECT * FROM g {_ORDER} LIMIT 1), cov AS (SELECT source_type, source, count(DISTINCT entity_id) AS entity_count FROM src GROUP BY 1, 2)
SELECT cov.*, normal_name, abnormal_name, best.entity_count AS candidate_count, same_row_count, normal_name IS NOT NULL AS recommended
FROM cov LEFT JOIN best ON best.source_type = cov.source_type AND best.source = cov.source""", ["lab_rows", "ward_notes"])
def threshold_recommendation(t: Tables):
    sources = kept(_sources(t), "population_sources")
    return T.recommendation(T.rank_probes(_grid(t, sources), 1), T.source_coverage(sources))
