"""Document search and extraction."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from questloom.operators import documents as O
from questloom.plans import duck as D
from questloom.plans import fixtures as fx
from questloom.plans.registry import Tables, query
from questloom.rules import documents as R

fx.define("prose", "SELECT doc_id, text FROM narratives UNION ALL SELECT -1 - doc_id, text FROM documents", ("narratives", "documents"))

fx.define("case_notes", """
SELECT c_custkey AS doc_id, 'Operative file number ' || CAST(c_custkey AS STRING) || ' stands tall. Their height was recorded as ' || CAST(150 + c_nationkey AS STRING) || '. Weight is unknown!' || chr(10) || chr(10) ||
 'The hero registered under the unique identifier ' || CAST(c_custkey AS STRING) || ' weighs in; body weight ' || CAST(60 + c_nationkey AS STRING) || '.5 kg. The field holds placeholder data of 0.0 for height.' || chr(10) || chr(10) ||
 'Curse (ID: ' || CAST(c_custkey AS STRING) || ') has a publisher affiliation finalized as ' || CAST(c_nationkey AS STRING) || ' in ' || CAST(1950 + c_custkey % 50 AS STRING) || '.' AS text
FROM customer""", ("customer",), ("customer",))

fx.define("budget_notes", """
SELECT c_custkey AS doc_id, 'Budget recB' || CAST(c_custkey AS STRING) || ' supports event recE' || CAST(c_nationkey AS STRING) || ' under ' || c_mktsegment || '.' || chr(10) || ' ' || chr(10) ||
 'Here recB' || CAST(c_custkey AS STRING) || ' was allocated 1' || CAST(c_nationkey AS STRING) || '.25 in total. Then' || chr(10) || 'recB' || CAST(c_custkey AS STRING) || ' is the' || chr(10) || 'one.' || chr(10) || chr(10) ||
 CASE c_custkey % 4 WHEN 0 THEN 'After review recB' || CAST(c_custkey AS STRING) || ' was revised upward to an amount of ' || CAST(200 + c_nationkey AS STRING) || '.'
  WHEN 1 THEN 'For recB' || CAST(c_custkey AS STRING) || ' the final budget shows an amount of ' || CAST(300 + c_nationkey AS STRING) || '.'
  WHEN 2 THEN 'recB' || CAST(c_custkey AS STRING) || ' funded with ' || CAST(400 + c_nationkey AS STRING) || ' units' ELSE 'No more on recX1.' END AS text
FROM customer""", ("customer",), ("customer",))

fx.define("race_notes", """
SELECT c_custkey AS doc_id, 'Nothing here.' || chr(10) || chr(10) || 'The ' || c_mktsegment || ' Grand Prix of ' || CAST(1990 + c_nationkey AS STRING) || ' has' || chr(10) || ' Race ID: ' || CAST(c_custkey AS STRING) || ' in the book.' AS text FROM customer""", ("customer",), ("customer",))

fx.define("race_asks", """
SELECT DISTINCT c_mktsegment || ' Grand Prix' AS name, 1990 + c_nationkey AS year FROM customer""", ("customer",))

_PARTS = "list_filter(list_transform({split}, lambda x: " + D.trimmed("x") + "), lambda x: x <> '')"


def _par(source: str, gap: str = "\\n\\n") -> str:
    ps = _PARTS.format(split=f"regexp_split_to_array(text, '{gap}')")
    return f"""d0 AS (SELECT doc_id, {ps} AS ps FROM {source}), par AS (SELECT doc_id, CAST(generate_subscripts(ps, 1) - 1 AS INT) AS paragraph_index, unnest(ps) AS p FROM d0)"""


def _ex(c: str, p: str, g: int = 1) -> str:
    return f"NULLIF(regexp_extract({c}, '{p}', {g}), '')"


def _last(c: str, p: str) -> str:
    return f"(regexp_extract_all({c}, '{p}', 1))[-1]"


def _num(c: str) -> str:
    return f"TRY_CAST(regexp_extract({c}, '{R.NUMBER}') AS DOUBLE)"


def _sent(c: str) -> str:
    return f"string_split(regexp_replace({c}, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))"


def _squeeze(c: str, n: int) -> str:
    return f"substr({D.trimmed(f'regexp_replace({c}, $$\\s+$$, $$ $$, $$g$$)')}, 1, {n})"


def _entity(c: str, hint: str) -> str:
    hinted = R.HINTED_ID.replace("{hint}", re.escape(hint))
    return "coalesce(" + ", ".join(_ex(c, p) for p in (hinted, *R.PLAIN_IDS)) + ")"


def _entity_any(c: str, hint: str) -> str:
    others = [R.HINTED_ID.replace("{hint}", h) for h in R.ID_HINTS if h != hint]
    return f"coalesce({_entity(c, hint)}, {', '.join(_ex(c, p) for p in (*others, R.COMPACT_ID))})"


def _best(c: str, term: str) -> str:
    x = R.searched(term)
    named = f"list_filter({_sent(c)}, lambda s: regexp_matches(s, '(?i){x}'))"
    sure = f"list_filter({named}, lambda s: NOT {D.any_contains('lower(s)', R.INVALID_WORDS)})"
    pool = f"CASE WHEN len({sure}) > 0 THEN {sure} ELSE {named} END"
    digits = f"list_filter({pool}, lambda s: regexp_matches(s, '(?i){x}[^.?!]{{0,180}}\\d'))"
    return D.trimmed(f"coalesce(({digits})[-1], ({pool})[-1], {c})")


def _metric(s: str, term: str) -> str:
    x = R.searched(term)
    parts = [_last(s, p) for p in R.corrected_number(x)] + [_ex(s, p) for p in R.simple_number(x)]
    return _num(f"coalesce({', '.join(parts)})")


def _year(s: str, term: str) -> str:
    return f"TRY_CAST(regexp_extract(substr(regexp_extract({s}, '(?is){R.searched(term)}.*'), 1, 180), '{R.YEAR}') AS BIGINT)"


@query("doc_search", f"""WITH {_par('prose')} SELECT doc_id, paragraph_index, p AS excerpt, FALSE AS truncated FROM par WHERE contains(lower(p), 'the ')""", ["prose"])
def doc_search(t: Tables):
    return O.search(t.prose, "doc_id", "text", "The ")


@query("doc_entity_ids", f"""WITH {_par('prose')}, c AS (SELECT 'c' AS k, doc_id, p FROM par), n AS ({"WITH " + _par('case_notes') + " SELECT doc_id, p FROM par"})
SELECT doc_id, p AS paragraph, {_entity('p', 'client')} AS entity_id FROM c UNION ALL SELECT doc_id, p, {_entity('p', 'client')} FROM n""", ["prose", "case_notes"])
def doc_entity_ids(t: Tables):
    docs = t.prose.unionByName(t.case_notes)
    p = O.paragraphs(docs, "text", keep=["doc_id"])
    return p.select("doc_id", "paragraph", O.entity_id(F.col("paragraph"), "client").alias("entity_id"))


_TWO = ("balance", "height")
_BOTH = "both_docs"
fx.define(_BOTH, "SELECT doc_id, text FROM narratives UNION ALL SELECT 1000000000 + doc_id, text FROM case_notes UNION ALL SELECT -1 - doc_id, text FROM documents", ("narratives", "case_notes", "documents"))


@query("doc_best_sentence", f"WITH {_par(_BOTH)} SELECT doc_id, paragraph_index, {_best('p', 'balance')} AS sentence FROM par", [_BOTH])
def doc_best_sentence(t: Tables):
    p = O.paragraphs(t.both_docs, "text", keep=["doc_id"])
    return p.select("doc_id", "paragraph_index", O.best_sentence(F.col("paragraph"), "balance").alias("sentence"))


@query("doc_metric_number", f"WITH {_par(_BOTH)} SELECT doc_id, paragraph_index, {_metric('p', 'balance')} AS balance, {_metric('p', 'height')} AS height FROM par", [_BOTH])
def doc_metric_number(t: Tables):
    p = O.paragraphs(t.both_docs, "text", keep=["doc_id"])
    c = F.col("paragraph")
    return p.select("doc_id", "paragraph_index", O.metric_number(c, "balance").alias("balance"), O.metric_number(c, "height").alias("height"))


@query("doc_metric_year", f"WITH {_par(_BOTH)} SELECT doc_id, paragraph_index, {_year('p', 'balance')} AS year FROM par", [_BOTH])
def doc_metric_year(t: Tables):
    p = O.paragraphs(t.both_docs, "text", keep=["doc_id"])
    return p.select("doc_id", "paragraph_index", O.metric_year(F.col("paragraph"), "balance").alias("year"))


_REC = " UNION ALL ".join(
    f"SELECT doc_id, paragraph_index, p, '{x}' AS matched_term, {_best('p', x)} AS s FROM par WHERE regexp_matches(p, '(?i){R.searched(x)}')" for x in _TWO
)


@query("doc_records", f"""WITH {_par(_BOTH)}, r AS ({_REC})
SELECT doc_id, paragraph_index, {_entity('p', 'client')} AS entity_id, matched_term, CASE matched_term WHEN 'balance' THEN {_metric('s', 'balance')} ELSE {_metric('s', 'height')} END AS number,
CASE matched_term WHEN 'balance' THEN {_year('s', 'balance')} ELSE {_year('s', 'height')} END AS year, {_squeeze('s', 360)} AS sentence FROM r""", [_BOTH])
def doc_records(t: Tables):
    return O.records(t.both_docs, "doc_id", "text", _TWO, "client")


_FIELDS = {f: (f, *R.FIELD_ALIASES.get(f, ())) for f in ("height", "weight", "publisher affiliation", "balance")}


def _field(s: str, field: str) -> str:
    terms = sorted(set(_FIELDS[field]), key=lambda n: (-len(n), n))
    fixed = f"CASE WHEN {D.any_contains(f'lower({s})', R.CORRECTIONS)} THEN 8 ELSE 0 END"
    held = f"CASE WHEN contains(lower({s}), 'placeholder') AND contains(lower({s}), 'field') THEN 5 ELSE 0 END"
    tries = [(_ex(s, R.placeholder_field(n)), f"80 + {held}") for n in terms if n in R.PLACEHOLDER_FIELDS]
    tries += [(_last(s, p), f"90 + {fixed}") for n in terms for p in R.corrected_field(R.worded(n))]
    tries += [(_ex(s, p), f"60 + {fixed}") for n in terms for p in R.direct_field(R.worded(n), n)]
    tries.append((_last(s, f"({R.NUMBER})"), f"20 + {fixed}"))
    named = "|".join(R.worded(n) for n in terms)
    whens = " ".join(f"WHEN {v} IS NOT NULL THEN {{'c': {c}, 'v': TRY_CAST({v} AS DOUBLE)}}" for v, c in tries)
    return f"CASE WHEN NOT regexp_matches({s}, '(?i){named}') THEN NULL {whens} END"


_VALS = f"""{_par(_BOTH)}, e AS (SELECT *, {_entity_any('p', 'client')} AS entity_id FROM par),
s AS (SELECT doc_id, paragraph_index, entity_id, {D.trimmed('x.s')} AS s, x.i AS i FROM e, LATERAL (SELECT unnest({_sent('e.p')}) AS s, generate_subscripts({_sent('e.p')}, 1) AS i) x WHERE entity_id IS NOT NULL),
f AS ({" UNION ALL ".join(f"SELECT *, '{x}' AS field, {_field('s', x)} AS fv FROM s WHERE s <> ''" for x in _FIELDS)}),
vals AS (SELECT doc_id, paragraph_index, entity_id, field, fv.c AS confidence, fv.v AS value, {_squeeze('s', 260)} AS snippet FROM f WHERE fv IS NOT NULL
 QUALIFY row_number() OVER (PARTITION BY doc_id, paragraph_index, entity_id, field ORDER BY fv.c DESC, i) = 1),
merged AS (SELECT * FROM vals QUALIFY row_number() OVER (PARTITION BY entity_id, field ORDER BY confidence DESC, paragraph_index DESC, doc_id DESC) = 1)"""


def _values(t: Tables):
    return O.field_values(t.both_docs, "doc_id", "text", _FIELDS, "client")


@query("doc_field_value", f"WITH {_VALS} SELECT doc_id, paragraph_index, entity_id, field, CAST(confidence AS INT) AS confidence, value, snippet FROM vals", [_BOTH])
def doc_field_value(t: Tables):
    return _values(t)


@query("doc_entity_merge", f"WITH {_VALS} SELECT entity_id, field, value, CAST(confidence AS INT) AS confidence, paragraph_index, snippet FROM merged", [_BOTH])
def doc_entity_merge(t: Tables):
    return O.merge_fields(_values(t), "doc_id")


def _wide(expr: str, name: str) -> str:
    return ", ".join(
        f"""max(CASE WHEN field = '{x}' THEN {expr} END) AS "{x}{name}\"""" for x in _FIELDS
    )


@query("doc_evidence_table", f"WITH {_VALS} SELECT entity_id, {_wide('value', '')}, {_wide('confidence', ' confidence')}, {_wide('snippet', ' snippet')} FROM merged GROUP BY entity_id", [_BOTH])
def doc_evidence_table(t: Tables):
    wide = O.evidence_table(_values(t), "doc_id", _FIELDS)
    cols = [F.col(f"`{x}`") for x in _FIELDS]
    conf = [F.col(f"`{x}_evidence`.confidence").alias(f"{x} confidence") for x in _FIELDS]
    snip = [F.col(f"`{x}_evidence`.snippet").alias(f"{x} snippet") for x in _FIELDS]
    return wide.select("entity_id", *cols, *conf, *snip)


@query("doc_coverage", f"""WITH {_VALS}, w AS (SELECT entity_id, {_wide('value', '')} FROM merged GROUP BY entity_id)
SELECT count(*) AS entity_count, {', '.join(f'count("{x}") AS "{x}_coverage"' for x in _FIELDS)}, count(*) FILTER ({' AND '.join(f'"{x}" IS NOT NULL' for x in _FIELDS)}) AS complete_record_count FROM w""", [_BOTH])
def doc_coverage(t: Tables):
    return O.coverage(O.evidence_table(_values(t), "doc_id", _FIELDS), _FIELDS)


_BGAP = "\\n\\s*\\n"


def _amount_sql() -> str:
    top, final = R.FINAL_AMOUNT

    def tail(p: str) -> str:
        hits = f"list_filter(list_transform(tails, lambda x: regexp_extract(x, '{p}', 1)), lambda h: h <> '')"
        return f"({hits})[1]"

    parts = [f"SELECT doc_id, paragraph_index, id, {top} AS score, {_ex('p', final)} AS a FROM tl"]
    parts += [f"SELECT doc_id, paragraph_index, id, {s}, {tail(x)} FROM tl" for s, x in R.SCORED_AMOUNTS]
    return f"""WITH {_par('budget_notes', _BGAP)}, ids AS (SELECT DISTINCT doc_id, paragraph_index, regexp_replace(p, '\\s+', ' ', 'g') AS p, unnest(regexp_extract_all(p, '{R.LINK_ID}')) AS id FROM par),
tl AS (SELECT *, list_transform(range(2, len(string_split(p, id)) + 1), lambda k: list_reduce((string_split(p, id))[k:], lambda a, b: a || id || b)) AS tails FROM ids),
s AS ({' UNION ALL '.join(parts)}) SELECT doc_id, id, CAST(score AS INT) AS score, TRY_CAST(a AS DOUBLE) AS amount FROM s WHERE a IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY doc_id, id ORDER BY score DESC, paragraph_index) = 1"""


@query("doc_scored_amount", _amount_sql(), ["budget_notes"])
def doc_scored_amount(t: Tables):
    return O.scored_amounts(t.budget_notes, "doc_id", "text")


_LINK = f"""WITH {_par('budget_notes', _BGAP)}, ids AS (SELECT DISTINCT doc_id, paragraph_index, unnest(regexp_extract_all(p, '{R.LINK_ID}')) AS id FROM par)"""


@query("doc_comention_links", f"""{_LINK}, c AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(p, '{R.LINK_ID}')) AS id FROM par WHERE contains(lower(p), 'building'))
SELECT DISTINCT a.doc_id, a.id AS event_id, b.id AS linked_id, c.id IS NOT NULL AS in_category FROM ids a JOIN ids b ON a.doc_id = b.doc_id AND a.paragraph_index = b.paragraph_index AND a.id <> b.id
LEFT JOIN c ON c.doc_id = b.doc_id AND c.id = b.id WHERE a.id IN (SELECT 'recE' || n_nationkey FROM nation)""", ["budget_notes"])
def doc_comention_links(t: Tables):
    targets = t.nation.select(F.concat(F.lit("recE"), F.col("n_nationkey").cast("string")).alias("event_id"))
    links = O.linked_ids(t.budget_notes, "doc_id", "text", targets, "event_id")
    cat = O.id_in_category(t.budget_notes, "doc_id", "text", "Building").withColumn("_c", F.lit(True))
    return links.join(cat, ["doc_id", "linked_id"], "left").select(
        "doc_id", "event_id", "linked_id", F.coalesce("_c", F.lit(False)).alias("in_category")
    )


@query("doc_key_lookup", f"""WITH {_par('race_notes', _BGAP)}, k AS (SELECT doc_id, paragraph_index, regexp_replace(p, '\\s+', ' ', 'g') AS p FROM par),
h AS (SELECT a.name, a.year, {_ex('k.p', R.RACE_ID)} AS key, doc_id, paragraph_index FROM race_asks a JOIN k ON contains(lower(k.p), lower(a.name)) AND contains(k.p, CAST(a.year AS VARCHAR)))
SELECT name, year, key FROM h WHERE key IS NOT NULL QUALIFY row_number() OVER (PARTITION BY name, year ORDER BY doc_id, paragraph_index) = 1""", ["race_notes", "race_asks"])
def doc_key_lookup(t: Tables):
    return O.key_lookup(t.race_notes, "doc_id", "text", t.race_asks, "name", "year")
