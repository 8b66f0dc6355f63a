"""Search prose and turn it into entity-keyed evidence, corpus-wide.

Every rule works inside the row that holds the text; only merging by entity shuffles.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from questloom.functions.values import any_contains, bound, trimmed
from questloom.rules import documents as R
from questloom.sources.files import paragraphs


def _hit(c: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def _last(c: Column, pattern: str) -> Column:
    return F.try_element_at(F.regexp_extract_all(c, F.lit(pattern), F.lit(1)), F.lit(-1))


def _number(c: Column) -> Column:
    return F.regexp_extract(c, R.NUMBER, 0).try_cast("double")


def squeeze(c: Column, n: int) -> Column:
    return F.substring(trimmed(F.regexp_replace(c, r"\s+", " ")), 1, n)


def search(
    df: DataFrame, doc: str, text: str, query: str, first: int | None = None, excerpt_chars: int | None = None
) -> DataFrame:
    """Paragraphs that contain the query, case ignored: all and whole, unless limits are given.

    ``truncated`` tells that a limit left out paragraphs of the document or a part of this one.
    """
    parts = F.filter(
        F.transform(F.split(F.col(text), "\n\n"), lambda p: trimmed(p)), lambda p: p != ""
    )
    numbered = F.transform(parts, lambda p, i: F.struct(i.alias("i"), p.alias("p")))
    hits = F.filter(numbered, lambda n: F.lower(n["p"]).contains(query.lower()))
    found = df.select(doc, hits.alias("_h"))
    shown, more = (F.col("_h"), F.lit(False)) if first is None else (F.slice("_h", 1, first), F.size("_h") > first)
    excerpt, cut = F.col("h.p"), F.lit(False)
    if excerpt_chars is not None:
        excerpt, cut = F.substring("h.p", 1, excerpt_chars), F.char_length("h.p") > excerpt_chars
    return found.select(doc, more.alias("_more"), F.explode(shown).alias("h")).select(
        doc, F.col("h.i").alias("paragraph_index"), excerpt.alias("excerpt"), (F.col("_more") | cut).alias("truncated")
    )


def entity_id(p: Column, hint: str) -> Column:
    """First id found by the ordered patterns around a hint word."""
    return F.when(p.rlike("[0-9]"), bound(F.lower(p), lambda low: F.coalesce(*_id_tries(p, low, hint))))


def _held(low: Column, words: Sequence[str]) -> Column:
    """False where lower-case text holds none of the words; a word that is not ASCII counts as held.

    Patterns that ignore case do so for ASCII letters only, so they fit no text this rules out.
    """
    return any_contains(low, words) if words and all(w.isascii() for w in words) else F.lit(True)


def _id_tries(p: Column, low: Column, hint: str) -> list[Column]:
    import re

    said = hint.strip() or "patient"
    hinted = R.HINTED_ID.replace("{hint}", re.escape(said))
    every = [(hinted, (said.lower(),)), *zip(R.PLAIN_IDS, R.PLAIN_ID_WORDS, strict=True)]
    return [F.when(_held(low, words), _hit(p, x)) for x, words in every]


def entity_id_any(p: Column, hint: str) -> Column:
    """As :func:`entity_id`, then the other hint words, then a compact ``ID: n`` form.

    Only the first pattern depends on the hint, so the others are tried once.
    """
    others = [(R.HINTED_ID.replace("{hint}", h), (h,)) for h in R.ID_HINTS if h != hint]

    def tried(low: Column) -> Column:
        more = [F.when(_held(low, words), _hit(p, x)) for x, words in (*others, (R.COMPACT_ID, R.COMPACT_ID_WORDS))]
        return F.coalesce(*_id_tries(p, low, hint), *more)

    return F.when(p.rlike("[0-9]"), bound(F.lower(p), tried))


def best_sentence(p: Column, term: str) -> Column:
    """Last sentence that names the term, better with a number and without a doubt word."""
    t = R.searched(term)

    def choose(named: Column) -> Column:
        sure = F.filter(named, lambda s: ~any_contains(F.lower(s), R.INVALID_WORDS))
        return bound(F.when(F.size(sure) > 0, sure).otherwise(named), last)

    def last(pool: Column) -> Column:
        counted = F.filter(pool, lambda s: s.rlike(rf"(?i){t}[^.?!]{{0,180}}\d"))
        return F.coalesce(F.try_element_at(counted, F.lit(-1)), F.try_element_at(pool, F.lit(-1)))

    named = F.filter(F.split(p, R.SENTENCE_GAP), lambda s: s.rlike(f"(?i){t}"))
    return trimmed(F.coalesce(F.when(p.rlike(f"(?i){t}"), bound(named, choose)), p))


def metric_number(s: Column, term: str) -> Column:
    """Number after a metric: corrected values first (last one), then plain wording."""
    t = R.searched(term)
    fixed = [_last(s, x) for x in R.corrected_number(t)]
    plain = [_hit(s, x) for x in R.simple_number(t)]
    return F.when(s.rlike("[0-9]"), _number(F.coalesce(*fixed, *plain)))


def metric_year(s: Column, term: str) -> Column:
    """Year within 180 characters of the metric."""
    tail = F.substring(F.regexp_extract(s, rf"(?is){R.searched(term)}.*", 0), 1, 180)
    return F.regexp_extract(tail, R.YEAR, 0).try_cast("bigint")


def records(df: DataFrame, doc: str, text: str, terms: Sequence[str], hint: str) -> DataFrame:
    """One row per paragraph and named term. The term list is short and becomes literals."""
    p = F.col("paragraph")
    found = []
    for term in (t.strip() for t in terms if t.strip()):
        found.append(F.when(p.rlike(f"(?i){R.searched(term)}"), _record(p, term)))
    return (
        paragraphs(df, text, keep=[doc])
        .select(doc, "paragraph_index", entity_id(p, hint).alias("entity_id"), F.explode(F.array_compact(F.array(*found))).alias("r"))
        .select(doc, "paragraph_index", "entity_id", "r.*")
    )


def _record(p: Column, term: str) -> Column:
    def build(s: Column) -> Column:
        return F.struct(
            F.lit(term).alias("matched_term"), metric_number(s, term).alias("number"),
            metric_year(s, term).alias("year"), squeeze(s, 360).alias("sentence"),
        )

    return bound(best_sentence(p, term), build)


def field_value(s: Column, names: Sequence[str]) -> Column:
    """``struct(confidence, value)`` of a field in a sentence; NULL when there is none.

    ``names`` are all names of the field; a longer one is tried before one it may contain.
    """
    return bound(F.lower(s), lambda low: _field_value(s, low, names))


def _field_value(s: Column, low: Column, names: Sequence[str]) -> Column:
    """As :func:`field_value`. A pattern is tried only where the words it needs stand."""
    terms = sorted(set(names), key=lambda n: (-len(n), n))

    def told(name: str) -> Column:
        out = F.lit(True)
        for word in name.lower().split():
            out = out & _held(low, (word,))
        return out

    def tried(corrected: Column) -> Column:
        fixed = F.when(corrected, 8).otherwise(0)
        held = F.when(low.contains("placeholder") & low.contains("field"), 5).otherwise(0)
        tries: list[Column] = []

        def add(may: Column, v: Column, conf: Column) -> None:
            tries.append(F.when(may, bound(v, lambda x: packed(x, conf))))

        for name in terms:
            if name in R.PLACEHOLDER_FIELDS:
                add(told(name) & _held(low, R.PLACEHOLDER_WORDS), _hit(s, R.placeholder_field(name)), F.lit(80) + held)
        for name in terms:
            for pattern in R.corrected_field(R.worded(name)):
                add(told(name) & corrected, _last(s, pattern), F.lit(90) + fixed)
        for name in terms:
            for pattern, words in zip(R.direct_field(R.worded(name), name), R.DIRECT_WORDS):
                add(told(name) & _held(low, words), _hit(s, pattern), F.lit(60) + fixed)
        add(F.lit(True), _last(s, f"({R.NUMBER})"), F.lit(20) + fixed)
        return F.coalesce(*tries)

    def packed(v: Column, conf: Column) -> Column:
        return F.when(
            v.isNotNull(), F.struct(conf.alias("confidence"), v.try_cast("double").alias("value"))
        )

    some = F.lit(False)
    for name in terms:
        some = some | told(name)
    named = "(?i)" + "|".join(R.worded(n) for n in terms)
    # Every pattern ends in a number.
    return F.when(some & s.rlike("[0-9]") & s.rlike(named), bound(any_contains(low, R.CORRECTIONS), tried))


def _sentences(p: Column) -> Column:
    """The sentences of a paragraph, each with its lower-case form."""
    said = F.filter(F.transform(F.split(p, R.SENTENCE_GAP), lambda x: trimmed(x)), lambda x: x != "")
    return F.transform(said, lambda s: F.struct(s.alias("s"), F.lower(s).alias("low")))


def _best_field(sentences: Column, names: Sequence[str]) -> Column:
    """Best sentence of a paragraph for a field: highest confidence, earliest sentence."""
    scored = F.transform(
        sentences,
        lambda x, i: bound(
            _field_value(x["s"], x["low"], names),
            lambda fv: F.when(
                fv.isNotNull(),
                F.struct(
                    fv["confidence"].alias("confidence"), (-i).alias("order"),
                    fv["value"].alias("value"), squeeze(x["s"], 260).alias("snippet"),
                ),
            ),
        ),
    )
    return F.array_max(F.array_compact(scored))


def field_values(df: DataFrame, doc: str, text: str, fields: Mapping[str, Sequence[str]], hint: str) -> DataFrame:
    """Candidate values: one row per entity paragraph and field; ``fields`` gives all names of each."""
    p = F.col("paragraph")
    found = bound(_sentences(p), lambda x: F.array(
        *[F.struct(F.lit(field).alias("field"), _best_field(x, names).alias("b")) for field, names in fields.items()]
    ))
    known = F.col("entity_id").isNotNull()
    return (
        paragraphs(df, text, keep=[doc]).filter(p.rlike("[0-9]"))
        .withColumn("entity_id", entity_id_any(p, hint))
        # A filter here would be pushed below and run the id patterns twice.
        .select(doc, "paragraph_index", "entity_id", F.explode(F.when(known, found)).alias("r"))
        .filter(F.col("r.b").isNotNull())
        .select(
            doc, "paragraph_index", "entity_id", "r.field", "r.b.confidence", "r.b.value",
            "r.b.snippet",
        )
    )


def merge_fields(values: DataFrame, doc: str) -> DataFrame:
    """Per entity and field the value with higher confidence, then the later paragraph."""
    best = F.max(F.struct("confidence", "paragraph_index", doc, "value", "snippet")).alias("b")
    return values.groupBy("entity_id", "field").agg(best).select(
        "entity_id", "field", "b.value", "b.confidence", "b.paragraph_index", "b.snippet"
    )


def evidence_table(values: DataFrame, doc: str, fields: Sequence[str]) -> DataFrame:
    """One row per entity, one column and one evidence struct per field, one aggregate."""
    aggs = []
    for field in fields:
        best = F.max(
            F.when(F.col("field") == field, F.struct("confidence", "paragraph_index", doc, "value", "snippet"))
        )
        aggs.append(best.alias(f"_{field}"))
    wide = values.groupBy("entity_id").agg(*aggs)
    cols = []
    for field in fields:
        b = F.col(f"`_{field}`")
        cols.append(b["value"].alias(field))
        cols.append(
            F.when(
                b.isNotNull(),
                F.struct(b["paragraph_index"].alias("paragraph_index"), b["snippet"].alias("snippet"), b["confidence"].alias("confidence")),
            ).alias(f"{field}_evidence")
        )
    return wide.select("entity_id", *cols).orderBy(F.length("entity_id"), "entity_id")


def coverage(table: DataFrame, fields: Sequence[str]) -> DataFrame:
    full = F.lit(True)
    for f in fields:
        full = full & F.col(f"`{f}`").isNotNull()
    return table.agg(
        F.count(F.lit(1)).alias("entity_count"),
        *[F.count(F.col(f"`{f}`")).alias(f"{f}_coverage") for f in fields],
        F.count_if(full).alias("complete_record_count"),
    )


def linked_ids(df: DataFrame, doc: str, text: str, targets: DataFrame, target: str) -> DataFrame:
    """Ids that share a paragraph with a target id.

    Ids meet targets by equality; the partners come from the paragraph's own array.
    """
    ids = F.array_distinct(F.regexp_extract_all("paragraph", F.lit(R.LINK_ID), F.lit(0)))
    rows = paragraphs(df, text, gap=r"\n\s*\n", keep=[doc]).withColumn("_ids", ids)
    asked = rows.select(doc, "_ids", F.explode("_ids").alias(target)).join(
        targets.select(target).distinct(), target
    )
    return asked.select(
        doc, target, F.explode(F.array_remove("_ids", F.col(target))).alias("linked_id")
    ).distinct()


def id_in_category(df: DataFrame, doc: str, text: str, category: str) -> DataFrame:
    """Ids that share a paragraph with a category word."""
    rows = paragraphs(df, text, gap=r"\n\s*\n", keep=[doc])
    return rows.filter(F.lower("paragraph").contains(category.lower())).select(
        doc, F.explode(F.regexp_extract_all("paragraph", F.lit(R.LINK_ID), F.lit(0))).alias("linked_id")
    ).distinct()


def scored_amounts(df: DataFrame, doc: str, text: str) -> DataFrame:
    """Best-scored amount per document and id; equal scores keep the first paragraph."""
    ids = F.array_distinct(F.regexp_extract_all("paragraph", F.lit(R.LINK_ID), F.lit(0)))
    one = F.regexp_replace("paragraph", r"\s+", " ")
    rows = paragraphs(df, text, gap=r"\n\s*\n", keep=[doc]).select(
        doc, "paragraph_index", one.alias("_p"), F.explode(ids).alias("id")
    )
    # The text after each mention of the id, in order.
    parts = F.split("_p", F.concat(F.lit(r"\Q"), F.col("id"), F.lit(r"\E")))
    tails = F.transform(
        F.sequence(F.lit(2), F.size("_parts")),
        lambda k: F.call_function(
            "array_join", F.slice("_parts", k, F.size("_parts")), F.col("id")
        ),
    )

    def first_tail(pattern: str) -> Column:
        hits = F.filter(F.transform("_tails", lambda x: _hit(x, pattern)), lambda h: h.isNotNull())
        return F.try_element_at(hits, F.lit(1))

    top, final = R.FINAL_AMOUNT
    tries = [(top, _hit(F.col("_p"), final))] + [(s, first_tail(x)) for s, x in R.SCORED_AMOUNTS]
    found = F.array_compact(
        F.array(
            *[
                F.when(v.isNotNull(), F.struct(F.lit(s).alias("score"), v.try_cast("double").alias("amount")))
                for s, v in tries
            ]
        )
    )
    scored = rows.withColumn("_parts", parts).withColumn("_tails", tails).select(
        doc, "paragraph_index", "id", F.explode(found).alias("f")
    )
    best = F.max(F.struct(F.col("f.score").alias("s"), (-F.col("paragraph_index")).alias("o"), F.col("f.amount").alias("a")))
    return scored.groupBy(doc, "id").agg(best.alias("b")).select(
        doc, "id", F.col("b.s").alias("score"), F.col("b.a").alias("amount")
    )


def key_lookup(
    df: DataFrame, doc: str, text: str, wanted: DataFrame, name: str, year: str,
    title: str = R.EVENT_TITLE, key: str = R.RACE_ID,
) -> DataFrame:
    """Key number stated in the first paragraph that names a title and a year.

    Titles are read from the paragraphs by the pattern ``title``, keys by ``key`` (a group
    each; the defaults are examples), and meet the wanted ones by equality.
    """
    one = trimmed(F.regexp_replace("paragraph", r"\s+", " "))
    titles = F.transform(
        F.regexp_extract_all("_p", F.lit(title), F.lit(1)), lambda x: F.lower(x)
    )
    rows = (
        paragraphs(df, text, gap=r"\n\s*\n", keep=[doc]).withColumn("_p", one)
        .withColumn("_key", _hit(F.col("_p"), key)).filter(F.col("_key").isNotNull())
        .withColumn("_title", F.explode(F.array_distinct(F.flatten(F.transform(titles, _tails_of)))))
    )
    ask = wanted.select(name, year, F.lower(F.col(name)).alias("_title")).distinct()
    hits = rows.join(ask, "_title").filter(F.col("_p").contains(F.col(year).cast("string")))
    return hits.groupBy(name, year).agg(
        F.min_by("_key", F.struct(doc, "paragraph_index")).alias("key")
    )


def _tails_of(title: Column) -> Column:
    """A title and its endings at word starts: 'the red cup' also names 'red cup'."""
    words = F.split(title, " ")
    return F.transform(
        F.sequence(F.lit(1), F.size(words)), lambda i: F.array_join(F.slice(words, i, F.size(words)), " ")
    )
