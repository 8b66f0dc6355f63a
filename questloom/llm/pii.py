"""Personal data: fixed patterns, and terms that give a protected value away.

Protected entities are the values that the patterns find. How much of an entity a term
reveals is estimated from the whole corpus: with document counts ``n_e``, ``n_t`` and
``n_et`` (the term within ``reach`` words of the entity) the pointwise information is
``log2(n_et * N / (n_e * n_t))``, and its share of the entity's own ``log2(N / n_e)`` is
the disclosure. Where a document names the entity, terms near it whose disclosure passes
``remove`` are removed and those past ``generalise`` become a class word. Evidence must
come from ``min_contexts`` different surroundings, so that copies of one text prove nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from questloom.llm.common import row_key, small_batches, texts_of, unclashed, written

KINDS = ("email", "ip", "card", "phone")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match cannot begin inside a run of digits: the run before it would have matched or failed alike.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
TERM = re.compile(r"[^\W\d_]{4,}")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """From each ``@`` outwards: the run before it, then the domain. Linear in the text."""
    free = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        free = m.end() if m else at + 1
        if m:
            yield start, m.end()
        at = text.find("@", free)


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _whole(number: str) -> bool:
    """At most 255, whatever its leading zeros and length."""
    return len(cut := number.lstrip("0")) <= 3 and int(cut or 0) <= 255


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans ``(kind, start, end)`` by kind as listed, then start; code points, end exclusive."""
    out = [("email", s, e) for s, e in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        if "." in text:
            out += [("ip", *m.span()) for m in _IP.finditer(text) if all(map(_whole, m[0].split(".")))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 16:
                digits = m[0].replace(" ", "").replace("-", "")
                if 16 <= len(digits) <= 19 and luhn(digits):
                    out.append(("card", *m.span()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 8 <= len(_DIGIT.findall(m[0])) <= 15:
                    out.append(("phone", *m.span()))
    return out


def _hash(s: str) -> int:
    return xxhash.xxh64_intdigest(s) - (1 << 63)


def entity(kind: str, value: str) -> int:
    """A protected value without its writing: lower case, numbers without separators."""
    return _hash(f"{kind}:{value.lower() if kind in ('email', 'ip') else ''.join(_DIGIT.findall(value))}")


def contexts(text: str, spans: list[tuple[str, int, int]], reach: int) -> list[dict]:
    """Terms near each protected value: entity, term, place, and a hash of the surroundings."""
    out, first = [], set()
    taken = sorted((s, e) for _, s, e in spans)
    for kind, s, e in spans:
        # Terms cut by the ends of the looked-at stretch are left out.
        low, high = max(0, s - 40 * reach), min(len(text), e + 40 * reach)
        left = [m for m in TERM.finditer(text, low, s) if m.start() > low or low == 0][-reach:]
        right = [m for m in TERM.finditer(text, e, high) if m.end() < high or high == len(text)][:reach]
        near = [m for m in left + right if not any(a < m.end() and m.start() < b for a, b in taken)]
        here = _hash(" ".join(m[0].lower() for m in near))
        who = entity(kind, text[s:e])
        for m in near:
            term = _hash(m[0].lower())
            new = (who, term) not in first
            first.add((who, term))
            out.append({"e": who, "t": term, "w": here, "s": m.start(), "z": m.end(), "new": new})
    return out


_CONTEXT = pa.struct([("e", pa.int64()), ("t", pa.int64()), ("w", pa.int64()), ("s", pa.int32()), ("z", pa.int32()), ("new", pa.bool_())])


def find_base(docs: DataFrame, reach: int = 8, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``(_k1, _k2, id_col, spans, near, held)`` per row; ``held`` lists the row's entities."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches):
            spans, near, held = [], [], []
            for t in texts_of(b, "_text"):
                found = base_spans(t)
                spans.append([{"kind": k, "start": s, "end": e} for k, s, e in found])
                near.append(contexts(t, found, reach) if found else [])
                held.append(sorted({entity(k, t[s:e]) for k, s, e in found}))
            kept = b.drop_columns(["_text"])
            yield pa.RecordBatch.from_arrays(
                [*kept.columns, pa.array(spans, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))),
                 pa.array(near, pa.list_(_CONTEXT)), pa.array(held, pa.list_(pa.int64()))],
                names=[*kept.schema.names, "spans", "near", "held"],
            )

    base = docs.select(*row_key(id_col, text), F.col(id_col), F.col(text).alias("_text"))
    schema = (
        f"_k1 bigint, _k2 bigint, {id_col} {docs.schema[id_col].dataType.simpleString()}, "
        "spans array<struct<kind:string,start:int,end:int>>, "
        "near array<struct<e:bigint,t:bigint,w:bigint,s:int,z:int,new:boolean>>, held array<bigint>"
    )
    return base.mapInArrow(run, schema)


def term_documents(docs: DataFrame, text: str = "text", flush: int = 300_000) -> DataFrame:
    """``(t, n_t)``: how many documents hold each term, over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, int] = {}

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays(
                [pa.array(map(_hash, counts), pa.int64()), pa.array(counts.values(), pa.int64())], names=["t", "n"]
            )
            counts.clear()
            return made

        for b in small_batches(batches):
            for t in texts_of(b, "_text"):
                for w in set(TERM.findall(t.lower())):
                    counts[w] = counts.get(w, 0) + 1
            if len(counts) > flush:
                yield out()
        if counts:
            yield out()

    parts = docs.select(F.col(text).alias("_text")).mapInArrow(run, "t bigint, n bigint")
    return parts.groupBy("t").agg(F.sum("n").alias("n_t"))


def disclosing_terms(
    base: DataFrame, docs: DataFrame, generalise: float, remove: float, min_contexts: int, text: str = "text"
) -> DataFrame:
    """``(e, t, disclosure, action)`` for the terms that reveal an entity."""
    n = F.lit(float(max(1, base.count())))
    # A document counts once for an entity and a term; first per surroundings, then over them.
    per_doc = (
        base.filter(F.size("near") > 0).select(F.explode("near").alias("x")).filter("x.new").select("x.e", "x.t", "x.w")
    )
    pairs = (
        per_doc.groupBy("e", "t", "w").agg(F.count(F.lit(1)).alias("n"))
        .groupBy("e", "t").agg(F.sum("n").alias("n_et"), F.count(F.lit(1)).alias("n_w"))
        .filter(F.col("n_w") >= min_contexts)
    )
    pairs = written(pairs, "term-pairs")
    entities = base.select(F.explode("held").alias("e")).groupBy("e").agg(F.count(F.lit(1)).alias("n_e"))
    wanted = pairs.select("t").distinct()
    terms = term_documents(docs, text).join(wanted, "t", "left_semi")
    info = F.log2(F.col("n_et") * n / (F.col("n_e") * F.col("n_t")))
    own = F.log2(n / F.col("n_e"))
    return (
        pairs.join(entities, "e").join(terms, "t")
        .withColumn("disclosure", F.coalesce(F.try_divide(info, own), F.lit(0.0)))
        .filter(F.col("disclosure") >= generalise)
        .select("e", "t", "disclosure", F.when(F.col("disclosure") >= remove, "remove").otherwise("generalise").alias("action"))
    )


def find_personal_data(
    docs: DataFrame,
    reach: int = 8,
    generalise: float = 0.6,
    remove: float = 0.8,
    min_contexts: int = 3,
    salts: int = 32,
    text: str = "text",
    id_col: str = "doc_id",
) -> DataFrame:
    """``(_k1, _k2, id_col, spans, terms)`` per row.

    ``spans``: the pattern spans ``(kind, start, end)``; ``terms``: ``(start, end, action)``
    of revealing terms, by place. Null and empty texts have neither. Repeated rows get the
    same spans and count as often as they occur; null ids are ids like any other.
    """
    docs = unclashed(docs, id_col, text)
    base = written(find_base(docs, reach, text, id_col), "pii-base")
    found = disclosing_terms(base, docs, generalise, remove, min_contexts, text).withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    )
    near = (
        base.filter(F.size("near") > 0)
        .select("_k1", "_k2", F.pmod("_k1", F.lit(salts)).cast("int").alias("_salt"), F.explode("near").alias("x"))
        .select("_k1", "_k2", "_salt", "x.e", "x.t", "x.s", "x.z")
        .distinct()
    )
    terms = (
        near.join(found, ["e", "t", "_salt"])
        .groupBy("_k1", "_k2")
        .agg(F.array_sort(F.collect_set(F.struct(F.col("s").alias("start"), F.col("z").alias("end"), "action"))).alias("terms"))
    )
    none = F.array().cast("array<struct<start:int,end:int,action:string>>")
    return base.drop("near", "held").join(terms, ["_k1", "_k2"], "left").withColumn(
        "terms", F.coalesce("terms", none)
    )


def sanitise(docs: DataFrame, text: str = "text", id_col: str = "doc_id", **params) -> DataFrame:
    """``docs`` with protected values and revealing terms replaced in ``text``.

    Values become ``[EMAIL]`` and so on, general terms ``[TERM]``, removed terms nothing.
    Null texts stay null; all columns stay, whatever their names.
    """
    names = docs.columns
    safe = {n: f"_c{i}" for i, n in enumerate(names)}
    docs, text, id_col = docs.toDF(*safe.values()), safe[text], safe[id_col]
    found = find_personal_data(docs, text=text, id_col=id_col, **params)
    cuts = F.concat(
        F.transform("spans", lambda x: F.struct(x["start"].alias("s"), x["end"].alias("z"), F.concat(F.lit("["), F.upper(x["kind"]), F.lit("]")).alias("as"))),
        F.transform("terms", lambda x: F.struct(x["start"].alias("s"), x["end"].alias("z"), F.when(x["action"] == "remove", "").otherwise("[TERM]").alias("as"))),
    )
    marks = found.select("_k1", "_k2", F.array_sort(cuts).alias("_cuts")).filter(F.size("_cuts") > 0).dropDuplicates(["_k1", "_k2"])
    keyed = docs.select("*", *row_key(id_col, text))

    # From left to right; a span that begins inside the one before it only lengthens it.
    def step(acc, x):
        begin = F.greatest(acc["at"], x["s"])
        return F.struct(
            F.greatest(acc["at"], x["z"]).alias("at"),
            F.when(x["s"] < acc["at"], acc["out"]).otherwise(
                F.concat(acc["out"], F.substr(F.col(text), acc["at"] + 1, begin - acc["at"]), x["as"])
            ).alias("out"),
        )

    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    new = F.aggregate("_cuts", zero, step, lambda acc: F.concat(acc["out"], F.substr(F.col(text), acc["at"] + 1)))
    done = keyed.join(marks, ["_k1", "_k2"], "left").withColumn(
        text, F.when(F.col("_cuts").isNull(), F.col(text)).otherwise(new)
    )
    return done.select(*safe.values()).toDF(*names)
