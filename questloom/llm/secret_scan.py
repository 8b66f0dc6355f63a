"""Secret scan: fixed patterns plus sliding-window entropy; DataFrame functions only.

A candidate string is slid over with a window of ``WINDOW`` characters. The window's
entropy is ``log2(W) - S / W`` with ``S`` the sum of ``c * log2(c)`` over the counts of its
characters; a step changes two counts, so ``S`` is updated, not computed anew. Each
character class has its own threshold. An allow-list suppresses strings that look random
but are not secret. Nothing is shuffled; only texts that hold a candidate are taken apart.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from questloom.llm.common import unclashed

# The base patterns in the order in which kinds are listed, with the shortest
# length of the part that counts (a group of the match, 0: all of it).
BASE = (
    (
        "assign",
        r"(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]"
        r"|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"
        r"[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
        1, 8,
    ),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]{32,}", 0, 32),
)

WINDOW = 20
#: Shortest candidate; one shorter than a window is a window of its own.
LEAST = 16
#: Candidate class, its pattern, and the entropy in bits that a window must reach; a shorter
#: one must reach the same share of what its length allows.
CLASSES = (
    ("entropy_hex", r"(?<![A-Za-z0-9+/_=-])[0-9A-Fa-f]{16,}+(?![A-Za-z0-9+/_=-])", 3.2),
    ("entropy_text", r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}+", 3.9),
)
#: Never secret, each with its whole layout after leading separators: identifiers, integrity
#: sums with a name, sample keys (a name may be joined to them).
ALLOW = (
    r"^[/_=-]*+[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
    r"|^[/_=-]*+sha(?:1-(?:[A-Za-z0-9+/]{27}=?|[0-9a-f]{40})|256-(?:[A-Za-z0-9+/]{43}=?|[0-9a-f]{64})"
    r"|384-(?:[A-Za-z0-9+/]{64}|[0-9a-f]{96})|512-(?:[A-Za-z0-9+/]{86}(?:==)?|[0-9a-f]{128}))$"
    r"|^(?:[A-Za-z_-]++=++|[/_=-]++)?(?:A[KS]IA[A-Z0-9]{9}EXAMPLE|[A-Za-z0-9+/]{30}EXAMPLEKEY)$"
)
#: Parts of paths and names: a word in one case or with capitals at its joints, then a number.
JOINT = r"[/_=-]++"
WORDLIKE = r"^(?:[A-Z]?[a-z]++|[A-Z]++|(?:[A-Z]?[a-z]{2,}+)++)[0-9]{0,4}$"
#: A candidate shorter than a window must mix letters and digits.
MIXED = r"(?s)(?=.*[0-9])(?=.*[A-Za-z])"

_SPAN = "struct<kind:string,start:bigint,end:bigint,hit:string>"
_MARK, _OTHER = "\x01", "\x02"


def spans(text: Column, kind: str, pattern: str) -> Column:
    """Array of ``(kind, start, end, hit)``, leftmost non-overlapping, in code points.

    Matches are set off by a mark that no pattern knows (a mark in the text itself is
    first turned into another character of the same width); then every second part is a
    match, and running lengths give the places.
    """
    clean = F.translate(text, _MARK, _OTHER)
    parts = F.split(F.regexp_replace(clean, f"({pattern})", f"{_MARK}$1{_MARK}"), _MARK, -1)
    none = F.array().cast(f"array<{_SPAN}>")

    def step(acc: Column, part: Column) -> Column:
        end = acc["at"] + F.char_length(part)
        found = F.array(
            F.struct(F.lit(kind).alias("kind"), acc["at"].alias("start"), end.alias("end"), part.alias("hit"))
        )
        return F.struct(
            end.alias("at"), (~acc["odd"]).alias("odd"),
            F.when(acc["odd"], F.concat(acc["out"], found)).otherwise(acc["out"]).alias("out"),
        )

    zero = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit(False).alias("odd"), none.alias("out"))
    return F.aggregate(parts, zero, step, lambda acc: acc["out"])


def _weight(c: Column) -> Column:
    return F.when(c > 1, c * F.log2(c)).otherwise(F.lit(0.0))


def top_entropy(s: Column, window: int = WINDOW, piece: int = 256) -> Column:
    """The highest entropy of any window of ``s``; null if ``s`` is shorter than a window.

    Long strings are slid over in pieces that overlap by a window less one, each cut out
    once, so the time grows with the length.
    """
    w = F.lit(window)

    def count(where: Column, ch: Column) -> Column:
        return F.length(where) - F.length(F.replace(where, ch, F.lit("")))

    def slide(p: Column) -> Column:
        def step(acc: Column, t: Column) -> Column:
            ch = F.substr(p, t, F.lit(1))
            out = F.substr(acc["win"], F.lit(1), F.lit(1))
            full = F.length(acc["win"]) == w
            less = count(acc["win"], out)
            s1 = F.when(full, acc["s"] - _weight(less) + _weight(less - 1)).otherwise(acc["s"])
            rest = F.when(full, F.substr(acc["win"], F.lit(2))).otherwise(acc["win"])
            more = count(rest, ch)
            s2 = s1 + _weight(more + 1) - _weight(more)
            bits = F.when(t >= w, F.log2(w.cast("double")) - s2 / w).otherwise(acc["best"])
            return F.struct(
                F.concat(rest, ch).alias("win"), s2.alias("s"), F.greatest(acc["best"], bits).alias("best")
            )

        zero = F.struct(F.lit("").alias("win"), F.lit(0.0).alias("s"), F.lit(-1.0).alias("best"))
        return F.aggregate(F.sequence(F.lit(1), F.length(p)), zero, step, lambda acc: acc["best"])

    starts = F.sequence(F.lit(1), F.length(s) - (window - 1), F.lit(piece - window + 1))
    cut = F.transform(starts, lambda i: F.substr(s, i, F.lit(piece)))
    return F.when(F.length(s) >= w, F.array_max(F.transform(cut, slide)))


def whole_entropy(s: Column) -> Column:
    """The entropy of a short string as one window."""
    times = F.transform(F.array_distinct(F.split(s, "")), lambda ch: F.length(s) - F.length(F.replace(s, ch, F.lit(""))))
    total = F.aggregate(times, F.lit(0.0), lambda acc, c: acc + _weight(c))
    return F.log2(F.length(s).cast("double")) - total / F.length(s)


def _long_enough(pattern: str, group: int, least: int):
    def test(x: Column) -> Column:
        part = F.regexp_extract(x["hit"], pattern, group) if group else x["hit"]
        return F.char_length(part) >= least

    return test


def _random_enough(bits: float):
    share = bits / math.log2(WINDOW)

    def test(x: Column) -> Column:
        s = x["hit"]
        short = whole_entropy(s) >= F.log2(F.length(s).cast("double")) * share
        return F.when(F.length(s) < WINDOW, short).otherwise(top_entropy(s) >= bits)

    return test


def _harmless(hit: Column) -> Column:
    """A known layout, or a path or name made of words alone."""
    return hit.rlike(ALLOW) | F.forall(F.split(hit, JOINT), lambda part: (part == "") | part.rlike(WORDLIKE))


def _outside(x: Column, base: Column) -> Column:
    """The parts of a candidate that no base match covers; ``base`` by start."""

    def part(start: Column, end: Column) -> Column:
        hit = F.substr(x["hit"], (start - x["start"] + 1).cast("int"), (end - start).cast("int"))
        return F.array(F.struct(x["kind"].alias("kind"), start.alias("start"), end.alias("end"), hit.alias("hit")))

    def step(acc: Column, b: Column) -> Column:
        return F.struct(
            F.greatest(acc["at"], b["end"]).alias("at"),
            F.when(b["start"] > acc["at"], F.concat(acc["out"], part(acc["at"], b["start"]))).otherwise(acc["out"]).alias("out"),
        )

    zero = F.struct(x["start"].alias("at"), F.array().cast(f"array<{_SPAN}>").alias("out"))
    touching = F.filter(base, lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"]))
    return F.aggregate(
        touching, zero, step,
        lambda acc: F.when(acc["at"] < x["end"], F.concat(acc["out"], part(acc["at"], x["end"]))).otherwise(acc["out"]),
    )


def find_secrets(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``(id_col, base, added, spans, n_*)`` per row: arrays of ``(kind, start, end, hit)``.

    ``base`` holds the pattern matches by start and kind as listed; ``added`` the strings
    of high entropy, without what base matches cover; ``spans`` both, in the same order. Null and empty texts have none; texts of any
    length are read whole; repeated rows and null ids are rows like any other.
    """
    none = F.array().cast(f"array<{_SPAN}>")
    found = unclashed(docs, id_col, text).select(
        id_col, F.coalesce(F.col(text), F.lit("")).alias("_t")
    )
    for kind, pattern, group, least in BASE:
        quick = F.col("_t").contains("AKIA") if kind == "access" else F.col("_t").rlike(pattern)
        all_found = F.when(quick, spans(F.col("_t"), kind, pattern)).otherwise(none)
        found = found.withColumn(f"_{kind}", F.filter(all_found, _long_enough(pattern, group, least)))
    order = F.array(*[F.lit(k) for k, *_ in (*BASE, *CLASSES)])

    def by_start(*cols: str) -> Column:
        keyed = F.transform(
            F.concat(*[F.col(c) for c in cols]),
            lambda x: F.struct(x["start"].alias("start"), F.array_position(order, x["kind"]).alias("o"), x.alias("x")),
        )
        return F.transform(F.array_sort(keyed), lambda y: y["x"])

    found = found.withColumn("base", by_start("_assign", "_access", "_hex"))
    for kind, pattern, bits in CLASSES:
        quick = F.col("_t").rlike(pattern)
        whole = F.when(quick, spans(F.col("_t"), kind, pattern)).otherwise(none)
        candidates = F.filter(
            F.flatten(F.transform(whole, lambda x: _outside(x, F.col("base")))),
            lambda x: (F.length(x["hit"]) >= LEAST)
            & ((F.length(x["hit"]) >= WINDOW) | x["hit"].rlike(MIXED)) & ~_harmless(x["hit"]),
        )
        found = found.withColumn(f"_c_{kind}", candidates).withColumn(
            f"_{kind}",
            F.filter(f"_c_{kind}", _random_enough(bits)),
        )
    extra = [f"_{k}" for k, *_ in CLASSES]
    # A string of hex digits is a candidate of both classes: keep it once.
    once = F.filter(
        by_start(*extra),
        lambda x: (x["kind"] == CLASSES[0][0])
        | ~F.exists("_entropy_hex", lambda h: (h["start"] < x["end"]) & (x["start"] < h["end"])),
    )
    found = found.withColumn("added", once)
    return found.select(
        id_col, "base", "added", by_start("base", "added").alias("spans"),
        *[F.size(f"_{k}").cast("long").alias(f"n_{k}") for k, *_ in BASE],
    )


def spans_text(col: Column) -> Column:
    """``kind:start:end``, comma-joined in the order given."""
    return F.array_join(
        F.transform(col, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))),
        ",",
    )

