"""Document quality: simple text rules and n-gram perplexity bands per language.

The language model is a modified Kneser-Ney model over characters, one per language, with
counts over all documents. Characters are mapped to 64 symbols, so a language has at most
``64 ** ORDER`` n-grams however much text there is: that bounds the model, and what is
broadcast is checked against the bound. N-grams are held as sorted arrays of hashes (the
packed symbols, which no two n-grams share) and found by binary search.

A document is rejected if its log perplexity lies outside the band of its language. Bands
come from exact order statistics of all documents of the language and length class, or of
the nearest class where it is thin.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from questloom.llm.common import small_batches, texts_of, unclashed, with_columns, written

ORDER = 4
BITS = 6
#: What the models of all languages together may take when sent to the executors.
MODEL_BYTES = 512 << 20
FIGURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _symbol_table() -> np.ndarray:
    """Symbol of each code point below 65,536; 0 is kept for the start of a text."""
    cp = np.arange(65_536, dtype=np.uint64)
    t = (32 + ((cp * np.uint64(2654435761)) >> np.uint64(13)) % np.uint64(32)).astype(np.uint8)
    t[:128] = 31
    t[:33] = 27
    t[10] = 28
    t[48:58] = 29
    for ch in ".,;:!?":
        t[ord(ch)] = 30
    t[97:123] = np.arange(1, 27)
    t[65:91] = np.arange(1, 27)
    return t


_TABLE = _symbol_table()


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def symbols(text: str) -> np.ndarray:
    return _TABLE[np.minimum(code_points(text.lower()), 65_535)]


def ngram_codes(sym: np.ndarray, order: int = ORDER) -> np.ndarray:
    """Packed n-gram that ends at each position, with start symbols before the text."""
    padded = np.concatenate([np.zeros(order - 1, np.uint8), sym]).astype(np.int32)
    codes = padded[: len(sym)].copy()
    for k in range(1, order):
        codes = (codes << BITS) | padded[k : k + len(sym)]
    return codes


def _merge(codes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    keys, inverse = np.unique(np.concatenate(codes), return_inverse=True)
    return keys, np.bincount(inverse, np.concatenate(counts)).astype(np.int64)


def count_ngrams(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """``(lang, code, n)`` over every character of every text, summed before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[str | None, list[np.ndarray]] = {}
        done: dict[str | None, tuple[np.ndarray, np.ndarray]] = {}
        n = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for name, parts in waiting.items():
                got = np.unique(np.concatenate(parts), return_counts=True)
                old = done.get(name)
                done[name] = _merge([got[0], old[0]], [got[1], old[1]]) if old else got
            waiting.clear()
            if sum(len(k) for k, _ in done.values()) > 2_000_000:
                yield from out()

        def out() -> Iterator[pa.RecordBatch]:
            for name, (keys, counts) in done.items():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(keys), pa.string()), pa.array(keys, pa.int32()), pa.array(counts, pa.int64())],
                    names=["lang", "code", "n"],
                )
            done.clear()

        for b in small_batches(batches):
            for t, name in zip(texts_of(b, "_text"), b.column(1).to_pylist(), strict=True):
                if t:
                    waiting.setdefault(name, []).append(ngram_codes(symbols(t)))
                    n += len(t)
            if n > 4_000_000:
                yield from flush()
                n = 0
        if waiting:
            yield from flush()
        yield from out()

    parts = docs.select(F.col(text).alias("_text"), F.col(lang).alias("lang")).mapInArrow(
        run, "lang string, code int, n bigint"
    )
    return parts.groupBy("lang", "code").agg(F.sum("n").alias("n"))


def _discounts(counts: np.ndarray) -> np.ndarray:
    """Discounts of counts 1, 2 and 3 or more, from the numbers of n-grams seen 1 to 4 times."""
    n = [float((counts == k).sum()) for k in range(1, 5)]
    plain = np.array([0.5, 1.0, 1.5])
    if min(n) == 0:
        return plain
    y = n[0] / (n[0] + 2 * n[1])
    d = np.array([k - (k + 1) * y * n[k] / n[k - 1] for k in (1, 2, 3)])
    return d if ((d > 0) & (d < [1, 2, 3])).all() else plain


def build_model(codes: np.ndarray, counts: np.ndarray, order: int = ORDER) -> dict[int, tuple]:
    """Order -> ``(keys, log p, contexts, log back-off weight)``, keys and contexts sorted."""
    at = np.argsort(codes)
    levels = {order: (codes[at].astype(np.int64), counts[at].astype(np.int64))}
    for n in range(order - 1, 0, -1):  # below the top: how many symbols come before
        levels[n] = np.unique(levels[n + 1][0] & ((1 << (BITS * n)) - 1), return_counts=True)
    model: dict[int, tuple] = {}
    lower = None
    for n in range(1, order + 1):
        keys, c = levels[n]
        d = _discounts(c)[np.minimum(c, 3) - 1]
        ctx, first = np.unique(keys >> BITS, return_index=True)
        size = np.diff(np.append(first, len(keys)))
        total = np.add.reduceat(c, first)
        gamma = np.add.reduceat(d, first) / total
        if n == 1:
            below = np.full(len(keys), 1.0 / (1 << BITS))
        else:
            below = np.exp(lower[1][np.searchsorted(lower[0], keys & ((1 << (BITS * (n - 1))) - 1))])
        p = (c - d) / np.repeat(total, size) + np.repeat(gamma, size) * below
        lower = (keys, np.log(p))
        model[n] = (keys.astype(np.int32), np.log(p).astype(np.float32), ctx.astype(np.int32), np.log(gamma).astype(np.float32))
    return model


def _find(keys: np.ndarray, want: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.searchsorted(keys, want)
    at[at == len(keys)] = 0
    return at, keys[at] == want


def log_probs(codes: np.ndarray, model: dict[int, tuple], order: int = ORDER) -> np.ndarray:
    """Log probability of the last symbol of each n-gram, backing off where it is unseen."""
    out = np.zeros(len(codes), np.float64)
    left = np.arange(len(codes))
    for n in range(order, 0, -1):
        keys, logp, ctx, back = model[n]
        part = codes[left] & ((1 << (BITS * n)) - 1)
        at, hit = _find(keys, part)
        out[left[hit]] += logp[at[hit]]
        left, part = left[~hit], part[~hit]
        if not len(left):
            return out
        at, known = _find(ctx, part >> BITS)
        out[left[known]] += back[at[known]]
    out[left] += np.log(1.0 / (1 << BITS))
    return out


def train(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """The models as a table: one row per language and order, arrays as bytes."""

    def build(key, pdf):
        import pandas as pd

        made = build_model(pdf["code"].to_numpy(), pdf["n"].to_numpy())
        rows = [(key[0], n, *(a.tobytes() for a in arrays)) for n, arrays in made.items()]
        return pd.DataFrame(rows, columns=["lang", "n", "keys", "logp", "ctx", "back"])

    counts = count_ngrams(docs, text, lang)
    return written(
        counts.groupBy("lang").applyInPandas(
            build, "lang string, n int, keys binary, logp binary, ctx binary, back binary"
        ),
        "models",
    )


def language_groups(models: DataFrame, most: int = MODEL_BYTES) -> list[list[str | None]]:
    """Languages in groups whose models together take at most ``most`` bytes (or one each)."""
    parts = " + ".join(f"octet_length({c})" for c in ("keys", "logp", "ctx", "back"))
    sizes = models.groupBy("lang").agg(F.sum(F.expr(parts)).alias("n")).collect()
    groups: list[list[str | None]] = []
    free = 0
    for r in sorted(sizes, key=lambda r: (r["lang"] is None, r["lang"] or "")):
        if not groups or r["n"] > free:
            groups.append([])
            free = most
        groups[-1].append(r["lang"])
        free -= r["n"]
    return groups


def _speaks(lang: str, names: list[str | None]) -> Column:
    known = F.coalesce(F.col(lang).isin([n for n in names if n is not None]), F.lit(False))
    return known | F.col(lang).isNull() if None in names else known


def load(models: DataFrame) -> dict[str | None, dict[int, tuple]]:
    """Models as arrays; the caller has chosen languages of bounded size."""
    out: dict[str | None, dict[int, tuple]] = {}
    for r in models.toLocalIterator():
        out.setdefault(r["lang"], {})[r["n"]] = (
            np.frombuffer(r["keys"], np.int32), np.frombuffer(r["logp"], np.float32),
            np.frombuffer(r["ctx"], np.int32), np.frombuffer(r["back"], np.float32),
        )
    return out


def repeated_words(words: list[bytes], n: int = 5) -> int:
    """Words covered by n-word windows that occur twice or more in the text."""
    if len(words) <= n:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.array([seen.setdefault(w, len(seen)) for w in words], np.uint64)
    if len(seen) == len(words):
        return 0
    m = len(words) - n + 1
    h = np.zeros(m, np.uint64)
    for k in range(n):  # equal windows have equal sums; unequal ones are told apart below
        h += (ids[k : k + m] + np.uint64(1)) * np.uint64((0x9E3779B97F4A7C15 * (2 * k + 1) ** 5) % 2**64 | 1)
    order = np.argsort(h, kind="stable")
    twin = h[order[1:]] == h[order[:-1]]
    if not twin.any():
        return 0
    shared = np.zeros(m, bool)
    shared[order[1:][twin]] = shared[order[:-1][twin]] = True
    places: dict[tuple, list[int]] = {}
    for i in np.flatnonzero(shared).tolist():
        places.setdefault(tuple(ids[i : i + n].tolist()), []).append(i)
    cover = np.zeros(len(words) + 1, np.int64)
    for at in places.values():
        if len(at) > 1:
            np.add.at(cover, at, 1)
            np.add.at(cover, [i + n for i in at], -1)
    return int((np.cumsum(cover)[:-1] > 0).sum())


def text_rules(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words; splits at ASCII space."""
    words = text.encode("utf-8", "surrogatepass").split()
    space = sum(map(text.count, " \t\n\x0b\x0c\r"))
    seen: set[str] = set()
    dup = 0
    if "\n" in text:
        for line in text.split("\n"):
            if line in seen:
                dup += 1
            elif line.strip(" \t\n\x0b\x0c\r"):
                seen.add(line)
    return (
        len(words), len(text) - space, sum(map(text.count, "#*$%&|<>")), dup, repeated_words(words),
    )


def measure(
    docs: DataFrame, text: str = "text", lang: str = "lang", most: int = MODEL_BYTES, sent: list | None = None
) -> DataFrame:
    """``docs`` with the rule figures and ``log_ppl`` (null without text or model).

    Models are sent to the executors for as many languages at a time as ``most`` bytes
    hold; each document is scored in the pass of its language. The figures' names must be
    free; ``judge`` and ``accept`` see to that. What was sent is added to ``sent``, to be
    destroyed once the result is written.
    """
    models = train(docs, text, lang)
    groups = language_groups(models, most) or [[]]
    later = [_speaks(lang, g) for g in groups[1:]]
    sent = [] if sent is None else sent
    out = _score(docs.filter(~reduce(Column.__or__, later)) if later else docs, models.filter(_speaks("lang", groups[0])), text, lang, sent)
    for names, mine in zip(groups[1:], later, strict=True):
        out = out.unionByName(_score(docs.filter(mine), models.filter(_speaks("lang", names)), text, lang, sent))
    return out


def _score(docs: DataFrame, some: DataFrame, text: str, lang: str, sent: list) -> DataFrame:
    models = docs.sparkSession.sparkContext.broadcast(load(some))
    sent.append(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_lang = models.value
        for b in small_batches(batches):
            texts, langs = texts_of(b, text), b.column(b.schema.get_field_index(lang)).to_pylist()
            figures = list(zip(*map(text_rules, texts), strict=True))
            ppl: list[float | None] = [None] * len(texts)
            for name in set(langs):
                at = [i for i, t in enumerate(texts) if langs[i] == name and t]
                if not at or name not in by_lang:
                    continue
                codes = [ngram_codes(symbols(texts[i])) for i in at]
                ends = np.cumsum([len(c) for c in codes])
                sums = np.diff(np.concatenate([[0.0], np.cumsum(log_probs(np.concatenate(codes), by_lang[name]))])[np.concatenate([[0], ends])])
                for i, s, c in zip(at, sums, codes, strict=True):
                    ppl[i] = float(-s / len(c))
            yield with_columns(
                b, **{n: pa.array(f, pa.int64()) for n, f in zip(FIGURES, figures, strict=True)},
                log_ppl=pa.array(ppl, pa.float64()),
            )

    schema = T.StructType([*docs.schema.fields, *[T.StructField(n, T.LongType()) for n in FIGURES]])
    return docs.mapInArrow(run, schema.add("log_ppl", "double"))


_STEP = 1000.0


def _cuts(bins: DataFrame, by: list[str], **at: float) -> DataFrame:
    """Number of documents and order statistics of ``_bin`` (steps of 1/1000) per group."""
    upto = Window.partitionBy(*by).orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)
    share = bins.withColumn("_share", F.sum("_n").over(upto) / F.sum("_n").over(Window.partitionBy(*by)))
    cut = [(F.min(F.when(F.col("_share") >= q, F.col("_bin"))) / _STEP).alias(name) for name, q in at.items()]
    return share.groupBy(*by).agg(F.sum("_n").alias("_docs"), *cut)


def centres(measured: DataFrame, min_docs: int, lang: str = "lang") -> DataFrame:
    """``(lang, _class, _from, mid)``: the class whose band a length class takes, and its median.

    A class of ``min_docs`` documents is its own; a thinner one takes the nearest such class
    of its language, the longer of two. A language without one (``_from`` null) has the median
    of all its documents. Figures are counted in steps of 1/1000 first, so a window sees at
    most a few thousand rows per language and class.
    """
    bins = (
        measured.filter(F.col("log_ppl").isNotNull())
        .groupBy(F.col(lang).alias("lang"), "_class", F.round(F.col("log_ppl") * _STEP).alias("_bin"))
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    bins = written(bins, "bins")
    classes = _cuts(bins, ["lang", "_class"], mid=0.5)
    full = classes.filter(F.col("_docs") >= min_docs).select(F.col("lang").alias("_l"), F.col("_class").alias("_from"), "mid")
    near = F.struct(F.abs(F.col("_class") - F.col("_from")).alias("far"), (-F.col("_from")).alias("of"), F.col("mid"))
    chosen = (
        classes.select("lang", "_class").join(full, F.col("lang").eqNullSafe(F.col("_l")), "left")
        .groupBy("lang", "_class").agg(F.min(F.when(F.col("_from").isNotNull(), near)).alias("b"))
    )
    whole = _cuts(bins.groupBy("lang", "_bin").agg(F.sum("_n").alias("_n")), ["lang"], all=0.5).select(F.col("lang").alias("_l"), "all")
    return chosen.join(whole, F.col("lang").eqNullSafe(F.col("_l"))).select(
        "lang", "_class", (-F.col("b.of")).alias("_from"), F.coalesce("b.mid", "all").alias("mid")
    )


def bands(placed: DataFrame, least: float) -> DataFrame:
    """``(lang, _from, low, high)``: deviations ``away`` down to the 16th and up to the 84th percentile.

    Each is at least ``least``.
    """
    own = placed.filter(F.col("_class") == F.col("_from"))
    bins = own.groupBy("lang", "_from", F.round(F.col("away") * _STEP).alias("_bin")).agg(F.count(F.lit(1)).alias("_n"))
    return _cuts(bins, ["lang", "_from"], low=0.16, high=0.84).select(
        "lang", "_from", F.greatest(-F.col("low"), F.lit(least)).alias("low"), F.greatest(F.col("high"), F.lit(least)).alias("high")
    )


def _beside(rows: DataFrame, table: DataFrame, on: list[tuple[str, str]], salts: int) -> DataFrame:
    """``rows`` with the columns of a small table; a hot key's rows are dealt over ``salts``."""
    salt = F.pmod(F.xxhash64("log_ppl", "n_words", "word_chars"), F.lit(salts)).cast("int")
    copies = table.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    same = reduce(Column.__and__, [F.col(a).eqNullSafe(F.col(b)) for a, b in on], F.col("_salt") == F.col("_s"))
    return rows.withColumn("_salt", salt).join(copies, same, "left").drop("_salt", "_s")


def _verdicts(
    docs: DataFrame, text: str, lang: str, wide: float, least: float, min_docs: int, salts: int, slim: bool
) -> DataFrame:
    kind = F.floor(F.log2(F.greatest(F.length(F.col(text)), F.lit(1))) / 2).cast("int")
    sent: list = []
    measured = measure(docs, text, lang, sent=sent).withColumn("_class", F.coalesce(kind, F.lit(0))).withColumn("_len", F.length(F.col(text)))
    measured = written(measured.drop(text) if slim else measured, "measured")
    for models in sent:
        models.destroy()
    centre = centres(measured, min_docs, lang).select(F.col("lang").alias("_at_lang"), F.col("_class").alias("_at_class"), "_from", "mid")
    # Small tables are written, so that no plan holds the ones before it, over and over.
    centre = written(centre, "centres")
    placed = _beside(measured, centre, [(lang, "_at_lang"), ("_class", "_at_class")], salts)
    # The figure of a short text strays further: deviations count by the fourth root of its length.
    scale = F.pow(F.col("_len") / F.pow(F.lit(4.0), F.coalesce("_from", "_class") + 0.5), F.lit(0.25))
    placed = placed.withColumn("away", (F.col("log_ppl") - F.col("mid")) * scale)
    limits = written(bands(placed.select(F.col(lang).alias("lang"), "_class", "_from", "away"), least), "bands")
    usual = limits.agg(F.avg("low").alias("u_low"), F.avg("high").alias("u_high"))
    limits = limits.select(F.col("lang").alias("_in_lang"), F.col("_from").alias("_in_class"), "low", "high")
    joined = _beside(placed, limits, [(lang, "_in_lang"), ("_from", "_in_class")], salts)
    low = F.coalesce("low", usual.select("u_low").scalar())
    high = F.coalesce("high", usual.select("u_high").scalar())
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    outside = F.coalesce((F.col("away") < -wide * low) | (F.col("away") > wide * high), F.lit(False))
    return joined.withColumn("base_failed", failed).withColumn("kept", ~failed & ~outside).withColumn(
        "perplexity", F.exp("log_ppl")
    )


def judge(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    id_col: str = "doc_id",
    wide: float = 4.0,
    least: float = 0.02,
    min_docs: int = 30,
    salts: int = 64,
) -> DataFrame:
    """``(id_col, *figures, base_failed, kept, perplexity)`` per row of ``docs``.

    ``base_failed``: fewer than 10 words, or over a fifth of the words in repeated
    windows. ``kept``: not failed and inside the band of its language and length class
    (powers of four of the number of characters): ``wide`` deviations round the median. A
    class of under ``min_docs`` documents takes the band of the nearest class of its
    language; a language without one is judged round its own median by the mean deviations
    of all bands; where no class of any language is full, nothing is rejected. A null
    language is a language of its own. Null and
    empty texts have 0 words and fail. Repeated rows are judged alike; an empty table gives
    an empty one; other columns are not read.
    """
    docs = unclashed(docs, id_col, text, lang).toDF("_id", "_text", "_lang")
    out = _verdicts(docs, "_text", "_lang", wide, least, min_docs, salts, slim=True)
    return out.select(F.col("_id").alias(id_col), *FIGURES, "base_failed", "kept", "perplexity")


def accept(
    docs: DataFrame, text: str = "text", lang: str = "lang", wide: float = 4.0, least: float = 0.02,
    min_docs: int = 30, salts: int = 64,
) -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, with all their columns, whatever the names."""
    names = docs.columns
    safe = {n: f"_c{i}" for i, n in enumerate(names)}
    out = _verdicts(docs.toDF(*safe.values()), safe[text], safe[lang], wide, least, min_docs, salts, slim=False)
    return out.filter("kept").select(*safe.values()).toDF(*names)
