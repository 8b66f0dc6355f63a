"""Language identification: sparse multinomial logistic regression on character n-grams.

Features are hashed n-grams of one to three characters, weighted by TF-IDF. Document
frequencies come from all training documents; the weights are fitted by follow the
regularised leader with L1 and L2 penalties on a bounded sample, and a temperature fitted
on a held-back part of that sample calibrates the scores.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from questloom.llm.common import row_key, small_batches, texts_of, unclashed

BITS = 16
DIM = 1 << BITS
SCALE = 10.0
_LETTER = regex.compile(r"\p{L}")
UNKNOWN = "und"
#: What the weights of all languages may take when sent to the executors: 2,048 languages.
MODEL_BYTES = 512 << 20


def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(65_536)), bool, 65_536)


_IS_LETTER = _letters()


def features(text: str) -> np.ndarray:
    """Hashed n-grams of every position; what is no letter is one space."""
    cp = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _IS_LETTER[np.minimum(cp, 65_535)] | (cp > 65_535)
    c = np.where(letter, cp, 32).astype(np.uint64)
    c = np.concatenate([[np.uint64(32)], c, [np.uint64(32)]])
    c = c[np.concatenate([[True], (c[1:] != 32) | (c[:-1] != 32)])]
    a, b, d = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
    one = c * a
    two = (one[:-1] ^ (c[1:] + np.uint64(7))) * b
    three = (two[:-1] ^ (c[2:] + np.uint64(13))) * d
    shift = np.uint64(64 - BITS)
    return np.concatenate([one >> shift, two >> shift, three >> shift]).astype(np.int32)


def term_frequencies(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The distinct features of a text and their share of all its features."""
    counts = np.bincount(features(text), minlength=DIM)
    at = np.flatnonzero(counts)
    return at, counts[at] / counts.sum()


def document_frequencies(docs: DataFrame, text: str) -> DataFrame:
    """``(j, n)``: documents that hold feature j, over all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(DIM, np.int64)
        for b in small_batches(batches):
            for t in texts_of(b, "_text"):
                seen = np.zeros(DIM, bool)
                seen[features(t)] = True
                total += seen
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], names=["j", "n"])

    parts = docs.select(F.col(text).alias("_text")).mapInArrow(run, "j int, n bigint")
    return parts.groupBy("j").agg(F.sum("n").alias("n"))


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def ftrl(
    rows: list[tuple[np.ndarray, np.ndarray, int]], k: int, alpha: float, beta: float, l1: float, l2: float, epochs: int
) -> np.ndarray:
    """Weights (DIM, k) after ``epochs`` passes of per-coordinate FTRL-proximal updates."""
    z, n = np.zeros((DIM, k)), np.zeros((DIM, k))

    def weights(zi: np.ndarray, ni: np.ndarray) -> np.ndarray:
        return np.where(np.abs(zi) > l1, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2), 0.0)

    for _ in range(epochs):
        for at, x, y in rows:
            zi, ni = z[at], n[at]
            w = weights(zi, ni)
            p = _softmax(x @ w)
            p[y] -= 1.0
            g = x[:, None] * p[None, :]
            sigma = (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha
            z[at] = zi + g - sigma * w
            n[at] = ni + g * g
    return weights(z, n)


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least log loss, by a grid that is refined twice."""
    grid = np.geomspace(0.05, 20.0, 41)
    for _ in range(3):
        loss = [-np.log(np.maximum(_softmax(logits / t)[np.arange(len(y)), y], 1e-12)).mean() for t in grid]
        i = int(np.argmin(loss))
        grid = np.geomspace(grid[max(0, i - 1)], grid[min(len(grid) - 1, i + 1)], 21)
    return float(grid[len(grid) // 2])


def fit(
    train: DataFrame,
    sample: int = 8000,
    text: str = "text",
    lang: str = "lang",
    alpha: float = 0.5,
    beta: float = 1.0,
    l1: float = 0.02,
    l2: float = 0.01,
    epochs: int = 3,
) -> dict | None:
    """The model learned from ``train``: labels, weights with IDF folded in, temperature.

    ``sample`` bounds the labelled rows that the weights are fitted on: each language gives
    an equal share (in expectation; rows are chosen by a hash), so one task fits at most
    about ``sample`` sparse rows. Document frequencies cover every training row. None if
    there is no labelled row with a letter.
    """
    docs = train.filter(F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}")).select(lang, text, *row_key(text))
    sizes = {r[lang]: r["n"] for r in docs.groupBy(lang).agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return None
    labels = sorted(sizes)
    if DIM * len(labels) * 4 > MODEL_BYTES:
        raise ValueError(f"{len(labels)} languages need a model of over {MODEL_BYTES} bytes")
    share = F.create_map(*[F.lit(x) for name, n in sizes.items() for x in (name, min(1.0, sample / len(labels) / n))])
    draw = F.pmod("_k2", F.lit(1 << 30)) / float(1 << 30)
    chosen = docs.filter(draw < F.try_element_at(share, F.col(lang)))
    idf_rows = document_frequencies(docs, text).collect()
    total = sum(sizes.values())
    idf = np.zeros(DIM)
    for r in idf_rows:
        idf[r["j"]] = np.log((1 + total) / (1 + r["n"])) + 1.0

    def run(key, pdf):
        import pandas as pd

        pdf = pdf.sort_values(["_k1", "_k2", lang], kind="stable")
        rows, held = [], []
        for t, y, k in zip(pdf[text], pdf[lang], pdf["_k1"], strict=True):
            at, tf = term_frequencies(t)
            (held if k % 5 == 0 else rows).append((at, SCALE * tf * idf[at], labels.index(y)))
        w = ftrl(rows, len(labels), alpha, beta, l1, l2, epochs)
        logits = np.array([x @ w[at] for at, x, _ in held])
        heat = temperature(logits, np.array([y for *_, y in held])) if held else 1.0
        used = np.flatnonzero(np.abs(w).sum(axis=1))
        return pd.DataFrame({"heat": [heat], "used": [used.astype(np.int32).tobytes()], "w": [w[used].astype(np.float32).tobytes()]})

    fitted = chosen.groupBy(F.lit(0).alias("g")).applyInPandas(run, "heat double, used binary, w binary").first()
    if fitted is None:
        return None
    used = np.frombuffer(fitted["used"], np.int32)
    w = np.zeros((DIM, len(labels)), np.float32)
    w[used] = np.frombuffer(fitted["w"], np.float32).reshape(len(used), len(labels)) * (SCALE * idf[used])[:, None]
    return {"labels": labels, "w": w, "heat": fitted["heat"]}


def predict(docs: DataFrame, model: dict | None, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``(*keep, lang_pred, score)`` per row; ``und`` and 0 without a letter or a model."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in small_batches(batches):
            names, scores = [], []
            for t in texts_of(b, "_text"):
                if m is None or not _LETTER.search(t):
                    names.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                at, tf = term_frequencies(t)
                p = _softmax((tf @ m["w"][at]) / m["heat"])
                names.append(m["labels"][int(np.argmax(p))])
                scores.append(float(p.max()))
            rest = b.drop_columns(["_text"])
            yield pa.RecordBatch.from_arrays(
                [*rest.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                names=[*rest.schema.names, "lang_pred", "score"],
            )

    base = docs.select(*keep, F.col(text).alias("_text"))
    schema = base.drop("_text").schema.add("lang_pred", "string").add("score", "double")
    return base.mapInArrow(run, schema)


def held_out(id_col: str = "doc_id") -> Column:
    """Rows kept from training: crc32 of the id as text, modulo 4, is 2. A null id is not."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, sample: int = 8000, text: str = "text", lang: str = "lang", id_col: str = "doc_id") -> DataFrame:
    """``(id_col, held_out, lang_pred, score)`` per row of ``docs``.

    Learns from the rows that are not held out and have a label and an id; predicts all
    from the text alone. Null texts and texts without a letter are ``und`` with score 0.
    Repeated rows are predicted alike; an empty table gives an empty one.
    """
    docs = unclashed(docs, id_col, text, lang).withColumn("held_out", held_out(id_col))
    model = fit(docs.filter(~F.col("held_out") & F.col(id_col).isNotNull()), sample, text, lang)
    return predict(docs, model, text, keep=(id_col, "held_out"))
