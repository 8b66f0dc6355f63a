"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment of words.

Seeds of a test item are its rarer n-grams: those found in no more documents than the
median of its n-grams that occur, counted over the whole corpus. A document that holds a
seed is aligned with the item around the seed first, then around every other n-gram the
two share, so a document without a seed is judged too. What is left out is proven: an
alignment scores at most its matches, and no more words match than the stretch holds. The
local alignment scores matches, changes and gaps of words, so edited and shortened copies
still score. Test items are taken in blocks of bounded size,
and each block meets all documents, so nothing that is sent to the executors grows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from questloom.llm.common import small_batches, texts_of, unclashed, written

_TERM = re.compile(r"[^\W_]+")
MATCH, MISS, GAP = 2, 1, 1


def terms(text: str | None) -> list[str]:
    return _TERM.findall((text or "").lower())


class Block:
    """Test items as word numbers, with their n-grams in a sorted hash array.

    ``grams[i]`` belongs to ``items[owner[i]]`` at word ``place[i]``; equal grams are
    neighbours. ``seed`` marks the grams that may start an alignment.
    """

    def __init__(self, rows: list[tuple[int, str]], n: int) -> None:
        self.n, self.words = n, {}
        self.ids = [r[0] for r in rows]
        number = self.words
        self.items = [np.array([number.setdefault(w, len(number) + 1) for w in terms(t)], np.int64) for _, t in rows]
        parts = [(self.codes(x, np.arange(max(0, len(x) - n + 1))), i) for i, x in enumerate(self.items)]
        grams = np.concatenate([c for c, _ in parts]) if parts else np.zeros(0, np.uint64)
        owner = np.concatenate([np.full(len(c), i) for c, i in parts]) if parts else np.zeros(0, np.int64)
        place = np.concatenate([np.arange(len(c)) for c, _ in parts]) if parts else np.zeros(0, np.int64)
        order = np.argsort(grams, kind="stable")
        self.grams, self.owner, self.place = grams[order], owner[order].astype(np.int64), place[order].astype(np.int64)
        self.distinct = np.unique(self.grams)
        self.seed = np.ones(len(self.grams), bool)

    def codes(self, numbers: np.ndarray, at: np.ndarray) -> np.ndarray:
        h = np.zeros(len(at), np.uint64)
        with np.errstate(over="ignore"):
            for k in range(self.n):
                h = (h ^ numbers[at + k].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
        return h

    def number(self, text: str) -> np.ndarray:
        """A text as word numbers; words of no item are 0."""
        get = self.words.get
        return np.array([get(w, 0) for w in terms(text)], np.int64)

    def hits(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of n-grams that items hold, and their hashes."""
        m = len(numbers) - self.n + 1
        if m < 1:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        known = numbers > 0
        full = known[:m].copy()
        for k in range(1, self.n):
            full &= known[k : k + m]
        at = np.flatnonzero(full)
        codes = self.codes(numbers, at)
        found = np.searchsorted(self.distinct, codes)
        found[found == len(self.distinct)] = 0
        hit = self.distinct[found] == codes if len(self.distinct) else np.zeros(len(at), bool)
        return at[hit], codes[hit]

    def choose_seeds(self, df: dict[int, int]) -> None:
        """Keep as seeds the n-grams of each item up to the median document count of those that occur."""
        counts = np.array([df.get(int(g), 0) for g in self.grams.view(np.int64)], np.int64)
        found = np.flatnonzero(counts)
        order = found[np.lexsort((counts[found], self.owner[found]))]
        first = np.flatnonzero(np.append(True, np.diff(self.owner[order]) > 0)) if len(order) else order
        size = np.diff(np.append(first, len(order)))
        limit = np.zeros(len(self.items), np.int64)
        limit[self.owner[order[first]]] = counts[order[first + (size - 1) // 2]]
        self.seed = (counts > 0) & (counts <= limit[self.owner])


def align(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """Best local alignment score of two word sequences, and where in ``b`` it ends."""
    best, end = 0, 0
    slope = GAP * np.arange(len(b) + 1)
    row = np.zeros(len(b) + 1, np.int64)
    for x in a.tolist():
        new = np.zeros(len(b) + 1, np.int64)
        new[1:] = np.maximum(row[:-1] + np.where(b == x, MATCH, -MISS), row[1:] - GAP)
        new = np.maximum(np.maximum.accumulate(np.maximum(new, 0) + slope) - slope, 0)
        at = int(new.argmax())
        if new[at] > best:
            best, end = int(new[at]), at
        row = new
    return best, end


def stretches(places: list[tuple[int, int]], size: int, slack: int, end: int) -> list[tuple[int, int]]:
    """Parts of a text of ``end`` words around shared n-grams ``(place in text, place in item)``."""
    out: list[tuple[int, int]] = []
    for s, e in sorted((max(0, p - q - slack), min(end, p - q + size + slack)) for p, q in places):
        if out and s <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], e)
        else:
            out.append((s, e))
    return out


def matches(block: Block, text: str, least: float, memory: dict) -> list[tuple[int, float]]:
    """``(item, score)`` of each item that the text holds; 1 is the whole item unchanged."""
    numbers = block.number(text)
    at, codes = block.hits(numbers)
    if not len(at):
        return []
    low, high = np.searchsorted(block.grams, codes), np.searchsorted(block.grams, codes, "right")
    many = high - low
    grams = np.arange(many.sum()) + np.repeat(low - np.cumsum(many) + many, many)
    shared = sorted(zip(block.owner[grams].tolist(), np.repeat(at, many).tolist(), block.place[grams].tolist(), block.seed[grams].tolist(), strict=True))
    held = np.zeros(len(block.words) + 1, bool)
    held[numbers] = True
    held[0] = False
    out = []
    for i, group in groupby(shared, itemgetter(0)):
        item, top = block.items[i], 0.0
        if held[item].sum() < least * len(item):
            continue
        # An alignment that scores ``least`` leaves out at most so many words of the text.
        slack = int(MATCH * max(0.0, 1 - least) * len(item)) // GAP + 1
        places = [(p, q, seed) for _, p, q, seed in group]
        for chosen in ([x[:2] for x in places if x[2]], [x[:2] for x in places]):
            for s, e in stretches(chosen, len(item), slack, len(numbers)):
                part = numbers[s:e]
                most = np.isin(item, part).sum() / len(item)
                if most < least or most <= top:
                    continue
                key = (i, part.tobytes())
                if key not in memory:
                    if len(memory) > 50_000:
                        memory.clear()
                    memory[key] = align(item, part)[0] / (MATCH * len(item))
                top = max(top, memory[key])
        if top >= least:
            out.append((i, top))
    return out


def blocks_of(bench: DataFrame, n: int, size: int, item: str, text: str) -> Iterator[Block]:
    """The test items in blocks of about ``size`` bytes, one block on the driver at a time."""
    rows = unclashed(bench, item, text).filter(F.col(text).isNotNull())
    total = rows.agg(F.sum(F.octet_length(text))).first()[0] or 0
    many = max(1, -(-total // size))
    rows = rows.withColumn("_b", F.pmod(F.xxhash64(item, text), F.lit(many)))
    for b in range(many):
        part = rows.filter(F.col("_b") == b).select(item, text).orderBy(item, text).collect()
        if part:
            yield Block([tuple(r) for r in part], n)


def document_counts(docs: DataFrame, block: Block, text: str) -> dict[int, int]:
    """How many documents hold each n-gram of the block; at most one row per n-gram returns."""
    sent = docs.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b, total = sent.value, {}
        for batch in small_batches(batches):
            for t in texts_of(batch, "_text"):
                for g in np.unique(b.hits(b.number(t))[1]).view(np.int64).tolist():
                    total[g] = total.get(g, 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.int64()), pa.array(total.values(), pa.int64())], names=["g", "n"])

    parts = docs.select(F.col(text).alias("_text")).mapInArrow(run, "g bigint, n bigint")
    counts = {r["g"]: r["n"] for r in parts.groupBy("g").agg(F.sum("n").alias("n")).collect()}
    sent.destroy()
    return counts


def prepared(docs: DataFrame, bench: DataFrame, n: int, size: int, text: str, item: str, bench_text: str) -> Iterator[Block]:
    for block in blocks_of(bench, n, size, item, bench_text):
        block.choose_seeds(document_counts(docs, block, text))
        yield block


def find_contaminated(
    docs: DataFrame,
    bench: DataFrame,
    n: int = 4,
    least: float = 0.5,
    size: int = 16 << 20,
    text: str = "text",
    id_col: str = "doc_id",
    item: str = "item_id",
    bench_text: str = "text",
) -> DataFrame:
    """``(id_col, item_id, score)``: every document row that holds a test item.

    ``score`` is the alignment score over that of the whole unchanged item, the best around
    any n-gram that the two share; without a shared n-gram there is no row. Items of fewer
    than ``n`` words and null items match nothing; null and empty texts hold nothing.
    Repeated rows and items are reported each. No documents or no items give no rows.
    """
    docs = unclashed(docs, id_col, text)
    kinds = f"{id_col} {docs.schema[id_col].dataType.simpleString()}, {item} {bench.schema[item].dataType.simpleString()}, score double"
    kind = to_arrow_type(bench.schema[item].dataType)
    out = None
    for block in prepared(docs, bench, n, size, text, item, bench_text):
        part = docs.select(id_col, F.col(text).alias("_text")).mapInArrow(_finder(docs, block, least, id_col, item, kind), kinds)
        out = part if out is None else out.union(part)
    return docs.sparkSession.createDataFrame([], kinds) if out is None else out


def _finder(docs: DataFrame, block: Block, least: float, id_col: str, item: str, kind: pa.DataType):
    sent = docs.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b, memory = sent.value, {}
        for batch in small_batches(batches):
            rows, items, scores = [], [], []
            for k, t in enumerate(texts_of(batch, "_text")):
                for i, score in matches(b, t, least, memory):
                    rows.append(k)
                    items.append(b.ids[i])
                    scores.append(score)
            ids = batch.column(0).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(items, kind), pa.array(scores, pa.float64())], names=[id_col, item, "score"])

    return run


def decontaminate(
    docs: DataFrame, bench: DataFrame, n: int = 4, least: float = 0.5, size: int = 16 << 20,
    text: str = "text", item: str = "item_id", bench_text: str = "text",
) -> DataFrame:
    """``docs`` without the rows that hold a test item; the columns stay as they are."""
    for i, block in enumerate(prepared(docs, bench, n, size, text, item, bench_text)):
        docs = _without(docs if i == 0 else written(docs, "clean"), block, least, text)
    return docs


def _without(docs: DataFrame, block: Block, least: float, text: str) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b, memory = sent.value, {}
        for batch in small_batches(batches):
            clean = [not matches(b, t, least, memory) for t in texts_of(batch, text)]
            yield batch.filter(pa.array(clean, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
