"""Removal of byte strings that occur twice or more, by column-wise suffix sorting.

Two equal strings of ``n`` bytes hold the same anchors: positions whose 64-byte hash is the
least in some window of the string. Only strings around anchors that occur twice need
sorting, and since equal strings hold their anchor at the same place, segments that share
an anchor are aligned. The segments of an anchor are sorted like a collection: from the
last column to the first, one symbol of every segment is inserted a round, which turns the
order of the suffixes of one column into the order of the column before (a stable sort by
the new symbol) and updates the common-prefix length of neighbours. A start whose suffix
shares ``n`` bytes with a neighbour is repeated. Spark's shuffle files take the place of
the sequential files between rounds: a bucket of anchors is one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from questloom.llm.common import row_key, small_batches, unclashed, written

GRAM = 64
_B = 0x9E3779B97F4A7C15 | 1
_BINV = pow(_B, -1, 1 << 64)
_M = np.uint64(0xFF51AFD7ED558CCD)
#: Segments of one anchor that a single task sorts; more of them are counted by hash.
BLOCK = 65_536
#: Rows of one key that a shuffled join takes; keys of more are few and go to their rows.
SHARE = 8_192


class Roller:
    """Hashes of all ``GRAM``-byte windows; powers are kept and grow with the longest text."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.up) <= n:
            size = 2 * n + 1
            self.up = np.cumprod(np.append(np.uint64(1), np.full(size, _B, np.uint64)), dtype=np.uint64)
            self.down = np.cumprod(np.append(np.uint64(1), np.full(size, _BINV, np.uint64)), dtype=np.uint64)

    def __call__(self, data: np.ndarray, width: int = GRAM) -> np.ndarray:
        n = len(data)
        self._grow(n)
        with np.errstate(over="ignore"):
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data + np.uint64(1)) * self.up[:n], dtype=np.uint64)])
            h = (sums[width:] - sums[:-width]) * self.down[: n - width + 1]
            h = (h ^ (h >> np.uint64(32))) * _M
        return h ^ (h >> np.uint64(29))


def sliding(v: np.ndarray, width: int, least: bool) -> np.ndarray:
    """Minimum or maximum of every window of ``width`` values, in time linear in ``v``."""
    pick = np.minimum if least else np.maximum
    fill = np.uint64(2**64 - 1) if least else np.uint64(0)
    pad = np.append(v, np.full(-len(v) % width, fill)).reshape(-1, width)
    ahead = pick.accumulate(pad, axis=1).ravel()
    back = pick.accumulate(pad[:, ::-1], axis=1)[:, ::-1].ravel()
    return pick(back[: len(v) - width + 1], ahead[width - 1 : len(v)])


def anchors(data: np.ndarray, roll: Roller, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the anchors of every ``n``-byte string of ``data``."""
    if len(data) < n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    width = n - GRAM + 1
    v = roll(data.astype(np.uint64))
    low = sliding(v, width, True)
    edge = np.zeros(width - 1, np.uint64)
    reach = sliding(np.concatenate([edge, low, edge]), width, False)
    at = np.flatnonzero(v == reach)
    return at, v[at]


def _bytes_of(batch: pa.RecordBatch, name: str) -> list[bytes]:
    return [x or b"" for x in batch.column(batch.schema.get_field_index(name)).to_pylist()]


def _anchor_rows(docs: DataFrame, n: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roll = Roller()
        for b in small_batches(batches):
            found = [anchors(np.frombuffer(t, np.uint8), roll, n) for t in _bytes_of(b, "_b")]
            sizes = [len(at) for at, _ in found]
            if sum(sizes):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([h for _, h in found]).view(np.int64)),
                     pa.array(np.repeat(b.column(0).to_numpy(), sizes)), pa.array(np.repeat(b.column(1).to_numpy(), sizes)),
                     pa.array(np.concatenate([at for at, _ in found]).astype(np.int32))],
                    names=["h", "_k1", "_k2", "pos"],
                )

    long = docs.filter(F.octet_length("_b") >= n)
    return long.select("_k1", "_k2", "_b").mapInArrow(run, "h bigint, _k1 bigint, _k2 bigint, pos int")


def _segments(docs: DataFrame, listed: DataFrame, n: int) -> DataFrame:
    """``(h, sh, left, k1, k2, pos, seg)``; within a task, equal segments carry bytes once."""
    reach = n - GRAM

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[tuple[int, int]] = set()
        for b in small_batches(batches, 128):
            cols: list[list] = [[] for _ in range(7)]
            keys = zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)
            for (k1, k2), data, marks in zip(keys, _bytes_of(b, "_b"), b.column(3).to_pylist(), strict=True):
                for m in marks:
                    p, h = m["pos"], m["h"]
                    left = min(p, reach)
                    seg = data[p - left : p + n]
                    sh = xxhash.xxh64_intdigest(seg, left) - (1 << 63)
                    new = (h, sh) not in sent
                    if new:
                        sent.add((h, sh))
                    for c, x in zip(cols, (h, sh, left, k1, k2, p, seg if new else None), strict=True):
                        c.append(x)
            if len(sent) > 1_000_000:
                sent.clear()
            types = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, types, strict=True)],
                names=["h", "sh", "left", "_k1", "_k2", "pos", "seg"],
            )

    joined = docs.join(listed, ["_k1", "_k2"]).select("_k1", "_k2", "_b", "marks")
    return joined.mapInArrow(run, "h bigint, sh bigint, left int, _k1 bigint, _k2 bigint, pos int, seg binary")


def repeated_starts(segs: list[bytes], lefts: list[int], group: np.ndarray, n: int) -> np.ndarray:
    """For aligned segments, by group: which start columns share ``n`` bytes with another.

    Column ``n - GRAM`` is the anchor. The result has a row per segment and a column per
    start, from the first column to the anchor.
    """
    reach, width = n - GRAM, 2 * n - GRAM
    count = len(segs)
    cols = np.empty((width, count), np.uint16)
    for a in range(0, count, 4096):  # in pieces, so that only one matrix is held
        part = np.full((min(4096, count - a), width), 256, np.uint16)  # 256: outside the text
        for i in range(len(part)):
            begin = reach - lefts[a + i]
            part[i, begin : begin + len(segs[a + i])] = np.frombuffer(segs[a + i], np.uint8)
        cols[:, a : a + len(part)] = part.T
    out = np.zeros((reach + 1, count), bool)
    order = np.argsort(group, kind="stable")
    base = group[order].astype(np.int64) * 257  # groups stay together, so this never moves
    inner = np.append(False, base[1:] == base[:-1])
    common = np.zeros(count + 1, np.int32)  # with the neighbour before, from this column on
    for j in range(width - 1, -1, -1):
        symbol = cols[j][order]
        key = base + symbol
        if (key[1:] >= key[:-1]).all():
            same = np.append(False, key[1:] == key[:-1]) & inner & (symbol < 256)
            common[:count] = np.where(same, common[:count] + 1, 0)
        else:
            move = np.argsort(key, kind="stable")
            order, key, symbol = order[move], key[move], symbol[move]
            same = np.append(False, key[1:] == key[:-1]) & inner & (symbol < 256)
            at = np.flatnonzero(same)
            p, q = move[at - 1], move[at]
            least = common[q]
            far = np.flatnonzero(q - p > 1)
            if len(far):  # the least over all neighbours that stood between the two
                far = far[np.argsort(p[far])]
                spans = np.stack([p[far] + 1, q[far] + 1], axis=1).ravel()
                least[far] = np.minimum.reduceat(common, spans)[::2]
            common = np.zeros(count + 1, np.int32)
            common[at] = least + 1
        if j <= reach:
            hit = np.flatnonzero(common[:count] >= n)
            out[j, order[hit]] = True
            out[j, order[hit - 1]] = True
    return out.T


def _runs(starts: np.ndarray, n: int) -> list[dict]:
    """Covered stretches ``[s, e)`` around the anchor, from repeated start columns."""
    at = np.flatnonzero(starts)
    if not len(at):
        return []
    cut = np.flatnonzero(np.diff(at) > n)
    first, last = at[np.append(0, cut + 1)], at[np.append(cut, len(at) - 1)]
    return [{"s": int(a) - (n - GRAM), "e": int(b) - (n - GRAM) + n} for a, b in zip(first, last, strict=True)]


_COVER = "h bigint, sh bigint, cover array<struct<s:int,e:int>>"


def _all_starts(left: int, size: int, n: int) -> np.ndarray:
    """Start columns of a segment that lie in the text with ``n`` bytes after them."""
    reach = n - GRAM
    out = np.zeros(reach + 1, bool)
    out[reach - left : max(reach - left, min(reach, reach - left + size - n) + 1)] = True
    return out


def _sorted_cover(groups: DataFrame, n: int, batch: int = 20_000) -> DataFrame:
    """Covers of segments, anchors sorted together up to ``batch`` segments at a time."""

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        ids = {}
        group = np.array([ids.setdefault(r[0], len(ids)) for r in rows])
        starts = repeated_starts([r[4] for r in rows], [r[2] for r in rows], group, n)
        hs, shs, covers = [], [], []
        for r, own in zip(rows, starts, strict=True):
            if r[3] > 1:  # the same segment occurs elsewhere: all its starts are repeated
                own = own | _all_starts(r[2], len(r[4]), n)
            if runs := _runs(own, n):
                hs.append(r[0])
                shs.append(r[1])
                covers.append(runs)
        return pa.RecordBatch.from_arrays(
            [pa.array(hs, pa.int64()), pa.array(shs, pa.int64()),
             pa.array(covers, pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())])))],
            names=["h", "sh", "cover"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for b in small_batches(batches, 2048):
            for r in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if len(rows) >= batch and r[0] != rows[-1][0]:
                    yield solve(rows)
                    rows = []
                rows.append(r)
        if rows:
            yield solve(rows)

    dealt = groups.select("h", "sh", "left", "n", "seg").repartition("h").sortWithinPartitions("h", "sh")
    return dealt.mapInArrow(run, _COVER)


def _hashed_cover(groups: DataFrame, n: int) -> DataFrame:
    """The same for anchors with very many segments: each start's string is counted by hash."""
    reach = n - GRAM

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roll = Roller()
        for b in small_batches(batches, 256):
            for h, sh, left, m, seg in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if len(seg) < n:
                    continue
                data = np.frombuffer(seg, np.uint8).astype(np.uint64)
                g = roll(data, n)[: left + 1]
                g2 = roll(data[::-1].copy(), n)[::-1][: left + 1]
                k = len(g)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(k, h)), pa.array(np.full(k, sh)), pa.array((reach - left + np.arange(k)).astype(np.int32)),
                     pa.array(np.full(k, m)), pa.array(g.view(np.int64)), pa.array(g2.view(np.int64))],
                    names=["h", "sh", "at", "n", "g", "g2"],
                )

    grams = groups.select("h", "sh", "left", "n", "seg").mapInArrow(
        run, "h bigint, sh bigint, at int, n bigint, g bigint, g2 bigint"
    )
    again = grams.groupBy("h", "at", "g", "g2").agg(F.sum("n").alias("m")).filter("m > 1").drop("m")
    hit = grams.join(again, ["h", "at", "g", "g2"]).groupBy("h", "sh").agg(F.collect_set("at").alias("at"))

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            covers = []
            for at in b.column(2).to_pylist():
                starts = np.zeros(reach + 1, bool)
                starts[at] = True
                covers.append(_runs(starts, n))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(covers, pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())])))],
                names=["h", "sh", "cover"],
            )

    return hit.select("h", "sh", "at").mapInArrow(runs, _COVER)


def meet(rows: DataFrame, side: DataFrame, by: list[str], hot: DataFrame) -> DataFrame:
    """Inner join of ``rows`` with ``side``, one row a key; the rows of ``hot`` keys stay where they are.

    ``hot`` lists keys of so many rows that one task would take them all. There are few, and
    with their rows of ``side`` they are written, so Spark knows them to be small.
    """
    few = written(side.join(hot, by), "hot-rows")
    return rows.join(hot, by, "left_anti").join(side, by).unionByName(rows.join(few, by))


def repeated_spans(docs: DataFrame, n: int = 400, block: int = BLOCK, share: int = SHARE) -> DataFrame:
    """``(_k1, _k2, spans)`` for keyed rows ``(_k1, _k2, _b)``: covered stretches, unmerged."""
    rows = written(_anchor_rows(docs, n), "anchors")
    twice = written(rows.groupBy("h").agg(F.count(F.lit(1)).alias("c")).filter("c > 1"), "repeated-anchors")
    hot = written(twice.filter(F.col("c") > share).select("h"), "hot-anchors")
    listed = meet(rows, twice.select("h"), ["h"], hot).groupBy("_k1", "_k2").agg(F.collect_set(F.struct("pos", "h")).alias("marks"))
    found = written(_segments(docs, listed, n), "segments")
    groups = found.groupBy("h", "sh").agg(F.count(F.lit(1)).alias("n"), F.max("left").alias("left"), F.max("seg").alias("seg"))
    groups = written(groups, "distinct-segments")
    large = written(groups.groupBy("h").agg(F.count(F.lit(1)).alias("m")).filter(F.col("m") > block).select("h"), "large-anchors")
    cover = _sorted_cover(groups.join(large, "h", "left_anti"), n)
    cover = cover.union(_hashed_cover(groups.join(large, "h"), n))
    cover = written(cover, "covers")
    hot = written(groups.filter(F.col("n") > share).select("h", "sh"), "hot-segments")
    return (
        meet(found.drop("seg", "left"), cover, ["h", "sh"], hot)
        .select("_k1", "_k2", F.explode(F.transform("cover", lambda x: F.struct((x["s"] + F.col("pos")).alias("s"), (x["e"] + F.col("pos")).alias("e")))).alias("x"))
        .groupBy("_k1", "_k2").agg(F.collect_set("x").alias("spans"))
    )


def merged(spans: list[dict] | None) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s, e in sorted((x["s"], x["e"]) for x in spans or []):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def cut_repeats(docs: DataFrame, n: int = 400, text: str = "text", id_col: str = "doc_id", block: int = BLOCK) -> DataFrame:
    """``(id_col, n_bytes, n_removed, n_spans, kept)`` per row; ``kept`` is the bytes left.

    Every byte inside an ``n``-byte string that starts anywhere else too is removed; all
    strings are judged on the input. Null and empty texts have no bytes. Repeated rows
    repeat each other's strings. Null ids are ids like any other; an empty table gives no
    rows. Texts of any length are read whole.
    """
    if n <= GRAM:
        raise ValueError(f"strings must be longer than {GRAM} bytes")
    docs = unclashed(docs, id_col, text)
    keyed = docs.select(*row_key(id_col, text), F.col(id_col), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("_b"))
    spans = repeated_spans(keyed.select("_k1", "_k2", "_b"), n, block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches):
            sizes, gone, runs, kept = [], [], [], []
            for data, marks in zip(_bytes_of(b, "_b"), b.column(2).to_pylist(), strict=True):
                cuts = merged(marks)
                sizes.append(len(data))
                gone.append(sum(e - s for s, e in cuts))
                runs.append(len(cuts))
                ends = [0, *[e for _, e in cuts]]
                kept.append(b"".join(data[a:s] for a, s in zip(ends, [*[s for s, _ in cuts], len(data)], strict=True)))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()), pa.array(runs, pa.int64()), pa.array(kept, pa.binary())],
                names=[id_col, "n_bytes", "n_removed", "n_spans", "kept"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    joined = keyed.join(spans, ["_k1", "_k2"], "left").select(id_col, "_b", "spans")
    return joined.mapInArrow(run, f"{id_col} {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")
