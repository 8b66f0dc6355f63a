"""Spelling variants: words one edit apart, found by k-d trees over letter counts.

One edit moves a word's letter counts by at most two in L1, so only words whose counts lie
in a small ball can be near. Trees over the counts, one per length, are cut into cells on a
bounded sample; every word is then sent to its own cell and to the cells its ball touches
(of its own length and of the next shorter one). Inside a cell a second tree finds pairs of
letter-count classes, and letter order is checked by looking up, for each word of a class,
the very strings that the differing letters allow. No pairs of words are made but near ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from questloom.llm.common import unclashed, written

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Cells of one length are numbered below this.
_CELLS = 1 << 20
_FAR = 1 << 30

_rng = np.random.default_rng(20)
#: A word's letter counts are told apart by a 64-bit sum, its letter order by another.
_LETTER, _VALUE = _rng.integers(1, 1 << 63, (2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_MIX = np.uint64(0xC2B2AE3D27D4EB4F)


def word_counts(
    docs: DataFrame, least: int = 7, often: int = 2, every: int = 31, text: str = "text", id_col: str = "doc_id"
) -> DataFrame:
    """``(word, n)``: the words of at least ``least`` letters found ``often`` times or more.

    A run of letters whose checksum with its document's id is divisible by ``every`` loses
    one letter. A null text has no words, a null id is an empty one.
    """
    lowered = F.translate(F.coalesce(F.col(text), F.lit("")), _UPPER, _LOWER)
    runs = F.regexp_extract_all(lowered, F.lit(f"[a-zÀ-ÿ]{{{least},}}+"), F.lit(0))
    named = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    rows = unclashed(docs, id_col, text).select(named.alias("_i"), F.explode(runs).alias("_r"))
    rows = rows.withColumn("_h", F.crc32(F.concat("_i", F.lit(":"), "_r").cast("binary")))
    at = (F.col("_h") % F.char_length("_r")).cast("int")
    cut = F.concat(F.substr("_r", F.lit(1), at), F.substr("_r", at + 2))
    word = F.when(F.col("_h") % every == 0, cut).otherwise(F.col("_r"))
    return (
        rows.select(word.alias("word")).filter(F.char_length("word") >= least)
        .groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= often)
    )


def codes(words: list[str]) -> np.ndarray:
    """The letters of words of one length, a row each."""
    return np.frombuffer("".join(words).encode("latin-1"), np.uint8).reshape(len(words), -1)


def letter_counts(rows: np.ndarray, letters: np.ndarray) -> np.ndarray:
    """How often each of ``letters`` occurs in each row."""
    place = np.full(256, len(letters), np.int64)
    place[letters] = np.arange(len(letters))
    wide = len(letters) + 1
    at = place[rows] + np.arange(len(rows))[:, None] * wide
    return np.bincount(at.ravel(), minlength=len(rows) * wide).reshape(len(rows), wide)[:, :-1].astype(np.int32)


class BoxTree:
    """A k-d tree with a box at every node, searched for many points at a time."""

    def __init__(self, points: np.ndarray, leaf: int, tight: bool, first: int | None = None):
        """``tight`` boxes hug their points; others tile the space. Columns from ``first``
        on are split only where the ones before cannot halve a node."""
        n, wide = points.shape
        self.lo, self.hi, self.child, self.items = [], [], [], []
        first = wide if first is None else first
        todo = [(np.arange(n), np.full(wide, -_FAR), np.full(wide, _FAR), -1, 0)]
        while todo:
            rows, lo, hi, parent, side = todo.pop()
            here = points[rows]
            if tight and len(rows):
                lo, hi = here.min(0), here.max(0)
            node = len(self.lo)
            self.lo.append(lo), self.hi.append(hi), self.child.append([-1, -1]), self.items.append(rows)
            if parent >= 0:
                self.child[parent][side] = node
            cut = self._cut(here, first) if len(rows) > leaf else None
            if cut is None:
                continue
            dim, at = cut
            left, right = here[:, dim] <= at, here[:, dim] > at
            self.items[node] = None
            hi_left, lo_right = hi.copy(), lo.copy()
            hi_left[dim], lo_right[dim] = at, at + 1
            todo += [(rows[right], lo_right, hi, node, 1), (rows[left], lo, hi_left, node, 0)]
        self.lo, self.hi = np.array(self.lo), np.array(self.hi)
        self.child = np.array(self.child)
        self.leaves = np.flatnonzero(self.child[:, 0] < 0)
        self.number = np.full(len(self.child), -1)
        self.number[self.leaves] = np.arange(len(self.leaves))
        held = [self.items[x] for x in self.leaves]
        self.start = np.concatenate([[0], np.cumsum([len(x) for x in held])]).astype(np.int64)
        self.order = np.concatenate(held).astype(np.int64) if held else np.zeros(0, np.int64)

    @staticmethod
    def _cut(here: np.ndarray, first: int) -> tuple[int, int] | None:
        """The column and value that halve the points best."""
        best = None
        for lo, hi in ((0, first), (first, here.shape[1])):
            spread = here[:, lo:hi].var(0) if hi > lo else np.zeros(0)
            for dim in lo + np.argsort(-spread)[:4]:
                seen, many = np.unique(here[:, dim], return_counts=True)
                if len(seen) < 2:
                    continue
                share = np.cumsum(many)[:-1] / len(here)
                k = int(np.argmin(np.abs(share - 0.5)))
                if best is None or abs(share[k] - 0.5) < best[0]:
                    best = (abs(share[k] - 0.5), int(dim), int(seen[k]))
            if best is not None and best[0] < 0.3:
                break
        return best and best[1:]

    def touched(self, queries: np.ndarray, balls: list[tuple[slice, int, int]], part: int = 1 << 16):
        """Pairs of query row and leaf whose box is at most ``up`` above and ``down`` below.

        A replaced letter is one count more and one less, so a ball of L1 radius two is
        searched as one up and one down; a letter too many is one down.
        """
        queries_of, leaves_of = [], []
        for at in range(0, len(queries), 4096):
            rows = np.arange(at, min(at + 4096, len(queries)))
            todo = [(rows, np.zeros(len(rows), np.int64))]
            while todo:
                q, node = todo.pop()
                if len(q) > part:
                    todo += [(q[:part], node[:part]), (q[part:], node[part:])]
                    continue
                ok = np.ones(len(q), bool)
                for cols, up, down in balls:
                    x = queries[q, cols]
                    ok &= np.maximum(self.lo[node, cols] - x, 0).sum(1) <= up
                    ok &= np.maximum(x - self.hi[node, cols], 0).sum(1) <= down
                q, node = q[ok], node[ok]
                ends = self.child[node, 0] < 0
                if ends.any():
                    queries_of.append(q[ends])
                    leaves_of.append(self.number[node[ends]])
                q, node = q[~ends], node[~ends]
                if len(q):
                    todo.append((np.concatenate([q, q]), self.child[node].T.ravel()))
        if not queries_of:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(queries_of), np.concatenate(leaves_of)

    def within(self, points: np.ndarray, queries: np.ndarray, up: int, down: int, part: int = 1 << 19):
        """Pairs of query row and point at L1 distance ``up + down`` exactly."""
        q, leaf = self.touched(queries, [(slice(None), up, down)])
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        sizes = self.start[leaf + 1] - self.start[leaf]
        ends = np.cumsum(sizes)
        at = 0
        while at < len(q):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + part, "right")))
            qq, pp = _spread(q[at:to], self.start[leaf[at:to]], sizes[at:to])
            pp = self.order[pp]
            near = np.abs(points[pp] - queries[qq]).sum(1) == up + down
            found.append((qq[near], pp[near]))
            at = to
        return np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])


def _spread(values: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each value beside every place from its start on."""
    total = int(size.sum())
    first = np.repeat(start - np.concatenate([[0], np.cumsum(size)[:-1]]) if len(size) else start, size)
    return np.repeat(values, size), first + np.arange(total)


def _by_length(words: list[str]) -> dict[int, list[int]]:
    out: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        out.setdefault(len(w), []).append(i)
    return out


def _places(rows: np.ndarray, letters: np.ndarray, half: int) -> np.ndarray:
    """What the cells are cut by: the letter counts and those of the first ``half`` letters.

    Half counts move by two at most under one edit; they part words of equal counts.
    """
    return np.concatenate([letter_counts(rows, letters), letter_counts(rows[:, :half], letters)], axis=1)


def _trees(sample: list[str], cells: int) -> tuple[np.ndarray, dict[int, BoxTree]]:
    """One cell tree for each length of the sample, with about ``cells`` cells in all."""
    if not sample:
        return np.zeros(0, np.uint8), {}
    letters = np.unique(np.frombuffer("".join(sample).encode("latin-1"), np.uint8))
    leaf = max(1, len(sample) // max(1, cells))
    return letters, {
        n: BoxTree(_places(codes([sample[i] for i in at]), letters, n // 2), leaf, False, len(letters))
        for n, at in _by_length(sample).items()
    }


def _routed(words: DataFrame, letters: np.ndarray, trees: dict[int, BoxTree]) -> DataFrame:
    """Every word at home in one cell, and as a guest where its ball reaches."""

    def cells_of(rows: np.ndarray, n: int, up: int, down: int):
        tree = trees.get(n)
        if tree is None:
            return np.arange(len(rows)), np.zeros(len(rows), np.int64)
        wide = len(letters)
        balls = [(slice(0, wide), up, down), (slice(wide, 2 * wide), down, down)]
        return tree.touched(_places(rows, letters, n // 2), balls)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 16_384):
                part = b.slice(at, 16_384)
                words = part.column(0).to_pylist()
                who, cell, home = [], [], []
                for n, rows in _by_length(words).items():
                    rows, letters_of = np.array(rows), codes([words[i] for i in rows])
                    own = np.zeros(len(rows), np.int64)
                    q, c = cells_of(letters_of, n, 0, 0)
                    own[q] = c
                    who.append(rows), cell.append(own + n * _CELLS), home.append(np.ones(len(rows), bool))
                    # A pair of one length is looked for in the later cell of the two.
                    q, c = cells_of(letters_of, n, 1, 1)
                    q, c = q[c > own[q]], c[c > own[q]]
                    who.append(rows[q]), cell.append(c + n * _CELLS), home.append(np.zeros(len(q), bool))
                    q, c = cells_of(letters_of, n - 1, 0, 1)
                    who.append(rows[q]), cell.append(c + (n - 1) * _CELLS), home.append(np.zeros(len(q), bool))
                if who:
                    at_rows = pa.array(np.concatenate(who))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate(cell)), part.column(0).take(at_rows), part.column(1).take(at_rows), pa.array(np.concatenate(home))],
                        names=["cell", "word", "n", "home"],
                    )

    return words.mapInArrow(run, "cell long, word string, n long, home boolean")


class _Classes:
    """Words of one length by letter-count class, with a hash of their letter order."""

    def __init__(self, rows: np.ndarray, who: np.ndarray, letters: np.ndarray):
        self.rows, self.who = rows, who
        sums = _LETTER[rows].sum(1, dtype=np.uint64)
        _, first, self.of = np.unique(sums, return_index=True, return_inverse=True)
        self.counts = letter_counts(rows[first], letters)
        self.sorted = np.argsort(self.of, kind="stable")
        self.start = np.searchsorted(self.of[self.sorted], np.arange(len(self.counts) + 1))
        self.power = _powers(rows.shape[1] + 1)
        self.hash = (_VALUE[rows] * self.power[:-1]).sum(1, dtype=np.uint64)

    def members(self, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each entry's index beside every word of its class."""
        at, place = _spread(np.arange(len(classes)), self.start[classes], self.start[classes + 1] - self.start[classes])
        return at, self.sorted[place]


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _STEP, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class _Index:
    """Home words by class and hash."""

    def __init__(self, homes: _Classes):
        keys = homes.hash + homes.of.astype(np.uint64) * _MIX
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]

    def find(self, hashes: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = hashes + classes.astype(np.uint64) * _MIX
        lo, hi = np.searchsorted(self.keys, keys, "left"), np.searchsorted(self.keys, keys, "right")
        at, place = _spread(np.arange(len(keys)), lo, hi - lo)
        return at, self.order[place]


def _replaced(guests: _Classes, homes: _Classes, index: _Index, tree: BoxTree, letters: np.ndarray):
    """Pairs of guest and home word of one length that differ by one letter."""
    q, c = tree.within(homes.counts, guests.counts, 1, 1)
    differ = homes.counts[c] - guests.counts[q]
    fits = differ.sum(1) == 0
    q, c, differ = q[fits], c[fits], differ[fits]
    old, new = letters[differ.argmin(1)] if len(q) else q, letters[differ.argmax(1)] if len(q) else q
    pair, word = guests.members(q)
    for at in range(0, len(pair), step := max(1, (1 << 22) // guests.rows.shape[1])):
        p, w = pair[at : at + step], word[at : at + step]
        row, place = np.nonzero(guests.rows[w] == old[p][:, None])
        p, w = p[row], w[row]
        hashes = guests.hash[w] + (_VALUE[new[p]] - _VALUE[old[p]]) * guests.power[place]
        hit, home = index.find(hashes, c[p])
        same = (guests.rows[w[hit]] != homes.rows[home]).sum(1) == 1
        yield guests.who[w[hit][same]], homes.who[home[same]]


def _shortened(guests: _Classes, homes: _Classes, index: _Index, tree: BoxTree, letters: np.ndarray):
    """Pairs of guest and home word, the guest longer by one letter."""
    q, c = tree.within(homes.counts, guests.counts, 0, 1)
    extra = letters[(guests.counts[q] - homes.counts[c]).argmax(1)] if len(q) else q
    long = guests.rows.shape[1]
    pair, word = guests.members(q)
    for at in range(0, len(pair), step := max(1, (1 << 20) // long)):
        p, w = pair[at : at + step], word[at : at + step]
        letters_of = guests.rows[w]
        before = np.zeros((len(w), long + 1), np.uint64)
        np.cumsum(_VALUE[letters_of] * guests.power[:-1], axis=1, out=before[:, 1:])
        row, place = np.nonzero(letters_of == extra[p][:, None])
        hashes = before[row, place] + (before[row, long] - before[row, place + 1]) * _BACK
        hit, home = index.find(hashes, c[p[row]])
        row, place = row[hit], place[hit]
        keep = np.arange(long - 1) + (np.arange(long - 1) >= place[:, None])
        same = (np.take_along_axis(letters_of[row], keep, 1) == homes.rows[home]).all(1)
        # A letter of a run of equal ones may go anywhere: one pair.
        both = np.unique(np.stack([w[row[same]], home[same]], 1), axis=0)
        yield guests.who[both[:, 0]], homes.who[both[:, 1]]


def _solve(cell: pa.Table) -> pa.Table:
    """``(word, near, best_n, best)``: what this cell adds to each of its words."""
    words, n = cell.column("word").to_pylist(), cell.column("n").to_numpy()
    home = cell.column("home").to_numpy(zero_copy_only=False)
    size = len(words[int(np.argmax(home))]) if home.any() else 0
    groups = {"home": [], "same": [], "longer": []}
    for i, w in enumerate(words):
        groups["home" if home[i] else "same" if len(w) == size else "longer"].append(i)
    targets, others = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    if groups["home"]:
        letters = np.unique(np.frombuffer("".join(words).encode("latin-1"), np.uint8))
        sides = {
            k: _Classes(codes([words[i] for i in at]), np.array(at), letters) for k, at in groups.items() if at
        }
        homes = sides["home"]
        tree, index = BoxTree(homes.counts, 16, True), _Index(homes)
        for k, guests in sides.items():
            finder = _shortened if k == "longer" else _replaced
            for a, b in finder(guests, homes, index, tree, letters):
                targets.append(a), others.append(b)
                if k != "home":
                    targets.append(b), others.append(a)
    target, other = np.concatenate(targets), np.concatenate(others)
    rank = np.empty(len(words), np.int64)
    rank[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
    order = np.lexsort((rank[other], -n[other], target))
    target, other = target[order], other[order]
    who, first, near = np.unique(target, return_index=True, return_counts=True)
    best = other[first]
    text = cell.column("word").combine_chunks()
    return pa.table(
        {
            "word": text.take(pa.array(who)), "near": pa.array(near, pa.int64()),
            "best_n": pa.array(n[best], pa.int64()), "best": text.take(pa.array(best)),
        }
    )


def near_words(words: DataFrame, sample: int = 16_384, cell: int = 32_768) -> DataFrame:
    """``(word, n, n_near, best_n, best)`` per row of ``words`` (word, n), words distinct.

    ``best`` is the near word of largest n, ties by code points; null without one. Cells are
    cut on at most ``sample`` words; all words are searched.
    """
    spark = words.sparkSession
    total = words.count()
    share = F.pmod(F.xxhash64("word"), F.lit(max(1, -(-total // sample)))) == 0
    drawn = [r.word for r in words.filter(share).select("word").limit(2 * sample).collect()]
    cells = max(1, -(-total // cell))
    letters, trees = _trees(sorted(drawn), cells)
    tasks = max(cells, spark.sparkContext.defaultParallelism)
    routed = _routed(words, letters, trees).repartition(tasks, "cell")
    parts = routed.groupBy("cell").applyInArrow(_solve, "word string, near long, best_n long, best string")
    none = F.lit(None)
    rows = parts.select("word", none.cast("long").alias("n"), "near", F.struct((-F.col("best_n")).alias("m"), "best").alias("b"))
    rows = rows.unionByName(
        words.select("word", "n", F.lit(0).cast("long").alias("near"), none.cast("struct<m:bigint,best:string>").alias("b"))
    )
    found = rows.groupBy("word").agg(F.max("n").alias("n"), F.sum("near").alias("n_near"), F.min("b").alias("b"))
    return found.select("word", "n", "n_near", (-F.col("b.m")).alias("best_n"), F.col("b.best").alias("best"))


def _roots(forms: DataFrame) -> DataFrame:
    """``(word, root)``: where the forms of ``forms`` (word, form) end.

    A form is ten times as frequent as its word, so there are no circles and few steps;
    every round doubles the steps taken.
    """
    now = forms.select("word", F.col("form").alias("root"))
    while True:
        ahead = now.select(F.col("word").alias("_w"), F.col("root").alias("_r"))
        joined = now.join(ahead, F.col("root") == F.col("_w"), "left")
        now = written(joined.select("word", F.coalesce("_r", "root").alias("root"), F.col("_r").isNotNull().alias("moved")), "roots")
        if now.filter("moved").isEmpty():
            return now.select("word", "root")


def spelling_variants(
    docs: DataFrame, factor: int = 10, text: str = "text", id_col: str = "doc_id", **counted
) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` per word of ``word_counts``.

    A word's form is its most frequent near word, if that is ``factor`` times as frequent;
    its root is where forms end, the word itself without one. Null and empty texts have no
    words, texts and words of any length are read whole, repeated rows count each, ties go
    to the least word by code points; an empty table gives an empty one.
    """
    words = written(word_counts(docs, text=text, id_col=id_col, **counted), "words")
    big = F.col("best_n") >= factor * F.col("n")
    found = written(
        near_words(words).select(
            "word", "n", "n_near", F.when(big, F.col("best")).alias("form"), F.when(big, F.col("best_n")).alias("form_n")
        ),
        "near-words",
    )
    roots = _roots(found.filter(F.col("form").isNotNull()).select("word", "form"))
    return found.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
