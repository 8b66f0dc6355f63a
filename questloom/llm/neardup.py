"""Near duplicates: an exact Jaccard join of word-shingle sets by token-combination prefixes.

A document is the set of its 64-bit shingle hashes. Equal sets get one id and are joined
once. Shingles are ordered by frequency class (rare first), then by hash; two sets with
similarity ``t`` share a shingle among their first ``n - ceil(t n) + 1``, and ``k`` of them
if the prefix is ``k - 1`` longer. That extended prefix is indexed:

1. by single shingles, where every member of a list is compared with one member per size
   class, which is linear in the list and settles lists of copies;
2. lists whose members are not yet in one component are looked at again: with few members
   outside the largest component these are compared with all; otherwise the list is
   frequent among unlike documents and pairs of its shingles are indexed instead, so only
   sets that share two such shingles meet.

Each candidate is verified on whole sets. Frequency classes come from counts over all
documents, kept as bitmaps of fixed size: a shingle whose bit is shared with a frequent one
is ordered later than it could be, alike in every document, so no link is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from questloom.llm.common import small_batches, texts_of, unclashed, written

#: Least document counts of the frequency classes above "one document".
CLASSES = (2, 32, 512, 8192)
#: Bits of each class bitmap, as a power of two: 8 MiB a class, whatever the corpus holds.
BITMAP_BITS = 26
#: Bits of a hash that are counted; bits beyond decide nothing but the order inside a class.
KEY_BITS = 40
#: Partitions in which the bitmaps reach the driver: 2 MiB each.
PARTS = 16

_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * _M1
    h = (h ^ (h >> np.uint64(33))) * _M2
    return h ^ (h >> np.uint64(33))


class WordHashes(dict):
    """Hashes of words, computed when first asked for."""

    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


class Shingler:
    """Texts to sorted arrays of distinct shingle hashes; word hashes are kept for reuse."""

    def __init__(self, n: int = 5, kept: int = 300_000) -> None:
        self.n, self.kept, self.words = n, kept, WordHashes()

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        """The set of each text. All texts are hashed as one run of words, then cut apart."""
        if len(self.words) > self.kept:
            self.words.clear()
        words = [t.encode("utf-8", "surrogatepass").lower().split() for t in texts]
        sizes = np.array([len(w) for w in words], np.int64)
        flat = np.fromiter(map(self.words.__getitem__, chain.from_iterable(words)), np.uint64, sizes.sum())
        whole = self._hash(flat, self.n) if len(flat) >= self.n else flat[:0]
        out = []
        for end, size in zip(np.cumsum(sizes).tolist(), sizes.tolist(), strict=True):
            begin = end - size
            if size >= self.n:
                out.append(np.unique(whole[begin : end - self.n + 1]))
            elif size:
                out.append(self._hash(flat[begin:end], size))
            else:
                out.append(np.zeros(0, np.uint64))
        return out

    @staticmethod
    def _hash(h: np.ndarray, n: int) -> np.ndarray:
        m = len(h) - n + 1
        s = np.full(m, np.uint64(n))
        with np.errstate(over="ignore"):
            for k in range(n):
                s = mix(s * np.uint64(31) + h[k : k + m])
        return s


#: Words of 64 bits in a sketch, and the columns that hold them.
SKETCH = 8
BITS = tuple(f"s{i}" for i in range(SKETCH))


def sketch(s: np.ndarray) -> np.ndarray:
    """512 parity bits of a set. Sets that differ in d members differ in at most d bits."""
    bit = (s >> np.uint64(7)) & np.uint64(64 * SKETCH - 1)
    odd = np.bincount(bit.astype(np.int64), minlength=64 * SKETCH) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def set_id(s: np.ndarray) -> int:
    """One 64-bit id per set, as a signed number."""
    with np.errstate(over="ignore"):
        h = mix(np.array([mix(s).sum(dtype=np.uint64) + np.uint64(len(s))], np.uint64))
    return int(h.view(np.int64)[0])


def _planes(keys: np.ndarray) -> bytes:
    """Five-byte numbers as byte planes, which compress well when sorted."""
    return np.ascontiguousarray(keys.view(np.uint8).reshape(-1, 8)[:, :5].T).tobytes()


def _keys(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(blob, np.uint8).reshape(5, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :5] = planes.T
    return out.view(np.uint64).ravel()


def profile(docs: DataFrame, n: int, text: str = "text", id_col: str = "doc_id", flush: int = 2_000_000) -> DataFrame:
    """Rows of two kinds: documents ``(doc_id, n, id)`` and bitmap pieces ``(piece, bits)``.

    Shingles travel as sorted blocks of 5-byte keys per hash range, not as rows. Each range
    is counted in one task and gives its piece of every class bitmap. Ranges follow the
    number of shuffle partitions, so a range holds what a shuffle task should hold. Copies
    inside a task are counted once, which keeps most copies out of the frequent classes.
    """
    wanted = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bits = min(20, max(6, (wanted - 1).bit_length()))
    shift = np.uint64(64 - KEY_BITS)
    kind = docs.schema[id_col].dataType
    arrow_id = pa.schema([("x", pa.string() if kind.typeName() == "string" else pa.int64())]).field("x").type

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(n)
        seen: set[int] = set()
        waiting: list[np.ndarray] = []

        def rows(bucket, ids, sizes, sets, blobs) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(bucket, pa.int32()), pa.array(ids, arrow_id), pa.array(sizes, pa.int64()),
                 pa.array(sets, pa.int64()), pa.array(blobs, pa.binary())],
                names=["bucket", "doc_id", "n", "id", "blob"],
            )

        def out() -> pa.RecordBatch:
            keys = np.sort(np.concatenate(waiting))
            edges = np.searchsorted(keys, np.arange(1 << bits, dtype=np.uint64) << np.uint64(KEY_BITS - bits))
            ends = np.append(edges[1:], len(keys))
            full = [i for i in range(1 << bits) if ends[i] > edges[i]]
            none = [None] * len(full)
            waiting.clear()
            return rows(full, none, none, none, [_planes(keys[edges[i] : ends[i]]) for i in full])

        held = 0
        for b in small_batches(batches):
            sizes, sets = [], []
            for s in shingle(texts_of(b, "_text")):
                sizes.append(len(s))
                sets.append(set_id(s) if len(s) else None)
                if len(s) and sets[-1] not in seen:
                    seen.add(sets[-1])
                    waiting.append(s >> shift)
                    held += len(s)
            if len(seen) > 1_000_000:
                seen.clear()
            ids = b.column(0).to_pylist()
            yield rows([int(x) for x in np.arange(b.num_rows) % (1 << bits)], ids, sizes, sets, [None] * b.num_rows)
            if held > flush:
                yield out()
                held = 0
        if waiting:
            yield out()

    def count(table: pa.Table) -> pa.Table:
        rows = table.select(["doc_id", "n", "id"]).filter(pa.compute.is_valid(table["n"]))
        pieces, bitmaps = [], []
        blobs = [b for b in table["blob"].to_pylist() if b is not None]
        if blobs:
            bucket = table["bucket"][0].as_py()
            keys, counts = np.unique(np.concatenate([_keys(b) for b in blobs]), return_counts=True)
            at = (keys >> np.uint64(KEY_BITS - BITMAP_BITS)).astype(np.int64) - (bucket << (BITMAP_BITS - bits))
            for c, least in enumerate(CLASSES):
                flags = np.zeros(1 << (BITMAP_BITS - bits), bool)
                flags[at[counts >= least]] = True
                pieces.append(c << bits | bucket)
                bitmaps.append(np.packbits(flags).tobytes())
        more = len(pieces)
        return pa.table(
            {
                "doc_id": pa.concat_arrays([*rows["doc_id"].chunks, pa.nulls(more, arrow_id)]),
                "n": pa.concat_arrays([*rows["n"].chunks, pa.nulls(more, pa.int64())]),
                "id": pa.concat_arrays([*rows["id"].chunks, pa.nulls(more, pa.int64())]),
                "piece": pa.array([None] * rows.num_rows + pieces, pa.int32()),
                "bits": pa.array([None] * rows.num_rows + bitmaps, pa.binary()),
            }
        )

    id_type = "string" if arrow_id == pa.string() else "bigint"
    raw = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("_text")).mapInArrow(
        run, f"bucket int, doc_id {id_type}, n bigint, id bigint, blob binary"
    )
    return raw.groupBy("bucket").applyInArrow(
        count, f"doc_id {id_type}, n bigint, id bigint, piece int, bits binary"
    )


def class_bitmaps(profiled: DataFrame) -> np.ndarray:
    """The class bitmaps, ``len(CLASSES)`` rows of ``2**BITMAP_BITS`` bits: a fixed size.

    The JVM holds several copies of the partition that it hands over, so the pieces, which
    may lie in one file, come in ``PARTS`` partitions.
    """
    rows = profiled.filter(F.col("piece").isNotNull()).select("piece", "bits").repartition(PARTS)
    out = np.zeros((len(CLASSES), 1 << (BITMAP_BITS - 3)), np.uint8)
    for r in rows.toLocalIterator():
        size = len(r["bits"])
        bits = ((1 << (BITMAP_BITS - 3)) // size).bit_length() - 1
        c, at = r["piece"] >> bits, (r["piece"] & ((1 << bits) - 1)) * size
        out[c, at : at + size] = np.frombuffer(r["bits"], np.uint8)
    return out


def _class_of(s: np.ndarray, bitmaps: np.ndarray) -> np.ndarray:
    at = s >> np.uint64(64 - BITMAP_BITS)
    byte, bit = (at >> np.uint64(3)).astype(np.int64), (7 - (at & np.uint64(7))).astype(np.uint8)
    return sum(((row[byte] >> bit) & 1).astype(np.int64) for row in bitmaps)


def prefixes(docs: DataFrame, sent: Broadcast, n: int, percent: int, k: int, text: str = "text") -> DataFrame:
    """``(token, id, n, *sketch)``: the extended prefix of each set, less shingles of one document.

    The sketch stands in the first row of a set only.

    ``sent`` holds the class bitmaps.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, seen, maps = Shingler(n), set(), sent.value
        for b in small_batches(batches):
            tokens, ids, sizes, marks = [], [], [], []
            sets = shingle(texts_of(b, "_text"))
            classes = _class_of(np.concatenate(sets), maps) if sets else None
            end = 0
            for s in sets:
                end += len(s)
                if not len(s) or (who := set_id(s)) in seen:
                    continue
                seen.add(who)
                if len(seen) > 1_000_000:
                    seen.clear()
                c = classes[end - len(s) : end]
                length = min(len(s), len(s) - -(-percent * len(s) // 100) + k)
                first = np.argsort(c, kind="stable")[:length]
                first = first[c[first] > 0]
                if len(first):
                    tokens.append(s[first])
                    ids.append(np.full(len(first), who))
                    sizes.append(np.full(len(first), len(s)))
                    marks.append(sketch(s))
            if tokens:
                # A set's sketch goes with its first row only.
                at = np.repeat(-1, sum(map(len, tokens)))
                at[np.cumsum([0, *map(len, tokens[:-1])])] = np.arange(len(tokens))
                which = pa.array(at, pa.int32(), mask=at < 0)
                marked = np.stack(marks)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(tokens).view(np.int64)), pa.array(np.concatenate(ids)), pa.array(np.concatenate(sizes)),
                     *[pa.array(marked[:, i]).take(which) for i in range(SKETCH)]],
                    names=["token", "id", "n", *BITS],
                )

    return docs.select(F.col(text).alias("_text")).mapInArrow(
        run, "token bigint, id bigint, n bigint, " + ", ".join(f"{b} bigint" for b in BITS)
    )


def verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` whose whole sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, 256):
            ok = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = np.sort(np.concatenate([x, y]))
                same = int((both[1:] == both[:-1]).sum())
                ok.append(100 * same >= percent * (len(both) - same))
            yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    second = pairs.join(sets.select(F.col("id").alias("b"), F.col("s").alias("y")), "b")
    both = second.join(sets.select(F.col("id").alias("a"), F.col("s").alias("x")), "a")
    return both.select("a", "b", "x", "y").mapInArrow(run, "a bigint, b bigint")


def components(links: DataFrame) -> DataFrame:
    """``(id, label)`` for every id in ``links (a, b)``: the least id of its component.

    Labels sink to the least neighbour's label and then jump to their label's label, so
    rounds grow with the logarithm of the longest chain. Each round is written.
    """
    both = written(links.union(links.select("b", "a")).toDF("id", "to").distinct(), "links")
    labels = written(both.groupBy("id").agg(F.min("to").alias("m")).select("id", F.least("id", "m").alias("label")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("id", "to"), "to").groupBy("id").agg(F.min("label").alias("m"))
        sunk = labels.join(near, "id").select("id", F.least("label", "m").alias("label"), F.col("label").alias("old"))
        to = sunk.select(F.col("id").alias("label"), F.col("label").alias("up"))
        new = written(sunk.join(to, "label", "left").select("id", F.least("label", F.coalesce("up", "label")).alias("label"), "old"), "labels")
        if new.filter(F.col("label") != F.col("old")).isEmpty():
            return new.select("id", "label")
        labels = new.select("id", "label")


def _close(a: str, b: str, percent: int):
    """Sizes that similar sets can have."""
    return (F.col(a) * 100 >= F.col(b) * percent) & (F.col(b) * 100 >= F.col(a) * percent)


def _near(a: str, b: str, percent: int):
    """Sketches that similar sets can have: they differ in at most as many bits as members."""
    differ = sum(F.bit_count(F.col(f"{a}.{s}").bitwiseXOR(F.col(f"{b}.{s}"))) for s in BITS)
    return differ * (100 + percent) <= (F.col(f"{a}.n") + F.col(f"{b}.n")) * (100 - percent)


def first_pairs(index: DataFrame, percent: int) -> DataFrame:
    """Each member of a list with the most central one of its size class and of the class below.

    Central is the member with the largest share of its prefix in lists: an original has few
    shingles of its own, while each of its copies brings some.
    """
    step = float(np.log(100 / percent))
    sized = index.withColumn("c", F.floor(F.log(F.col("n").cast("double")) / step).cast("int"))
    listed = index.groupBy("id").agg((F.count(F.lit(1)) / F.max("n")).alias("w"))
    heads = sized.join(listed, "id").groupBy("token", "c").agg(F.max(F.struct("w", "id", "n")).alias("h"))
    at = sized.withColumn("c", F.explode(F.array(F.col("c"), F.col("c") - 1)))
    met = at.join(heads, ["token", "c"]).filter((F.col("id") != F.col("h.id")))
    met = met.withColumn("hn", F.col("h.n")).filter(_close("n", "hn", percent))
    return met.select(F.least("id", F.col("h.id")).alias("a"), F.greatest("id", F.col("h.id")).alias("b")).distinct()


def later_pairs(index: DataFrame, labels: DataFrame, sketches: DataFrame, percent: int, few: int) -> DataFrame:
    """Pairs across components that share an indexed shingle, or two frequent ones."""
    named = written(
        index.join(labels, "id", "left").withColumn("label", F.coalesce("label", "id")), "index-labels"
    )
    sizes = named.groupBy("token", "label").agg(F.count(F.lit(1)).alias("m"))
    open_ = (
        sizes.groupBy("token")
        .agg(F.sum("m").alias("all"), F.max(F.struct("m", "label")).alias("top"))
        .filter(F.col("all") > F.col("top.m"))
        .select("token", F.col("top.label").alias("most"), (F.col("all") - F.col("top.m")).alias("rest"))
    )
    # Six sides of joins read it: a plan that held its joins six times would fill the driver.
    member = written(named.join(open_, "token").join(sketches, "id"), "open-lists")
    apart = (F.col("l.label") != F.col("r.label")) & _close("l.n", "r.n", percent) & _near("l", "r", percent)
    pair = [F.least("l.id", "r.id").alias("a"), F.greatest("l.id", "r.id").alias("b")]
    light = member.filter(F.col("rest") <= few)
    direct = (
        light.filter(F.col("label") != F.col("most")).alias("l")
        .join(light.alias("r"), F.col("l.token") == F.col("r.token"))
        .filter(apart).select(*pair)
    )
    heavy = member.filter(F.col("rest") > few).select("token", "id", "n", "label", *BITS)
    two = heavy.alias("x").join(heavy.alias("y"), F.col("x.id") == F.col("y.id")).filter("x.token < y.token").select(
        F.col("x.token").alias("t1"), F.col("y.token").alias("t2"), "x.id", "x.n", "x.label", *[f"x.{b}" for b in BITS]
    )
    combined = (
        two.alias("l").join(two.alias("r"), (F.col("l.t1") == F.col("r.t1")) & (F.col("l.t2") == F.col("r.t2")) & (F.col("l.id") < F.col("r.id")))
        .filter(apart).select(*pair)
    )
    return direct.union(combined).distinct()


def near_duplicates(
    docs: DataFrame, n: int = 5, percent: int = 80, k: int = 2, few: int = 64, text: str = "text", id_col: str = "doc_id"
) -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` per row of ``docs``.

    Null and empty texts have an empty set, link with nothing and are their own component;
    fewer than ``n`` words make one shingle. Documents with equal sets are linked, so
    repeated rows fall together. ``component_id`` is the least id of the component; null
    ids never name a component unless it has no other id. An empty table gives no rows.
    """
    docs = unclashed(docs, id_col, text)
    profiled = written(profile(docs, n, text, id_col), "shingle-profile")
    rows = profiled.filter(F.col("piece").isNull()).select("doc_id", "n", "id")
    sent = docs.sparkSession.sparkContext.broadcast(class_bitmaps(profiled))
    indexed = written(prefixes(docs, sent, n, percent, k, text).distinct(), "prefix-index")
    sent.destroy()  # what it served is written
    sketches = indexed.filter(F.col(BITS[0]).isNotNull()).select("id", *BITS)
    index = indexed.select("token", "id", "n")
    shared = index.groupBy("token").agg(F.count(F.lit(1)).alias("m")).filter("m > 1").select("token")
    index = written(index.join(shared, "token"), "prefix-lists")
    sets = _sets(docs, index.select("id").distinct(), n, text)
    one = written(first_pairs(index, percent), "pairs")
    linked = written(verify(one, sets, percent), "linked")
    labels = components(linked)
    two = later_pairs(index, labels, sketches, percent, few).join(one, ["a", "b"], "left_anti")
    two = written(two, "more-pairs")
    more = written(verify(two, sets, percent), "more-linked")
    if not more.isEmpty():
        labels = components(linked.union(more))
    # The least document of each set, then of each component: one row per set.
    least = rows.filter(F.col("id").isNotNull()).groupBy("id").agg(F.min("doc_id").alias("least"))
    named = written(least.join(labels, "id", "left").withColumn("label", F.coalesce("label", "id")), "set-labels")
    whole = named.groupBy("label").agg(F.min("least").alias("component_id"))
    by_set = named.join(whole, "label").select("id", "component_id")
    return rows.join(by_set, "id", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")
    )


def _sets(docs: DataFrame, wanted: DataFrame, n: int, text: str) -> DataFrame:
    """``(id, s)``: the whole shingle set of each wanted id, written once.

    Texts are reduced to sets in the task that reads them; which sets are wanted is tested
    against a bitmap of fixed size first, then exactly by the join.
    """
    bits = 24
    byte = F.shiftright(F.col("id"), 64 - bits).bitwiseAND((1 << bits) - 1)
    rows = wanted.select(F.floor(byte / 65_536).cast("int").alias("p"), (byte % 65_536).cast("int").alias("o"))

    def piece(table: pa.Table) -> pa.Table:
        flags = np.zeros(65_536, bool)
        flags[table["o"].to_numpy()] = True
        return pa.table({"p": [table["p"][0].as_py()], "bits": [np.packbits(flags).tobytes()]}, schema=pa.schema([("p", pa.int32()), ("bits", pa.binary())]))

    flags = np.zeros((1 << bits) // 8, np.uint8)
    for r in rows.distinct().groupBy("p").applyInArrow(piece, "p int, bits binary").toLocalIterator():
        flags[r["p"] * 8192 : (r["p"] + 1) * 8192] = np.frombuffer(r["bits"], np.uint8)
    sent = docs.sparkSession.sparkContext.broadcast(flags)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, seen, maybe = Shingler(n), set(), sent.value
        for b in small_batches(batches):
            ids, sets = [], []
            for s in shingle(texts_of(b, "_text")):
                if not len(s):
                    continue
                who = set_id(s)
                at = (who >> (64 - bits)) & ((1 << bits) - 1)
                if not maybe[at >> 3] >> (7 - (at & 7)) & 1 or who in seen:
                    continue
                seen.add(who)
                if len(seen) > 1_000_000:
                    seen.clear()
                ids.append(who)
                sets.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sets, pa.binary())], names=["id", "s"])

    made = docs.select(F.col(text).alias("_text")).mapInArrow(run, "id bigint, s binary")
    sets = written(made.join(wanted, "id", "left_semi").dropDuplicates(["id"]), "sets")
    sent.destroy()
    return sets
