"""Token counts by a compiled transducer whose chunk maps compose in a prefix scan.

No piece of the vocabulary holds a space mark after another character (checked when the
model is compiled), so merges never cross the border before a run of marks. That gives a
deterministic transducer over text: its states are "at a border" and "inside a unit"
(marks followed by other characters), and the transition that closes a unit is annotated
with the number of tokens that the unit emits. A unit's number comes from the library
itself the first time the unit is met and is then an arc of the transducer.

A chunk of text is a map from the state before it to the state after it. Such a map is
held as ``(head, tokens, tail, closed)``: the piece of an open unit at its start, the
tokens of the units closed inside, the open unit at its end, and whether a border lies
inside. ``compose`` joins two neighbouring maps and is associative, so the maps of a long
text are reduced pairwise, in log(n) rounds.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from questloom.llm.common import texts_of, small_batches, unclashed, with_columns

MARK = "▁"
_UNITS = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")


class Transducer:
    """Arcs from units to token counts, compiled from a sentencepiece model on first use.

    ``arcs`` bounds how many are kept; past it the table starts anew. Units longer than
    ``longest`` are counted by the library each time and not kept.
    """

    def __init__(self, model: str, arcs: int = 400_000, longest: int = 64) -> None:
        import sentencepiece

        self.lib = sentencepiece.SentencePieceProcessor(model_file=model)
        for i in range(self.lib.get_piece_size()):
            if MARK in self.lib.id_to_piece(i).lstrip(MARK):
                raise ValueError("a piece crosses a unit border; units cannot be counted apart")
        if self.lib.encode("a  b", out_type=str)[-1] != f"{MARK}b":
            raise ValueError("the model changes white space; units cannot be counted apart")
        self.arcs, self.longest = arcs, longest
        self.table: dict[str, int] = {}

    def unit(self, u: str) -> int:
        """Tokens of one whole unit. The library puts one mark in front by itself."""
        n = self.table.get(u)
        if n is None:
            n = 1 if u == MARK else len(self.lib.encode(u[1:])) if u[0] == MARK else None
            if n is None:
                raise ValueError("a unit begins with a mark")
            if len(u) <= self.longest:
                if len(self.table) >= self.arcs:
                    self.table.clear()
                self.table[u] = n
        return n

    def chunk(self, text: str) -> tuple[str, int, str, bool]:
        """The map of a chunk: what is open at either end and what is closed between.

        A unit is closed by the border after it, so the last one stays open. A leading run
        of marks may continue an open run before the chunk and is left in ``head``.
        """
        units = _UNITS.findall(text)
        if len(units) < 2:
            return (text, 0, "", False)
        get, table = self.unit, self.table
        total = 0
        for u in units[1:-1]:
            n = table.get(u)
            total += get(u) if n is None else n
        return (units[0], total, units[-1], True)

    def compose(self, a: tuple[str, int, str, bool], b: tuple[str, int, str, bool]):
        """The map of two neighbouring chunks."""
        if not a[3]:
            left = self._join(a[0], b[0])
            if len(left) == 1:
                return (left[0], b[1], b[2], b[3])
            if b[3]:
                return (left[0], b[1] + sum(map(self.unit, left[1:])), b[2], True)
            return (left[0], sum(map(self.unit, left[1:-1])), left[-1], True)
        mid = self._join(a[2], b[0])
        if b[3]:
            return (a[0], a[1] + sum(map(self.unit, mid)) + b[1], b[2], True)
        return (a[0], a[1] + sum(map(self.unit, mid[:-1])), mid[-1], True)

    @staticmethod
    def _join(tail: str, head: str) -> list[str]:
        """Units of an open piece and the piece that follows it: one, or two at a border."""
        if tail and head and head[0] == MARK and tail.strip(MARK):
            return [tail, head]
        return [tail + head]

    def count(self, text: str, size: int = 65_536) -> int:
        """Tokens of a text: maps of its chunks, reduced pairwise, closed at both ends."""
        if not text:
            return 0
        text = MARK + text.replace(" ", MARK)
        maps = [self.chunk(text[i : i + size]) for i in range(0, len(text), size)]
        while len(maps) > 1:
            pairs = [self.compose(a, b) for a, b in zip(maps[::2], maps[1::2], strict=False)]
            maps = pairs + maps[len(pairs) * 2 :]
        head, total, tail, closed = maps[0]
        return total + self.unit(head) + (self.unit(tail) if closed else 0)


def token_counts(
    docs: DataFrame, model: str, limit: int = 4096, text: str = "text", keep: tuple[str, ...] = ("doc_id",)
) -> DataFrame:
    """``(*keep, n_bytes, n_tokens, over_limit)`` per row of ``docs``; no shuffle.

    Null and empty texts have 0 bytes and 0 tokens. Texts of any length are counted whole.
    Repeated rows and null ids are counted like any other row; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Transducer(model)
        for b in small_batches(batches):
            n = [machine.count(t) for t in texts_of(b, "_text")]
            yield with_columns(b.drop_columns(["_text"]), n_tokens=pa.array(n, pa.int64()))

    base = unclashed(docs, *keep, text).select(
        *keep,
        F.coalesce(F.octet_length(F.col(text)).cast("long"), F.lit(0).cast("long")).alias("n_bytes"),
        F.col(text).alias("_text"),
    )
    out = base.drop("_text").schema.add("n_tokens", "long")
    return base.mapInArrow(run, out).withColumn("over_limit", F.col("n_tokens") > limit)
