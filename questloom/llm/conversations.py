"""Repair of conversation structure: the cheapest edits that restore the order of roles.

A row is kept (K, 0), given another role (R, 3) or deleted (D, 4), and empty rows may be put
in (I, 3), so that role initials read ``(s?(ua)+)?``; among the cheapest edits those with the
least text of initials are taken. Rows are sorted over the whole table and cut into blocks,
so a conversation of any length is solved in parts: each part's costs are a small matrix,
parts are joined by their matrices, and every part then finds its least path from each state
it may be entered in. Texts are not moved for this; they are read once, in order, at the end.

Inside a block a suffix scan of min-plus products gives the cost from every node (row and
role state). Nodes are ranked by their least edit texts of 1, 2, 4, ... letters, each rank
being made of two ranks of half the length; of a node's optimal arcs the one with the least
letter and the least ranked end is taken, and doubled pointers list the path.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from questloom.llm.common import unclashed, written

_NEVER = 1 << 40
_DELETE, _INSERT, _REROLE, _CUT = 4, 3, 3, 3
#: States: nothing yet, after system, after user, after assistant. The end may follow 0 and 3.
_OPEN, _DONE = 0, (True, False, False, True)
#: The state that a user or assistant row, whichever is due, leads to.
_NEXT = np.array([2, 2, 3, 2])
#: The state after a kept row by its initial (s, u, a, other); 4 where it may not come.
_KEEP = np.array([[1, 4, 4, 4], [2, 2, 4, 2], [4, 4, 3, 4], [4, 4, 4, 4]])
#: Letters of edits by their rank; 0 ends a path.
_LETTERS = np.array(["", "D", "I", "K", "R"])
_PLAIN, _TRUNCATED, _BLANK, _DUPLICATE = 0, 1, 2, 3


def damage(rows: DataFrame, faults: int = 20) -> DataFrame:
    """The rows with planted faults, dropped ones marked; nulls become one space."""

    def plain(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    fault = F.crc32(F.concat(plain("conv_id"), F.lit(":"), plain("turn")).cast("binary")) % faults
    text = F.when(fault == 1, F.lit("")).when(fault == 2, F.translate(plain("text"), ".!?", "")).otherwise(plain("text"))
    role = F.when(fault == 4, F.lit("user")).otherwise(plain("role"))
    copies = F.when(fault == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return unclashed(rows, "conv_id", "turn", "role", "text").select(
        "conv_id", F.col("turn").try_cast("long").alias("turn"), role.alias("role"), text.alias("text"),
        (fault == 0).alias("dropped"), F.explode(copies).alias("_copy"),
    ).drop("_copy")


def _keyed(rows: DataFrame) -> DataFrame:
    """Rows with a 128-bit stand-in for their text; it also orders rows of one turn and role."""
    return rows.withColumn("k1", F.xxhash64("text")).withColumn("k2", F.xxhash64(F.lit(1), "text"))


_ORDER = ("conv_id", "turn", "role", "k1", "k2")


def _sorted_rows(rows: DataFrame, block: int) -> DataFrame:
    """The rows without text, sorted over the whole table, with their place and block."""
    text = F.rtrim("text", F.lit(" \t\n\x0b\x0c\r"))
    status = (
        F.when(text == "", _BLANK).when(~F.substring(text, -1, 1).isin(".", "!", "?"), _TRUNCATED).otherwise(_PLAIN)
    )
    first = F.substring("role", 1, 1)
    initial = F.when(first == "s", 0).when(first == "u", 1).when(first == "a", 2).otherwise(3)
    light = _keyed(rows.filter(~F.col("dropped"))).select(
        *_ORDER, F.xxhash64(F.col("conv_id").isNull(), F.col("conv_id")).alias("ck"),
        initial.cast("int").alias("initial"), status.cast("int").alias("status"),
    )
    placed = light.repartitionByRange(*_ORDER, F.xxhash64(F.monotonically_increasing_id())).sortWithinPartitions(*_ORDER)
    placed = written(placed.withColumn("pos", F.monotonically_increasing_id()), "turns")
    # Below 2^33 the place counts the rows of a partition.
    return placed.withColumn("block", F.floor(F.col("pos") / block).cast("long"))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray | pa.Array]]:
    """The rows of one block at a time; batches are sorted by block."""
    held: list[pa.RecordBatch] = []

    def whole():
        return pa.Table.from_batches(held).combine_chunks()

    for b in batches:
        if not b.num_rows:
            continue
        at = b.column(0).to_numpy()
        edges = np.flatnonzero(np.diff(at)) + 1
        for lo, hi in zip([0, *edges], [*edges, b.num_rows], strict=True):
            if held and held[0].column(0)[0].as_py() != at[lo]:
                yield whole()
                held = []
            held.append(b.slice(lo, hi - lo))
    if held:
        yield whole()


def _nullable(table: pa.Table) -> pa.Table:
    """The same columns, all nullable, so that every batch of a task has one schema."""
    return pa.table(table.columns, names=table.schema.names)


# Costs ------------------------------------------------------------------------

def _join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Min-plus products of stacked matrices (or of a matrix and a vector)."""
    if b.ndim == a.ndim:
        return np.minimum((a[..., :, :, None] + b[..., None, :, :]).min(-2), _NEVER)
    return np.minimum((a + b[..., None, :]).min(-1), _NEVER)


def _inserts() -> np.ndarray:
    one = np.full((4, 4), _NEVER)
    one[np.arange(4), _NEXT] = _INSERT
    one[np.arange(4), np.arange(4)] = 0
    return _join(one, one)


_PUT = _inserts()
#: From a state to the end of a conversation without further rows.
_END = _join(_PUT, np.where(_DONE, 0, _NEVER))


def _row_costs(initial: np.ndarray, status: np.ndarray) -> np.ndarray:
    """What a row costs from state to state, with empty rows put in before it."""
    n = len(initial)
    cost = np.full((n, 4, 5), _NEVER)
    state = np.arange(4)
    cost[:, state, state] = _DELETE
    stays = status < _BLANK
    more = np.where(status == _TRUNCATED, _CUT, 0)
    for s in state:
        cost[:, s, _NEXT[s]] = np.where(stays, np.minimum(cost[:, s, _NEXT[s]], _REROLE + more), cost[:, s, _NEXT[s]])
        to = _KEEP[initial, s]
        row = np.flatnonzero(stays & (to < 4))
        cost[row, s, to[row]] = np.minimum(cost[row, s, to[row]], more[row])
    return _join(np.broadcast_to(_PUT, (n, 4, 4)), cost[:, :, :4])


def _suffixes(cost: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For every row the costs from its state to that at the end of its run, by doubling."""
    out, step, at = cost, 1, np.arange(len(cost))
    while True:
        more = np.flatnonzero(at + step < ends)
        if not len(more):
            return out
        out = out.copy()
        out[more] = _join(out[more], out[more + step])
        step *= 2


class _Runs:
    """The conversations of a block: where each starts and ends."""

    def __init__(self, conversations: np.ndarray):
        n = len(conversations)
        self.start = np.concatenate([[0], np.flatnonzero(np.diff(conversations)) + 1]) if n else np.zeros(0, np.int64)
        self.end = np.concatenate([self.start[1:], [n]]) if n else self.start
        self.of = np.repeat(np.arange(len(self.start)), self.end - self.start)


def _edges(table: pa.Table) -> tuple[pa.Table, list[tuple[int, np.ndarray]]]:
    """Block rows with duplicates settled, and the matrices of the first and the last run.

    A row with a mark behind it is the first of its role and text in the conversation.
    """
    mark = table.column("mark").to_numpy(zero_copy_only=False)
    first = np.zeros(len(mark), bool)
    first[:-1] = mark[1:]
    rows, first = table.filter(pa.array(~mark)), first[~mark]
    status = rows.column("status").to_numpy().astype(np.int64)
    status = np.where((status != _BLANK) & ~first, _DUPLICATE, status)
    rows = rows.set_column(rows.schema.get_field_index("status"), "status", pa.array(status, pa.int32()))
    runs = _Runs(rows.column("ck").to_numpy())
    found = []
    for r in sorted({0, len(runs.start) - 1}):
        at = slice(runs.start[r], runs.end[r])
        cost = _row_costs(rows.column("initial").to_numpy()[at].astype(np.int64), status[at])
        whole = _suffixes(cost, np.full(len(cost), len(cost)))[0]
        found.append((int(rows.column("ck")[int(runs.start[r])].as_py()), whole))
    return rows, found


def _chains(part: pa.Table) -> pa.Table:
    """The parts of one long conversation, joined: what each costs to leave in each state."""
    part = part.sort_by("block")
    blocks, costs = part.column("block").to_pylist(), np.array(part.column("cost").to_pylist()).reshape(-1, 4, 4)
    out, after = [], _END
    for i in range(len(blocks) - 1, -1, -1) if len(blocks) > 1 else ():
        out.append((blocks[i], i > 0, after.tolist() if i + 1 < len(blocks) else None))
        after = _join(costs[i], after)
    return pa.table(
        {"block": pa.array([b for b, *_ in out], pa.int64()), "goes_on": pa.array([g for _, g, _ in out], pa.bool_()),
         "after": pa.array([a for *_, a in out], pa.list_(pa.int64()))}
    )


# Least paths ------------------------------------------------------------------

def least_paths(initial: np.ndarray, status: np.ndarray, runs: _Runs, entered: bool, after: np.ndarray | None):
    """Edits per row for every way in: ``(edits, exits)``, lists of one string per row.

    The first run has four ways in if it is ``entered`` from the block before; the last one
    leaves to the next block where ``after`` says what that costs. A row's edits are the
    letters before and on it, ways in set apart by ``|``; a run's last row also holds what is
    put in at the end, and ``exits`` the states in which each way in leaves.
    """
    n, many = len(initial), len(runs.start)
    # Nodes: four states before every row, and four at the end of every run.
    place = np.arange(n) + runs.of
    end_place = runs.end + np.arange(many)
    last = np.tile(_END, (many, 1))
    if after is not None:
        last[-1] = after
    back = np.empty((n + many, 4), np.int64)
    back[place] = _join(_suffixes(_row_costs(initial, status), runs.end[runs.of]), last[runs.of])
    back[end_place] = last
    size = 4 * (n + many)
    node, state = np.arange(size).reshape(-1, 4), np.tile(np.arange(4), (n + many, 1))
    arcs = np.full((4, size), -1)  # by letter: D, I, K, R
    put = back == _INSERT + np.take_along_axis(back, _NEXT[state], 1)
    leaves = np.zeros((n + many, 4), bool)
    leaves[end_place] = np.array(_DONE)
    if after is not None:
        leaves[end_place[-1]] = True
    arcs[1] = np.where(put & ~leaves, node - state + _NEXT[state], -1).ravel()
    here, there = back[place], back[place + 1]
    more = np.where(status == _TRUNCATED, _CUT, 0)[:, None]
    stays = (status < _BLANK)[:, None]
    at, s = node[place], state[place]
    arcs[0, at] = np.where(here == _DELETE + there, at + 4, -1)
    to = _KEEP[initial]
    fits = stays & (to < 4)
    kept = np.take_along_axis(there, np.minimum(to, 3), 1)
    arcs[2, at] = np.where(fits & (here == more + kept), at + 4 - s + np.minimum(to, 3), -1)
    arcs[3, at] = np.where(
        stays & (here == _REROLE + more + np.take_along_axis(there, _NEXT[s], 1)), at + 4 - s + _NEXT[s], -1
    )

    def taken(rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each node's least arc by letter, then by the rank of its end."""
        key = np.where(arcs >= 0, np.arange(1, 5)[:, None] * (size + 1) + rank[arcs], np.iinfo(np.int64).max)
        letter = key.argmin(0)
        ends = (arcs >= 0).any(0)
        return np.where(ends, letter + 1, 0), np.where(ends, arcs[letter, np.arange(size)], np.arange(size))

    letter, jump = taken(np.zeros(size, np.int64))
    rank, ahead = letter.astype(np.int64), jump
    while (ahead != ahead[ahead]).any():  # letters of twice as many edits in each round
        _, rank = np.unique(rank * (size + 5) + rank[ahead], return_inverse=True)
        ahead = ahead[ahead]
    letter, jump = taken(rank)
    jumps = [jump]
    while (jumps[-1] != jumps[-1][jumps[-1]]).any():
        jumps.append(jumps[-1][jumps[-1]])

    ways = np.concatenate([np.repeat(0, 4 if entered else 1), np.arange(1, many)])
    entry = np.concatenate([np.arange(4 if entered else 1), np.zeros(many - 1, np.int64)])
    root = 4 * place[runs.start[ways]] + entry
    on, offset, way = root, np.zeros(len(root), np.int64), np.arange(len(root))
    for k in range(len(jumps) - 1, -1, -1):
        on, offset, way = np.concatenate([on, jumps[k][on]]), np.concatenate([offset, offset + (1 << k)]), np.concatenate([way, way])
        live = letter[on] > 0
        on, offset, way = on[live], offset[live], way[live]
    exits_of = jumps[-1][root]
    order = np.lexsort((offset, way))
    on, way = on[order], way[order]
    texts = _LETTERS[letter[on]]
    # A place's row; what is put in at the end of a run goes to its last row.
    row_of = np.empty(n + many, np.int64)
    row_of[place], row_of[end_place] = np.arange(n), runs.end - 1
    rows = row_of[on // 4]
    edits = [""] * n
    new = np.flatnonzero(np.concatenate([[True], (rows[1:] != rows[:-1]) | (way[1:] != way[:-1])])) if len(rows) else np.zeros(0, np.int64)
    pieces = [""] * len(new)
    joined = "".join(texts)  # every letter is one character
    for i, (lo, hi) in enumerate(zip(new, [*new[1:], len(rows)], strict=True)):
        pieces[i] = joined[lo:hi]
    exits = [None] * n
    for row, w, text in zip(rows[new], way[new], pieces, strict=True):
        edits[row] = text if w == 0 or ways[w] != 0 else f"{edits[row]}|{text}"
    if entered:
        exits[runs.end[0] - 1] = "".join(str(x % 4) for x in exits_of[:4])
    if after is not None and not (entered and many == 1):
        exits[runs.end[-1] - 1] = str(exits_of[-1] % 4)
    return edits, exits


def _decided(rows: DataFrame, block: int) -> DataFrame:
    """``(keys of the row, pos, status, edits, exits)`` for every row that is not dropped."""
    placed = _sorted_rows(rows, block)
    light = "block long, pos long, mark boolean, ck long, initial int, status int"
    keys = ", ".join(f"{c} {placed.schema[c].dataType.simpleString()}" for c in _ORDER)
    none = {c: F.lit(None).cast(placed.schema[c].dataType) for c in (*_ORDER, "ck", "initial", "status")}
    firsts = placed.groupBy("conv_id", "role", "k1", "k2").agg(F.min("pos").alias("pos"))
    marks = firsts.select(F.floor(F.col("pos") / block).cast("long").alias("block"), "pos", F.lit(True).alias("mark"), *[none[c].alias(c) for c in ("ck", "initial", "status", *_ORDER)])
    plain = placed.select("block", "pos", F.lit(False).alias("mark"), "ck", "initial", "status", *_ORDER)

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _blocks(batches):
            out, found = _edges(table)
            blank = pa.nulls(out.num_rows, pa.list_(pa.int64()))
            yield from _nullable(out.append_column("cost", blank)).to_batches()
            at = [table.column("block")[0].as_py()] * len(found)
            edge = {c: pa.nulls(len(found), out.schema.field(c).type) for c in out.schema.names}
            edge |= {
                "block": pa.array(at, pa.int64()), "pos": pa.array([-1] * len(found), pa.int64()), "mark": pa.array([True] * len(found)),
                "ck": pa.array([c for c, _ in found], pa.int64()), "cost": pa.array([m.ravel().tolist() for _, m in found], pa.list_(pa.int64())),
            }
            yield from pa.table([edge[c] for c in [*out.schema.names, "cost"]], names=[*out.schema.names, "cost"]).to_batches()

    both = plain.unionByName(marks).repartition("block").sortWithinPartitions("block", "pos", "mark")
    settled = written(both.mapInArrow(settle, f"{light}, {keys}, cost array<bigint>"), "settled")
    edges = settled.filter("mark").select("ck", "block", "cost")
    chains = edges.groupBy("ck").applyInArrow(_chains, "block long, goes_on boolean, after array<bigint>")

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _blocks(batches):
            told = table.filter(pa.array(table.column("mark").to_numpy(zero_copy_only=False))).to_pylist()
            table = table.filter(pa.array(~table.column("mark").to_numpy(zero_copy_only=False)))
            after = next((np.array(r["after"]) for r in told if r["after"] is not None), None)
            status = table.column("status").to_numpy().astype(np.int64)
            edits, exits = least_paths(
                table.column("initial").to_numpy().astype(np.int64), status, _Runs(table.column("ck").to_numpy()),
                any(r["goes_on"] for r in told), after,
            )
            out = table.select([*_ORDER, "pos", "status"]).append_column("edits", pa.array(edits, pa.string()))
            yield from _nullable(out.append_column("exits", pa.array(exits, pa.string()))).to_batches()

    kept = settled.filter(~F.col("mark")).select(
        "block", "pos", "mark", "ck", "initial", "status", *_ORDER, F.lit(False).alias("goes_on"), F.lit(None).cast("array<bigint>").alias("after")
    )
    notes = chains.select("block", F.lit(-1).cast("long").alias("pos"), F.lit(True).alias("mark"), *[none[c].alias(c) for c in ("ck", "initial", "status", *_ORDER)], "goes_on", "after")
    told = kept.unionByName(notes).repartition("block").sortWithinPartitions("block", "pos")
    return told.mapInArrow(solve, f"{keys}, pos long, status int, edits string, exits string")


# Results ----------------------------------------------------------------------

_ROLES = {"s": 1, "u": 2, "a": 3}


class _Walk:
    """One conversation read in order: its repaired rows and what they add up to."""

    def __init__(self, conversation, rows: bool):
        self.conversation, self.want = conversation, rows
        self.lane = self.state = 0
        self.turns, self.least, self.most, self.turn = 0, None, None, None
        self.faults = [0, 0, 0, 0]
        self.illegal = self.cost = self.length = 0
        self.before: str | None = None
        self.audit: list[str] = []
        self.sha = hashlib.sha256()
        self.out: list[tuple] = []

    def _put(self, edit: str, role: str, text: str) -> None:
        self.state = _ROLES[role[:1]]
        line = f"{role}:{text}"
        self.sha.update((line if not self.length else "\n" + line).encode())
        if self.want:
            self.out.append((self.conversation, self.length, role, text, edit))
        self.length += 1

    def row(self, turn, role: str, text: str, status: int, edits: str, exits: str | None) -> None:
        if turn is not None and turn != self.turn:
            self.turns += 1
            self.least, self.most, self.turn = turn if self.least is None else self.least, turn, turn
        self.faults[status] += 1
        if self.before is not None and self.before[:1] + role[:1] not in ("su", "ua", "au"):
            self.illegal += 1
        self.before = role
        mine = edits.split("|")[self.lane] if "|" in edits else edits
        self.audit.append(mine)
        for e in mine:
            due = "assistant" if self.state == 2 else "user"
            if e == "D":
                self.cost += _DELETE
            elif e == "I":
                self.cost += _INSERT
                self._put(e, due, "")
            else:
                self.cost += (_REROLE if e == "R" else 0) + (_CUT if status == _TRUNCATED else 0)
                self._put(e, role if e == "K" else due, text)
        if exits:
            self.lane = int(exits[self.lane])

    def summary(self) -> tuple:
        gaps = self.most - self.least + 1 - self.turns if self.turns else 0
        return (
            self.conversation, gaps, self.faults[_BLANK], self.faults[_DUPLICATE], self.faults[_TRUNCATED],
            self.illegal, self.cost, "".join(self.audit), self.sha.hexdigest(),
        )


def _walked(rows: DataFrame, block: int, want_rows: bool) -> DataFrame:
    """Texts meet their edits in order; a conversation streams through, none is held.

    Rows alike in all keys are interchangeable, so the n-th of them takes the n-th edits.
    """
    kind = rows.schema["conv_id"].dataType.simpleString()
    edits = _decided(rows, block)
    texts = _keyed(rows).select(
        *_ORDER, F.lit(True).alias("has_text"), F.lit(-1).cast("long").alias("pos"), "text", "dropped",
        F.lit(None).cast("int").alias("status"), F.lit(None).cast("string").alias("edits"), F.lit(None).cast("string").alias("exits"),
    )
    plans = edits.select(
        *_ORDER, F.lit(False).alias("has_text"), "pos", F.lit(None).cast("string").alias("text"), F.lit(False).alias("dropped"),
        "status", "edits", "exits",
    )
    result = (
        f"conv_id {kind}, seq long, role string, text string, edit string" if want_rows
        else f"conv_id {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
    )
    names = [x.split(" ")[0] for x in result.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk: _Walk | None = None
        waiting: deque = deque()
        ready: list[tuple] = []
        types = None

        def flush():
            batch = pa.RecordBatch.from_arrays([pa.array([r[i] for r in ready], types[i]) for i in range(len(names))], names=names)
            ready.clear()
            return batch

        for b in batches:
            types = types or [
                b.schema.field(0).type, *([pa.int64(), pa.string(), pa.string(), pa.string()] if want_rows else [pa.int64()] * 6 + [pa.string()] * 2)
            ]
            get = {c: b.column(i) for i, c in enumerate(b.schema.names)}
            for lo in range(0, b.num_rows, 1024):
                cut = {c: get[c].slice(lo, 1024).to_pylist() for c in ("conv_id", "turn", "role", "has_text", "text", "dropped", "status", "edits", "exits")}
                for conversation, turn, role, has_text, text, dropped, status, plan, leaves in zip(*cut.values(), strict=True):
                    if walk is None or conversation != walk.conversation:
                        if walk is not None and not want_rows:
                            ready.append(walk.summary())
                        walk = _Walk(conversation, want_rows)
                        waiting.clear()
                    if not has_text:
                        waiting.append((status, plan, leaves))
                    elif not dropped:
                        walk.row(turn, role, text, *waiting.popleft())
                        if want_rows:
                            ready += walk.out
                            walk.out.clear()
                if len(ready) >= 1024:
                    yield flush()
        if walk is not None and not want_rows:
            ready.append(walk.summary())
        if ready:
            yield flush()

    # Dropped rows only show that their conversation exists.
    both = texts.unionByName(plans).repartition("conv_id").sortWithinPartitions(*_ORDER, "has_text", "dropped", "pos")
    return both.mapInArrow(run, result)


def repair(rows: DataFrame, block: int = 65_536) -> DataFrame:
    """``(conv_id, seq, role, text, edit)``: the rows of every repaired conversation.

    ``rows`` is ``(conv_id, turn, role, text, dropped)`` as ``damage`` gives it, without null
    roles and texts. Rows are taken by turn, nulls first; rows of one turn by role, then by a
    hash of their text. ``edit`` is K, R or I; deleted rows are gone.
    """
    return _walked(rows, block, True)


def repair_summary(rows: DataFrame, block: int = 65_536) -> DataFrame:
    """One row per conversation: its faults, the cost and text of its edits, and a hash.

    A null ``conv_id`` is a conversation of its own. A conversation whose rows are all
    dropped has zeros, no edits and the hash of nothing. Rows that repeat are duplicates;
    texts of any length are hashed as they stream by; an empty table gives an empty one. The
    hash of one conversation needs its texts in order, so they pass through one task, a
    batch at a time; everything else about it is solved block by block.
    """
    return _walked(rows, block, False)
