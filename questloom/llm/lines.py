"""Removal of lines that many documents share; DataFrame functions only.

Line hashes are range-partitioned and sorted by document and position inside a hash. One
pass over that order streams the first occurrence in each document, which gives the
document count of a line and, if asked for, which occurrence is the first of all. What
comes back is a bitmap per document, not text: 64 lines a word, words without a dropped
line left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from questloom.llm.common import row_key, written

SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_lines(text: str) -> Column:
    return F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """A line without ASCII space at its ends, A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(SPACE)), UPPER, LOWER)


def drop_bitmaps(
    docs: DataFrame,
    min_docs: int = 10,
    min_chars: int = 1,
    keep_first: bool = False,
    salts: int = 32,
    text: str = "text",
    id_col: str = "doc_id",
) -> DataFrame:
    """``(_k1, _k2, dropped)``: word number -> bits of the dropped lines, per row key.

    Only documents that lose a line are listed. With ``keep_first`` the first line of a
    key, by document id and position, stays. The key of a line goes with a salt of its
    document, so a line that a third of all documents hold is spread over ``salts`` tasks.
    """
    lines = (
        docs.select(*row_key(id_col, text), F.col(id_col).alias("_doc"), F.posexplode(split_lines(text)).alias("_pos", "_line"))
        .withColumn("_key", line_key(F.col("_line")))
        .filter(F.char_length("_key") >= min_chars)
        .select(
            F.xxhash64("_key").alias("_h1"), F.xxhash64(F.lit(1), "_key").alias("_h2"),
            F.pmod(F.col("_k1"), F.lit(salts)).cast("int").alias("_salt"),
            "_doc", "_k1", "_k2", "_pos",
        )
    )
    here = Window.partitionBy("_h1", "_h2", "_salt").orderBy("_doc", "_k1", "_k2", "_pos")
    last = F.lag(F.struct("_k1", "_k2")).over(here)
    placed = written(
        lines.repartitionByRange("_h1", "_h2", "_salt")
        .withColumn("_first", (last.isNull() | (last != F.struct("_k1", "_k2"))).cast("long")),
        "line-hashes",
    )
    here_docs = placed.groupBy("_h1", "_h2", "_salt").agg(
        F.sum("_first").alias("_n"), F.min(F.struct("_doc", "_k1", "_k2", "_pos")).alias("_head")
    )
    shared = (
        here_docs.groupBy("_h1", "_h2")
        .agg(F.sum("_n").alias("_docs"), F.min("_head").alias("_head"))
        .filter(F.col("_docs") >= min_docs)
        .drop("_docs")
    )
    marked = here_docs.select("_h1", "_h2", "_salt").join(shared, ["_h1", "_h2"])
    gone = placed.join(marked, ["_h1", "_h2", "_salt"])
    if keep_first:
        gone = gone.filter(F.struct("_doc", "_k1", "_k2", "_pos") != F.col("_head"))
    bit = F.expr("shiftleft(1L, cast(_pos % 64 AS int))")
    return (
        gone.select("_k1", "_k2", F.expr("cast(_pos div 64 AS int)").alias("_w"), bit.alias("_b"))
        .repartition("_k1", "_k2")
        .groupBy("_k1", "_k2", "_w")
        .agg(F.bit_or("_b").alias("_b"))
        .groupBy("_k1", "_k2")
        .agg(F.map_from_entries(F.collect_list(F.struct("_w", "_b"))).alias("dropped"))
    )


def dedup_lines(docs: DataFrame, text: str = "text", id_col: str = "doc_id", **params) -> DataFrame:
    """``docs`` with ``text`` less the shared lines, plus ``_n_lines`` and ``_n_dropped``.

    A null or empty text is one empty line and becomes an empty text. Lines with an empty
    key always stay. A document is a row; repeated rows (same id, same text) count as one
    document and lose the same lines. Null ids are ids like any other. An empty table gives
    an empty table; other columns pass through, whatever their names.
    """
    names = docs.columns
    safe = {n: f"_c{i}" for i, n in enumerate(names)}
    docs, text, id_col = docs.toDF(*safe.values()), safe[text], safe[id_col]
    maps = drop_bitmaps(docs, text=text, id_col=id_col, **params)
    joined = docs.select("*", *row_key(id_col, text)).join(maps, ["_k1", "_k2"], "left")
    joined = joined.withColumn("_all", split_lines(text))
    none = F.col("dropped").isNull()
    bits = lambda i: F.try_element_at(F.col("dropped"), F.floor(i / 64).cast("int"))
    bit = lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), (i % 64).cast("int"))
    zero = F.lit(0).cast("long")
    stays = F.filter("_all", lambda line, i: F.coalesce(bits(i).bitwiseAND(bit(i)), zero) == 0)
    kept = F.when(none, F.coalesce(F.col(text), F.lit(""))).otherwise(F.array_join(stays, "\n"))
    n_dropped = F.aggregate(F.map_values("dropped"), zero, lambda a, b: a + F.bit_count(b))
    return joined.select(
        *[kept if c == text else F.col(c) for c in safe.values()],
        F.size("_all").cast("long"), F.coalesce(n_dropped, zero),
    ).toDF(*names, "_n_lines", "_n_dropped")


#: The same for DuckDB; ``{docs}`` has doc_id and text.
LINES_SQL = r"""
_lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
    generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM {docs}
), _keys AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM _lines
), _shared AS (
  SELECT key FROM _keys WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10
), _kept AS (
  SELECT doc_id, count(*)::BIGINT AS n_lines,
    count(*) FILTER (key IN (SELECT key FROM _shared))::BIGINT AS n_dropped,
    coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (key NOT IN (SELECT key FROM _shared)), '') AS kept
  FROM _keys GROUP BY doc_id
)"""
