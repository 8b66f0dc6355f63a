"""Mixing sources to target weights by repetition rates; DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from questloom.llm.common import unclashed, written

#: The word pattern as the SQL parser reads it inside a plain literal.
WORDS = r"[^\x20\x09-\x0D]+"


def n_words(text: str) -> Column:
    return F.coalesce(
        F.regexp_count(F.col(text), F.lit(WORDS)).cast("long"), F.lit(0).cast("long")
    )


def ranked_sources(sources: DataFrame) -> DataFrame:
    """Add ``pos``, the place of each source in code-point order, nulls last.

    The sources are range-partitioned and written, so that partitions stay as they are;
    then places inside a partition are shifted by the sizes of the partitions before it.
    Only that list of sizes, one row a partition, passes through a single task.
    """
    from pyspark.sql import Window

    key = [F.col("source").isNull(), F.col("source")]
    placed = written(
        sources.repartitionByRange(*key).withColumn("_p", F.spark_partition_id()), "sources"
    )
    sizes = placed.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_p").orderBy(*key)
    return (
        placed.withColumn("_i", F.row_number().over(inside) - 1)
        .join(shifts, "_p")
        .withColumn("pos", F.col("_i") + F.col("_before"))
        .drop("_p", "_i", "_before")
    )


def targets(
    sources: DataFrame, weights: Sequence[int], budget: float, most: float
) -> DataFrame:
    """``(source, source_size, target)``: the budget shared by weight, capped, reshared.

    ``budget`` and ``most`` are multiples of all sizes and of a source's size. A source
    is capped once its share passes its cap; the rest is shared by weight again, until no
    share passes. Each round reads two sums; shares only grow, so capped ones stay capped.
    """
    weight = F.element_at(
        F.array(*[F.lit(int(w)) for w in weights]), (F.col("pos") % len(weights) + 1).cast("int")
    )
    ranked = written(
        ranked_sources(sources)
        .withColumn("w", weight)
        .withColumn("cap", F.col("source_size") * F.lit(float(most))),
        "weights",
    )
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    level, n_capped = 0.0, -1
    while total:
        capped = F.col("cap") <= F.lit(level) * F.col("w")
        filled, free, n = ranked.agg(
            F.sum(F.when(capped, F.col("cap")).otherwise(0.0)),
            F.sum(F.when(~capped, F.col("w"))),
            F.count(F.when(capped, 1)),
        ).first()
        if n == n_capped or not free:
            break
        level, n_capped = (total * budget - filled) / free, n
    return ranked.select(
        "source", "source_size",
        F.least(F.col("cap"), F.lit(level) * F.col("w")).alias("target"),
    )


def unit_hash(seed: int, *cols: Column) -> Column:
    """A number in [0, 1) from the columns' text, the same on every run and every engine."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(c.cast("string"), F.lit("null")) for c in cols])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def mix(
    docs: DataFrame,
    weights: Sequence[int] = (5, 2, 1),
    budget: float = 1.5,
    most: float = 2.0,
    seed: int = 17,
    salts: int = 64,
    text: str = "text",
    carry: Sequence[str] = (),
) -> DataFrame:
    """``(doc_id, size, source_size, target, copies, taken, *carry)`` per row of ``docs``.

    A source's rate is target / size; each of its documents is taken floor(rate) times,
    and once more if its hash falls below the fraction. Null texts count 0 words; the null
    source is a source of its own, last in order. A source without words has target 0 and
    rate 0. Repeated rows draw alike, by ``doc_id``. Empty input gives no rows.

    Sizes are summed per source before the shuffle. The small table of sources is repeated
    once per salt and joined on (source, salt), so a hot source is spread over ``salts``
    tasks; only what is returned and the key travel.
    """
    sized = unclashed(docs, "doc_id", "source", text, *carry).select(
        "doc_id", "source", n_words(text).alias("size"), *carry
    )
    if not carry:  # the digest needs no text: keep the counts, read the texts once
        sized = written(sized, "sizes")
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    rates = targets(sums, weights, budget, most).withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    )
    left = sized.withColumn("_salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int"))
    rate = F.coalesce(F.try_divide(F.col("target"), F.col("source_size")), F.lit(0.0))
    extra = unit_hash(seed, F.col("doc_id")) < F.col("_rate") - F.floor("_rate")
    return (
        left.alias("d")
        .join(
            rates.alias("r"),
            F.col("d.source").eqNullSafe(F.col("r.source")) & (F.col("d._salt") == F.col("r._salt")),
        )
        .withColumn("_rate", rate)
        .withColumn("copies", (F.floor("_rate") + extra.cast("int")).cast("long"))
        .select(
            "doc_id", "size", "source_size", "target", "copies",
            (F.col("size") * F.col("copies")).alias("taken"),
            *[F.col(f"d.{c}") for c in carry],
        )
    )


#: The same for DuckDB; ``{docs}`` is a relation with doc_id, source, text.
MIX_SQL = r"""
_sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size
  FROM {docs}
), _sums AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM _sized GROUP BY source
), _weights AS (
  SELECT source, source_size, 2.0::DOUBLE * source_size AS cap,
    CASE (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3
      WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w
  FROM _sums
), _run AS (
  SELECT *, coalesce(sum(cap) OVER before, 0) AS filled, sum(w) OVER after AS free,
    sum(source_size) OVER () AS total, row_number() OVER (ORDER BY cap / w, source) AS rn
  FROM _weights
  WINDOW before AS (ORDER BY cap / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
    after AS (ORDER BY cap / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
), _level AS (
  SELECT coalesce(arg_min((total * 1.5::DOUBLE - filled) / free, rn)
    FILTER (cap > (total * 1.5::DOUBLE - filled) / free * w), 0.0) AS level FROM _run
), _targets AS (
  SELECT source, source_size, least(cap, level * w)::DOUBLE AS target FROM _weights, _level
), _rates AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
    CASE WHEN t.source_size = 0 THEN 0.0 ELSE t.target / t.source_size END AS rate,
    ('0x' || substr(md5('17|' || coalesce(d.doc_id::VARCHAR, 'null')), 1, 13))::BIGINT::DOUBLE
      / 4503599627370496.0::DOUBLE AS u
  FROM _sized d JOIN _targets t ON d.source IS NOT DISTINCT FROM t.source
), _mixed AS (
  SELECT doc_id, size, source_size, target,
    (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END)::BIGINT AS copies,
    (size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken
  FROM _rates
)"""
