"""Reusable analytical patterns over a fact table and its dimensions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from questloom.functions.groups import exact_quantiles, first_per_group
from questloom.functions.values import fixed2_of, to_number, to_number_commas
from questloom.rules import questions as R


def in_year(df: DataFrame, date: str, year: int) -> Column:
    """Rows of a year: a range for dates, which prunes row groups, else the text's first digits."""
    kind = df.schema[date].dataType.typeName()
    if kind in ("date", "timestamp", "timestamp_ntz"):
        first, after = (F.lit(f"{y}-01-01").cast(kind) for y in (year, year + 1))
        return (F.col(date) >= first) & (F.col(date) < after)
    return F.col(date).cast("string").startswith(str(year))


def filter_by_dimension(
    fact: DataFrame, dim: DataFrame, on: Column, date: str, year: int, column: str, value: str
) -> DataFrame:
    """Fact rows of one year whose dimension row holds ``value``, case ignored."""
    return fact.filter(in_year(fact, date, year)).join(
        dim.filter(F.lower(F.col(column).cast("string")) == value.lower()), on
    )


def joined_filter(
    left: DataFrame, right: DataFrame, on: tuple[str, str], where: Sequence[Column], columns: Sequence[Column]
) -> DataFrame:
    """Columns of two tables joined on keys as text, under predicates on either.

    Predicates of one side are pushed below the join by the optimiser.
    """
    same = F.col(on[0]).cast("string") == F.col(on[1]).cast("string")
    joined = left.join(right, same)
    for condition in where:
        joined = joined.filter(condition)
    return joined.select(*columns)


def average_monthly(
    rows: DataFrame, metric: str, period: str, entity: str, by: Sequence[str] = ()
) -> DataFrame:
    """Four readings of 'average monthly', one row per formula (and per ``by`` key).

    Rows are first reduced to one per (entity, period); both follow-up aggregates read
    that small result.
    """
    keys = list(by)
    base = (
        rows.withColumn("_m", F.col(metric).try_cast("double"))
        .groupBy(*keys, F.col(entity).alias("_e"), F.col(period).cast("string").alias("_p"))
        .agg(F.sum("_m").alias("_s"), F.count("_m").alias("_n"))
    )
    whole = base.groupBy(*keys).agg(
        F.sum("_s").alias("_s"), F.sum("_n").alias("_n"), F.count_distinct("_p").alias("_months")
    )
    stacked = whole.select(
        *keys,
        F.expr(
            "stack(3, 'avg_metric_div_12', try_divide(_s, _n) / 12,"
            " 'sum_metric_div_12', _s / 12,"
            " 'sum_metric_div_distinct_month', try_divide(_s, _months)) AS (formula, value)"
        ),
    )
    per_entity = base.groupBy(*keys, "_e").agg(F.sum("_s").alias("_s"))
    annual = per_entity.groupBy(*keys).agg((F.avg("_s") / 12).alias("value")).select(
        *keys, F.lit("avg_entity_annual_div_12").alias("formula"), "value"
    )
    return stacked.unionByName(annual)


def _close(a: Column, b: Column) -> Column:
    limit = F.greatest(F.lit(1e-6) * F.greatest(F.abs(a), F.abs(b)), F.lit(1e-6))
    return F.coalesce(F.abs(a - b) <= limit, F.lit(False))


def choose_average_monthly(
    candidates: DataFrame, submitted: DataFrame, key: str, value: str
) -> DataFrame:
    """Replace a submitted value by AVG/12 only when it is missing or equals another formula."""
    wide = candidates.groupBy(key).agg(
        F.max(F.when(F.col("formula") == "avg_metric_div_12", F.col("value"))).alias("_avg"),
        F.max(F.when(F.col("formula") == "sum_metric_div_12", F.col("value"))).alias("_o1"),
        F.max(F.when(F.col("formula") == "sum_metric_div_distinct_month", F.col("value"))).alias("_o2"),
        F.max(F.when(F.col("formula") == "avg_entity_annual_div_12", F.col("value"))).alias("_o3"),
    )
    v = F.col(value)
    other = _close(v, F.col("_o1")) | _close(v, F.col("_o2")) | _close(v, F.col("_o3"))
    repair = F.col("_avg").isNotNull() & ~_close(v, F.col("_avg")) & (v.isNull() | other)
    return submitted.join(wide, key).select(
        key, v.alias("submitted"), F.col("_avg").alias("candidate"), repair.alias("repaired"),
        F.when(repair, F.col("_avg")).otherwise(v).alias("final_value"),
    )


def filtered_join_average(
    fact: DataFrame, dim: DataFrame, on: Column, attribute: str, value: str, metric: str
) -> DataFrame:
    """Average over every row of the matched population, negative and zero values kept."""
    kept = dim.filter(F.lower(F.col(attribute)) == value.lower())
    return fact.join(kept, on).agg(F.avg(F.col(metric).try_cast("double")).alias("average"))


def count_related_entities(
    items: DataFrame, related: DataFrame, key: str, related_key: str, entity: Sequence[str]
) -> DataFrame:
    """Distinct filtered entities whose container occurs among the related records."""
    return items.join(
        related.select(F.col(related_key).alias(key)), key, "left_semi"
    ).agg(F.count_distinct(*entity).alias("entity_count"))


def top_text_in_range(
    texts: DataFrame, parents: DataFrame, on: Column, metric: str, low: float, high: float,
    score: str, tie: str, by: Sequence[str] = (),
) -> DataFrame:
    """The best-scored row whose parent lies in a range, ties by id; optionally per group."""
    kept = texts.join(parents.filter(F.col(metric).between(low, high)), on)
    order = [F.col(score).desc_nulls_last(), F.col(tie).asc_nulls_last()]
    if by:
        return first_per_group(kept, by, order).drop("rn")
    return kept.orderBy(*order).limit(1)


def rank_attached(df: DataFrame, rank: str, k: int) -> DataFrame:
    """Rows whose literal rank column equals ``k``; text such as '2.0' counts as 2."""
    return df.filter(to_number(F.col(rank).cast("string")).cast("bigint") == k)


def ranked_entity_reference(
    events: DataFrame, results: DataFrame, references: DataFrame,
    event_id: str, entity_id: str, position: str,
) -> DataFrame:
    """Each event's first-placed entity with its reference fields; lowest id on ties."""
    winners = (
        results.filter(F.col(position).try_cast("int") == 1)
        .groupBy(event_id).agg(F.min(entity_id).alias(entity_id))
    )
    return events.join(winners, event_id).join(references, entity_id)


def unit_ratio_first_seen(
    tx: DataFrame, period_fact: DataFrame, on: Column, price: str, amount: str,
    threshold: float, value: str, tx_id: str,
) -> DataFrame:
    """Distinct attached values of rows above a unit price, in order of first occurrence."""
    ratio = F.try_divide(F.col(price), F.col(amount))
    return (
        tx.filter((F.col(amount) != 0) & (ratio > threshold))
        .join(period_fact, on).groupBy(value).agg(F.min(tx_id).alias("first_id"))
        .orderBy("first_id", value)
    )


def is_truthy(c: Column) -> Column:
    return F.lower(F.trim(c.cast("string"))).isin(*R.TRUTHY)


def linked_total(
    entities: DataFrame, links: DataFrame, facts: DataFrame, entity_key: str, link_key: str,
    kind: str, label: str, amount: str, approved: str,
) -> DataFrame:
    """Approved linked amounts per entity with the entity's own type.

    Amounts are summed per link before the joins, so a hot entity ships one row per link.
    """
    per_link = (
        facts.filter(is_truthy(F.col(approved)))
        .withColumn("_a", to_number_commas(F.col(amount)))
        .filter(F.col("_a").isNotNull()).groupBy(link_key).agg(F.sum("_a").alias("_a"))
    )
    total = (
        per_link.join(links, link_key).groupBy(entity_key).agg(F.sum("_a").alias("_a"))
        .filter(F.round("_a", 6) != 0)
    )
    return total.join(entities, entity_key).select(
        F.col(label), F.col(kind),
        fixed2_of(F.round(F.col("_a"), 2), F.col("_a") < 0).alias("total_value"),
    )


def entity_by_name(
    sources: Sequence[tuple[str, DataFrame]], wanted: DataFrame, name: str
) -> DataFrame:
    """Find each wanted name in the first source that has it.

    A source is a frame whose columns follow one of the alias names for id, name and type.
    """
    frames = []
    for order, (source, df) in enumerate(sources):
        lower = {c.lower(): c for c in df.columns}

        def pick(kind: str, lower=lower) -> str | None:
            return next((lower[a] for a in R.ENTITY_ALIASES[kind] if a in lower), None)

        if not pick("name") or not pick("id"):
            continue
        kind = pick("type")
        frames.append(
            df.select(
                F.lower(F.trim(F.col(pick("name")))).alias("_name"),
                F.col(pick("id")).cast("string").alias("entity_id"),
                (F.col(kind).cast("string") if kind else F.lit("")).alias("entity_type"),
                F.lit(order).alias("_order"), F.lit(source).alias("source"),
            )
        )
    every = frames[0]
    for frame in frames[1:]:
        every = every.unionByName(frame)
    ask = wanted.select(name, F.lower(F.trim(F.col(name))).alias("_name")).distinct()
    return (
        every.join(ask, "_name").groupBy(name)
        .agg(F.min(F.struct("_order", "entity_id", "entity_type", "source")).alias("_x"))
        .select(name, "_x.entity_id", "_x.entity_type", "_x.source")
    )


def linked_ratio(df: DataFrame, by: Sequence[str], label: str, a: str, b: str, amount: str) -> DataFrame:
    """Amount attached to ``a`` over the amount attached to ``b``; NULL when ``b`` is 0 or absent."""
    def side(x: str) -> Column:
        return F.max(F.when(F.col(label) == x, F.col(amount)))

    return df.groupBy(*by).agg(side(a).alias("amount_a"), side(b).alias("amount_b")).withColumn(
        "ratio", F.try_divide(F.col("amount_a"), F.col("amount_b"))
    )


def percentage(df: DataFrame, in_population: Column, wanted: Column) -> DataFrame:
    """Explicit numerator and denominator; rows without the wanted id stay in the denominator."""
    keep = F.coalesce(in_population, F.lit(False))
    hit = keep & F.coalesce(wanted, F.lit(False))
    return df.agg(
        F.count_if(keep).alias("denominator"), F.count_if(hit).alias("numerator")
    ).withColumn("percentage", F.try_divide(F.col("numerator") * 100.0, F.col("denominator")))


def population_threshold_count(
    rows: DataFrame, population: DataFrame, entity: str, m1: str, m2: str, digits: int = 1
) -> DataFrame:
    """Entities of a population with ``m1`` inside its p05-p95 band and any ``m2``.

    The band comes from all rows, rounded to ``digits`` before use. Entities are reduced
    map-side to two flags before the population is applied.
    """
    def edge(q: float, name: str) -> Column:
        return F.round(F.max(F.when(F.col("q") == q, F.col("at"))), digits).alias(name)

    band = exact_quantiles(rows, [], m1, [0.05, 0.95]).agg(edge(0.05, "low"), edge(0.95, "high"))
    banded = rows.withColumn("_b", band.select(F.struct("low", "high")).scalar())
    flagged = banded.groupBy(entity, "_b").agg(
        F.max(F.col(m1).between(F.col("_b.low"), F.col("_b.high"))).alias("_in"),
        F.max(F.col(m2).isNotNull()).alias("_any"),
    )
    return (
        flagged.join(population.select(entity), entity, "left_semi")
        .groupBy("_b").agg(F.count_if(F.col("_in") & F.col("_any")).alias("entity_count"))
        .select("_b.low", "_b.high", "entity_count")
    )


def population_union(ids: DataFrame, docs: DataFrame, text: str, pattern: str, entity: str) -> DataFrame:
    """Ids from a table and ids mentioned in documents, each once."""
    mentioned = docs.select(
        F.explode(F.regexp_extract_all(F.col(text), F.lit(pattern), 1)).alias(entity)
    )
    return ids.select(F.col(entity).cast("string").alias(entity)).union(mentioned).distinct()


def _extract(c: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def question_parameters(df: DataFrame, question: str) -> DataFrame:
    """Years, months, ranks, ranges, names and ids found in question wording."""
    q = F.col(question)
    low = F.lower(q)
    month = F.coalesce(
        *[F.when(low.rlike(rf"\b{m}\b"), F.lit(i)) for i, m in enumerate(R.MONTHS, 1)],
        F.when(
            _extract(low, R.MONTH_NUMBER).try_cast("int").between(1, 12),
            _extract(low, R.MONTH_NUMBER).try_cast("int"),
        ),
    )
    rank = F.coalesce(
        *[F.when(low.rlike(rf"\b{w}\b"), F.lit(k)) for w, k in R.ORDINALS],
        _extract(low, R.RANKED_NUMBER).try_cast("int"),
    )
    return df.select(
        "*",
        F.array_join(
            F.transform(
                F.regexp_extract_all(q, F.lit(R.QUOTED), 0),
                lambda x: F.trim(F.regexp_replace(x, R.QUOTE_EDGES, "")),
            ),
            "|",
        ).alias("quoted_names"),
        _extract(q, R.YEAR).try_cast("bigint").alias("year"),
        month.cast("bigint").alias("month"),
        rank.cast("bigint").alias("rank"),
        _extract(low, R.BETWEEN, 1).try_cast("double").alias("range_low"),
        _extract(low, R.BETWEEN, 2).try_cast("double").alias("range_high"),
        F.coalesce(*[_extract(q, p) for p in R.PRODUCT_ID]).try_cast("bigint").alias("product_id"),
        F.coalesce(*[_extract(q, p) for p in R.UNIT_THRESHOLD]).try_cast("double").alias(
            "unit_threshold"
        ),
        F.trim(F.coalesce(*[_extract(q, p) for p in R.CATEGORY])).alias("category"),
        F.trim(_extract(q, R.PUBLISHED_BY)).alias("publisher"),
    )
