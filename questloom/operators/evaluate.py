"""Score answer tables against gold by column similarity.

Input is the long cell table ``(task_id, side, row_idx, col_idx, v)``; ``side`` is
``gold`` or ``pred``. Nothing is collected per column or task: value sets and pairs stay
rows, and columns that share only common values are matched by class.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from questloom.functions.values import fixed2_text, trimmed
from questloom.session import kept

# Fixed value: score lost per unmatched predicted column.
EXTRA_COLUMN_PENALTY = 0.05


def normal_cell(c: Column) -> Column:
    """Missing to '', numbers to two decimals, other text trimmed."""
    return F.when(c.isNull() | (c == ""), F.lit("")).otherwise(
        F.coalesce(fixed2_text(c), trimmed(c))
    )


def value_sets(cells: DataFrame, headers: DataFrame | None = None) -> DataFrame:
    """Distinct normal values per column, as rows.

    ``headers`` is ``(task_id, side, col_idx, v)``; when given, each header text joins
    its column's set.
    """
    rows = cells.select("task_id", "side", "col_idx", "v")
    if headers is not None:
        rows = rows.unionByName(headers.select("task_id", "side", "col_idx", "v"))
    return rows.select("task_id", "side", "col_idx", normal_cell(F.col("v")).alias("v")).distinct()


def column_sizes(values: DataFrame) -> DataFrame:
    return values.groupBy("task_id", "side", "col_idx").agg(F.count(F.lit(1)).alias("n"))


def jaccard_pairs(values: DataFrame, columns: DataFrame | None = None) -> DataFrame:
    """Similarity of every gold and predicted column that share a value.

    Values held by the same columns are counted together first, so a pair gets one mark per
    such group and not one per value. To match columns only, ``match_columns`` makes far
    fewer pairs. Columns of ``columns`` (task_id, side, col_idx) without any value are alike
    when both are empty.
    """
    def side(name: str) -> Column:
        return F.sort_array(F.collect_set(F.when(F.col("side") == name, F.col("col_idx"))))

    holders = values.groupBy("task_id", "v").agg(side("gold").alias("gs"), side("pred").alias("ps"))
    groups = holders.filter((F.size("gs") > 0) & (F.size("ps") > 0)).groupBy("task_id", "gs", "ps").agg(F.count(F.lit(1)).alias("n"))
    shared = (
        groups.select("task_id", "ps", "n", F.explode("gs").alias("g")).select("task_id", "g", F.explode("ps").alias("p"), "n")
        .groupBy("task_id", "g", "p").agg(F.sum("n").alias("shared"))
    )
    sizes = column_sizes(values)
    out = shared.join(_sized(sizes, "gold", "g"), ["task_id", "g"]).join(_sized(sizes, "pred", "p"), ["task_id", "p"])
    if columns is not None:
        empty = columns.select("task_id", "side", "col_idx").distinct().join(
            sizes, ["task_id", "side", "col_idx"], "left_anti"
        )
        eg = empty.filter(F.col("side") == "gold").select("task_id", F.col("col_idx").alias("g"))
        ep = empty.filter(F.col("side") == "pred").select("task_id", F.col("col_idx").alias("p"))
        zero = F.lit(0).cast("bigint")
        both = eg.join(ep, "task_id").select(
            "task_id", "g", "p", zero.alias("shared"), zero.alias("n_g"), zero.alias("n_p")
        )
        out = out.unionByName(both)
    total = F.col("n_g") + F.col("n_p") - F.col("shared")
    return out.select(
        "task_id", "g", "p", "shared", total.alias("total"),
        F.coalesce(F.try_divide(F.col("shared"), total), F.lit(1.0)).alias("similarity"),
    )


def _sized(sizes: DataFrame, side: str, name: str) -> DataFrame:
    return sizes.filter(F.col("side") == side).select("task_id", F.col("col_idx").alias(name), F.col("n").alias(f"n_{name}"))


def _best_first(similarity: Column | None = None) -> Column:
    """The order of the greedy choice: falling similarity, then gold, then predicted column."""
    s = F.col("similarity") if similarity is None else similarity
    return F.struct((-s).alias("s"), F.col("g").alias("g"), F.col("p").alias("p"))


def greedy_match(pairs: DataFrame, rounds: int = 2) -> DataFrame:
    """One-to-one matches by falling similarity, ties by gold then predicted column.

    A pair that is the best of both its columns is always chosen. Such pairs are taken and
    the other pairs of their columns dropped, ``rounds`` times in one job, until none is open.
    """
    over_g, over_p = Window.partitionBy("task_id", "g"), Window.partitionBy("task_id", "p")
    state = pairs.select("task_id", "g", "p", "similarity", F.lit(False).alias("taken"))
    while True:
        for _ in range(max(1, rounds)):
            best = F.when(~F.col("taken"), _best_first())
            state = state.withColumn("_g", F.min(best).over(over_g)).withColumn("_p", F.min(best).over(over_p))
            sure = F.coalesce((F.col("_g") == _best_first()) & (F.col("_p") == _best_first()), F.lit(False))
            state = state.withColumn("taken", F.col("taken") | sure)
            state = state.withColumn("_g", F.max("taken").over(over_g)).withColumn("_p", F.max("taken").over(over_p))
            state = state.filter(F.col("taken") | ~(F.col("_g") | F.col("_p"))).select("task_id", "g", "p", "similarity", "taken")
        state = kept(state, "matches")
        if state.filter(~F.col("taken")).isEmpty():
            return state.select("task_id", "g", "p", "similarity")


def match_columns(values: DataFrame, wide: int = 16) -> DataFrame:
    """``greedy_match(jaccard_pairs(values))`` without making all pairs.

    A value is common if the pairs that hold it outnumber its holders ``wide`` times. Pairs
    that share another value are made as they are, at most ``wide`` per cell. The rest of a
    column's likeness depends only on its size and on which common values it holds, its
    class: for classes, not columns, the common values are counted. Inside a pair of classes
    the greedy choice goes by size, so open columns are paired rank by rank as long as no
    other class and no made pair suits one of them better.
    """
    over_v = Window.partitionBy("task_id", "v")
    on_gold = F.col("side") == "gold"
    held = values.withColumn("_g", F.count_if(on_gold).over(over_v)).withColumn("_p", F.count_if(~on_gold).over(over_v))
    held = held.filter((F.col("_g") > 0) & (F.col("_p") > 0))
    common = F.col("_g") * F.col("_p") > wide * (F.col("_g") + F.col("_p"))

    def holders(side: str, name: str, rows: DataFrame) -> DataFrame:
        return rows.filter(F.col("side") == side).select("task_id", "v", F.col("col_idx").alias(name))

    rare = held.filter(~common)
    made = holders("gold", "g", rare).join(holders("pred", "p", rare), ["task_id", "v"]).groupBy("task_id", "g", "p").agg(
        F.count(F.lit(1)).alias("shared")
    )
    sizes = column_sizes(values)
    often = held.filter(common).select("task_id", "side", "col_idx", "v")
    if often.isEmpty():
        union = F.col("n_g") + F.col("n_p") - F.col("shared")
        alone = made.join(_sized(sizes, "gold", "g"), ["task_id", "g"]).join(_sized(sizes, "pred", "p"), ["task_id", "p"])
        return greedy_match(alone.select("task_id", "g", "p", (F.col("shared") / union).alias("similarity")))
    # A class is named by its least column; two hashes and a count tell value sets apart.
    often = kept(often, "common-values")
    marks = often.groupBy("task_id", "side", "col_idx").agg(
        F.bit_xor(F.xxhash64("v")).alias("_a"), F.bit_xor(F.xxhash64(F.lit(1), "v")).alias("_b"), F.count(F.lit(1)).alias("_n")
    )
    of_class = marks.select("task_id", "side", "col_idx", F.min("col_idx").over(Window.partitionBy("task_id", "side", "_a", "_b", "_n")).alias("cls"))
    columns = kept(sizes.join(of_class, ["task_id", "side", "col_idx"], "left"), "columns")
    named = columns.filter(F.col("cls") == F.col("col_idx")).select("task_id", "side", "col_idx")
    heads = often.join(named, ["task_id", "side", "col_idx"])
    classes = kept(
        holders("gold", "cg", heads).join(holders("pred", "cp", heads), ["task_id", "v"]).groupBy("task_id", "cg", "cp").agg(F.count(F.lit(1)).alias("both")),
        "classes",
    )
    gold = columns.filter(on_gold).select("task_id", F.col("col_idx").alias("g"), F.col("n").alias("n_g"), F.col("cls").alias("cg"))
    pred = columns.filter(~on_gold).select("task_id", F.col("col_idx").alias("p"), F.col("n").alias("n_p"), F.col("cls").alias("cp"))
    shared = F.col("shared") + F.coalesce("both", F.lit(0))
    pairs = kept(
        made.join(gold, ["task_id", "g"]).join(pred, ["task_id", "p"]).join(classes, ["task_id", "cg", "cp"], "left")
        .select("task_id", "g", "p", (shared / (F.col("n_g") + F.col("n_p") - shared)).alias("similarity")),
        "made-pairs",
    )
    done = kept(_sure_pairs(pairs, gold, pred, classes), "sure-pairs")
    more = done
    while not more.isEmpty():
        # Only what is taken is written; what is open follows from it.
        g_gone, p_gone = done.select("task_id", "g"), done.select("task_id", "p")
        more = kept(
            _sure_pairs(
                pairs.join(g_gone, ["task_id", "g"], "left_anti").join(p_gone, ["task_id", "p"], "left_anti"),
                gold.join(g_gone, ["task_id", "g"], "left_anti"), pred.join(p_gone, ["task_id", "p"], "left_anti"), classes,
            ),
            "sure-pairs",
        )
        done = done.unionByName(more)
    return done


def _sure_pairs(pairs: DataFrame, gold: DataFrame, pred: DataFrame, classes: DataFrame) -> DataFrame:
    """Open pairs that the greedy choice is bound to take, by class and by made pair."""
    by_size = F.row_number().over(Window.partitionBy("task_id", "cg").orderBy("n_g", "g"))
    g_ranked = gold.filter(F.col("cg").isNotNull()).withColumn("rank", by_size)
    by_size = F.row_number().over(Window.partitionBy("task_id", "cp").orderBy("n_p", "p"))
    p_ranked = pred.filter(F.col("cp").isNotNull()).withColumn("rank", by_size)
    alike = (F.col("both") / (F.col("n_g") + F.col("n_p") - F.col("both"))).alias("similarity")
    g_top, p_top = (x.filter("rank = 1").drop("rank") for x in (g_ranked, p_ranked))
    # What every open column finds best in each class: the class's first open column.
    g_finds = g_ranked.join(classes, ["task_id", "cg"]).join(p_top, ["task_id", "cp"]).select("task_id", "cg", "cp", "g", "p", alike)
    p_finds = p_ranked.join(classes, ["task_id", "cp"]).join(g_top, ["task_id", "cg"]).select("task_id", "cg", "cp", "g", "p", alike)
    tops = g_top.join(classes, ["task_id", "cg"]).join(p_top, ["task_id", "cp"]).select("task_id", "cg", "cp", "both", _best_first(alike).alias("k"))
    mutual = (
        tops.withColumn("_g", F.min("k").over(Window.partitionBy("task_id", "cg"))).withColumn("_p", F.min("k").over(Window.partitionBy("task_id", "cp")))
        .filter((F.col("k") == F.col("_g")) & (F.col("k") == F.col("_p"))).select("task_id", "cg", "cp", "both")
    )
    chosen_g, chosen_p = mutual.select("task_id", "cg", F.col("cp").alias("_to")), mutual.select("task_id", "cp", F.col("cg").alias("_to"))

    def rivals(finds: DataFrame, chosen: DataFrame, cls: str, other: str, col: str) -> DataFrame:
        """A column's best made pair, best class and best class but the chosen one."""
        made = pairs.select("task_id", col, F.lit(True).alias("_made"), F.lit(True).alias("_else"), _best_first().alias("k"))
        found = finds.join(chosen, ["task_id", cls], "left").select(
            "task_id", col, F.lit(False).alias("_made"), ~F.col(other).eqNullSafe(F.col("_to")), _best_first().alias("k")
        )
        return made.union(found).groupBy("task_id", col).agg(
            F.min("k").alias(f"all_{col}"), F.min(F.when(F.col("_else"), F.col("k"))).alias(f"else_{col}")
        )

    of_g, of_p = rivals(g_finds, chosen_g, "cg", "cp", "g"), rivals(p_finds, chosen_p, "cp", "cg", "p")
    key = _best_first()
    best_made = pairs.join(of_g, ["task_id", "g"]).join(of_p, ["task_id", "p"]).filter(
        (F.col("all_g") == key) & (F.col("all_p") == key)
    )
    zipped = (
        g_ranked.join(mutual, ["task_id", "cg"]).join(p_ranked, ["task_id", "cp", "rank"])
        .select("task_id", "cg", "cp", "rank", "g", "p", alike).join(of_g, ["task_id", "g"], "left").join(of_p, ["task_id", "p"], "left")
    )
    none = F.lit(True)
    sure = F.coalesce(key < F.col("else_g"), none) & F.coalesce(key < F.col("else_p"), none)
    failed = F.min(F.when(~sure, F.col("rank"))).over(Window.partitionBy("task_id", "cg", "cp"))
    zipped = zipped.withColumn("_failed", failed).filter(F.col("_failed").isNull() | (F.col("rank") < F.col("_failed")))
    out = ["task_id", "g", "p", "similarity"]
    return best_made.select(*out).unionByName(zipped.select(*out))


def scores(
    matches: DataFrame, columns: DataFrame, penalty: float = EXTRA_COLUMN_PENALTY
) -> DataFrame:
    """Score per gold task; ``columns`` is ``(task_id, side, col_idx)`` without duplicates."""
    counts = columns.groupBy("task_id").agg(
        F.count_if(F.col("side") == "gold").alias("gold_columns"),
        F.count_if(F.col("side") == "pred").alias("pred_columns"),
    )
    matched = matches.groupBy("task_id").agg(
        F.count(F.lit(1)).alias("m"), F.avg("similarity").alias("mean_similarity")
    )
    m = F.coalesce("m", F.lit(0))
    base = F.try_divide(m, F.col("gold_columns")) - (F.col("pred_columns") - m) * penalty
    score = (
        F.when(
            F.col("gold_columns") == 0,
            F.when(F.col("pred_columns") == 0, F.lit(1.0)).otherwise(F.lit(0.0)),
        )
        .when(F.col("pred_columns") == 0, F.lit(0.0))
        .otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), base)))
    )
    return counts.join(matched, "task_id", "left").select(
        "task_id", "gold_columns", "pred_columns", m.alias("matched_columns"),
        (F.col("pred_columns") - m).alias("redundant_columns"),
        (F.col("gold_columns") - m).alias("missing_columns"),
        F.coalesce("mean_similarity", F.lit(0.0)).alias("mean_similarity"), score.alias("score"),
    )


def composites(values: DataFrame, cells: DataFrame, scored: DataFrame) -> DataFrame:
    """Column-agnostic value overlap, row-count match and the weighted composite.

    Only tasks with a prediction have these figures.
    """
    flat = values.groupBy("task_id", "v").agg(
        F.max(F.col("side") == "gold").alias("in_gold"),
        F.max(F.col("side") == "pred").alias("in_pred"),
    )
    overlap = flat.groupBy("task_id").agg(
        F.count_if("in_gold").alias("gold_values"),
        F.count_if(F.col("in_gold") & F.col("in_pred")).alias("shared_values"),
    )
    rows = (
        cells.select("task_id", "side", "row_idx").distinct().groupBy("task_id")
        .agg(
            F.count_if(F.col("side") == "gold").alias("gold_rows"),
            F.count_if(F.col("side") == "pred").alias("pred_rows"),
        )
    )
    share = F.coalesce(F.try_divide(F.col("shared_values"), F.col("gold_values")), F.lit(0.0))
    gap = F.abs(F.col("gold_rows") - F.col("pred_rows")) / F.greatest(F.col("gold_rows"), F.lit(1))
    match = F.lit(1.0) - F.least(gap, F.lit(1.0))
    return (
        scored.filter(F.col("pred_columns") > 0).join(overlap, "task_id").join(rows, "task_id")
        .select(
            "task_id", F.round(share, 4).alias("value_overlap"), "gold_rows", "pred_rows",
            F.round(match, 4).alias("row_match"),
            F.round(F.col("score") * 0.4 + share * 0.3 + match * 0.3, 4).alias("composite"),
        )
    )


def summary(
    scored: DataFrame, tasks: DataFrame, excluded: DataFrame | None = None,
    only_existing: bool = False, fail_below: float = 0.5,
) -> DataFrame:
    """Task count, mean score and failures per difficulty and over all tasks (NULL)."""
    rows = scored.join(tasks.select("task_id", "difficulty"), "task_id")
    if excluded is not None:
        rows = rows.join(excluded.select("task_id"), "task_id", "left_anti")
    if only_existing:
        rows = rows.filter(F.col("pred_columns") > 0)
    return rows.rollup("difficulty").agg(
        F.count(F.lit(1)).alias("tasks"), F.avg("score").alias("mean_score"),
        F.count_if(F.col("score") < fail_below).alias("failures"),
    )


def distinct_columns(cells: DataFrame) -> DataFrame:
    return cells.select("task_id", "side", "col_idx").distinct()
