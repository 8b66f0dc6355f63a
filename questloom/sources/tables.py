"""Named tables: safe view names and registration."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed value: longest view name.
MAX_NAME = 96
# Fixed value: longest name in front of a number.
MAX_BASE = 90


def safe_name_column(path: Column) -> Column:
    """View name of a relative path: suffix dropped, folders joined by ``__``."""
    stem = F.regexp_replace(F.regexp_replace(path, r"\.[^./]+$", ""), "/+", "__")
    name = F.lower(F.regexp_replace(F.regexp_replace(stem, r"(?U)\W+", "_"), "^_+|_+$", ""))
    name = F.when(name == "", F.lit("table")).otherwise(name)
    name = F.when(name.rlike(r"^\d"), F.concat(F.lit("t_"), name)).otherwise(name)
    return F.substring(name, 1, MAX_NAME)


def unique_names(df: DataFrame, path: str, by: Sequence[str] = ()) -> DataFrame:
    """Add ``view_name``: in path order, a taken name gets the first free ``_2``, ``_3``, …

    Names are unique within ``by`` (one context folder). Files of one base are numbered by a
    window, which is right as long as no other base already reads like such a numbered name.
    Only stems where two names then meet are settled file by file, in path order; a name
    that gets an ending is cut to ``MAX_BASE`` first.
    """
    files = df.withColumn("_base", safe_name_column(F.col(path))).withColumn(
        "_stem", F.substring(F.regexp_replace("_base", r"(?:_\d++)++$", ""), 1, MAX_BASE - 6)
    )
    nth = F.row_number().over(Window.partitionBy(*by, "_base").orderBy(path))
    numbered = F.concat(F.substring("_base", 1, MAX_BASE), F.lit("_"), F.col("_nth").cast("string"))
    files = files.withColumn("_nth", nth).withColumn("view_name", F.when(F.col("_nth") == 1, F.col("_base")).otherwise(numbered))
    clash = files.groupBy(*by, "_stem", "view_name").agg((F.count(F.lit(1)) > 1).alias("_clash"))
    stems = clash.filter("_clash").select(*by, "_stem").distinct()
    easy = files.join(stems, [*by, "_stem"], "left_anti").select(*df.columns, "view_name")
    hard = files.join(stems, [*by, "_stem"], "left_semi").select(*df.columns, "_base", "_stem")

    def give(taken: Column, item: Column) -> Column:
        used = F.transform(taken, lambda x: x["name"])
        tries = F.transform(
            F.sequence(F.lit(2), F.size(taken) + 2),
            lambda k: F.concat(F.substring(item["base"], 1, MAX_BASE), F.lit("_"), k.cast("string")),
        )
        free = F.filter(F.concat(F.array(item["base"]), tries), lambda x: ~F.array_contains(used, x))
        return F.concat(taken, F.array(F.struct(item["path"].alias("path"), free[0].alias("name"))))

    named = (
        hard.groupBy(*by, "_stem")
        .agg(F.array_sort(F.collect_list(F.struct(F.col(path).alias("path"), F.col("_base").alias("base")))).alias("_files"))
        .withColumn("_none", F.expr("cast(array() AS array<struct<path:string,name:string>>)"))
        .select(*by, F.explode(F.aggregate("_files", F.col("_none"), give)).alias("_f"))
        .select(*by, F.col("_f.path").alias(path), F.col("_f.name").alias("view_name"))
    )
    return easy.unionByName(hard.drop("_base", "_stem").join(named, [*by, path]).select(*easy.columns))


def register_namespace(base: str, tables: Mapping[str, DataFrame]) -> list[tuple[str, str]]:
    """Register each table as ``<base>_<table>``; returns ``(table, view)`` pairs."""
    if not tables:
        return []
    spark = next(iter(tables.values())).sparkSession
    names = spark.createDataFrame([(n, f"{base}_{n}") for n in tables], "table string, path string")
    views = {r["table"]: r["view_name"] for r in unique_names(names, "path").collect()}
    for name, df in tables.items():
        df.createOrReplaceTempView(views[name])
    return list(views.items())
