"""File catalogue and scans of CSV, JSON and text, plus the sinks."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from questloom.functions.values import trimmed

# What each suffix holds.
KINDS = {
    "csv": "csv", "json": "json", "md": "doc", "txt": "doc", "pdf": "pdf", "sqlite": "db",
    "db": "db", "sqlite3": "db", "db3": "db", "parquet": "table",
}


def kind_of(path: Column) -> Column:
    suffix = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    out = F.lit("unknown")
    for name, kind in KINDS.items():
        out = F.when(suffix == name, F.lit(kind)).otherwise(out)
    return out


def file_sizes(spark: SparkSession, root: str) -> DataFrame:
    """Path and size of every file below ``root``; the content is never read.

    A scan leaves out files without bytes, so the paths come from the list that Spark's
    file index holds on the driver anyway; the sizes come from the scan.
    """
    scan = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    jvm = spark.sparkContext._jvm
    paths = jvm.scala.collection.immutable.ArraySeq.unsafeWrapArray(scan._jdf.inputFiles())
    listed = DataFrame(spark._jsparkSession.createDataset(paths, jvm.org.apache.spark.sql.Encoders.STRING()).toDF(), spark)
    # The list holds encoded addresses, the scan plain paths.
    plain = F.url_decode(F.replace("value", F.lit("+"), F.lit("%2B")))
    one = lambda c: F.regexp_replace(c, "^([^:/]+):///", "$1:/")
    sizes = scan.select(one(F.col("path")).alias("path"), "length")
    return listed.select(one(plain).alias("path")).join(sizes, "path", "left").select(
        "path", F.coalesce("length", F.lit(0)).alias("size")
    )


def catalogue(spark: SparkSession, root: str, max_depth: int | None = None) -> DataFrame:
    """Files below ``root`` with relative path, kind and size, empty ones included."""
    files = file_sizes(spark, root)
    base = root.rstrip("/") + "/"
    rel = F.substring_index("path", base, -1)
    return (
        files.select(rel.alias("path"), "size")
        .withColumn("depth", F.size(F.split("path", "/")))
        .filter(F.lit(True) if max_depth is None else F.col("depth") <= max_depth)
        .withColumn("kind", kind_of(F.col("path")))
        .orderBy("path")
    )


def scan_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Typed CSV scan; malformed rows are dropped. Give the schema once it is known."""
    reader = spark.read.option("header", True).option("escape", '"').option("mode", "DROPMALFORMED")
    reader = reader.option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]")
    if schema:
        return reader.schema(schema).csv(path)
    return reader.option("inferSchema", True).option("preferDate", True).csv(path)


def rejected_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """How many rows a typed scan of ``path`` drops as malformed: one row, ``rejected``.

    Lines equal to the header are headers of part files.
    """
    options = {"mode": "PERMISSIVE", "escape": '"', "columnNameOfCorruptRecord": "_bad", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]"}
    head = spark.read.option("header", True).csv(path).columns
    lines = spark.read.text(path).filter(F.col("value") != F.lit(",".join(head)))
    parsed = F.from_csv("value", F.lit(f"{schema}, _bad string"), options)
    return lines.agg(F.count(parsed["_bad"]).alias("rejected"))


def scan_csv_text(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """All-text CSV scan; short rows are padded with ''.

    ``multi_line`` allows line breaks inside cells, at the price of one task per file.
    """
    raw = (
        spark.read.option("header", True).option("escape", '"').option("multiLine", multi_line)
        .option("mode", "PERMISSIVE").csv(path)
    )
    return raw.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in raw.columns])


# Quoted field names, and type words where a type stands: first, after a name, in a list.
_NAME = re.compile(r"(`(?:[^`]|``)*`)")
_TYPE = re.compile(r"(^|: |ARRAY<)(OBJECT|VOID|VARIANT)\b")


def _spark_type(m: re.Match) -> str:
    return m[1] + ("STRUCT" if m[2] == "OBJECT" else "STRING")


def json_schema(df: DataFrame, column: str) -> str:
    """The merged schema of a JSON text column, found by one mergeable aggregate.

    Only the schema text reaches the driver.
    """
    text = df.agg(F.schema_of_variant_agg(F.try_parse_json(F.col(column))).alias("s")).first()["s"]
    return "".join(p if i % 2 else _TYPE.sub(_spark_type, p) for i, p in enumerate(_NAME.split(text)))


def parse_json(df: DataFrame, column: str, schema: str | None = None, name: str = "doc") -> DataFrame:
    return df.withColumn(name, F.from_json(F.col(column), schema or json_schema(df, column)))


def flatten_structs(df: DataFrame, column: str) -> DataFrame:
    """Replace a struct column by its fields, nested structs included.

    A field name that is already taken gets the parent's name in front.
    """
    fields = df.schema[column].dataType.fields
    others = [c for c in df.columns if c != column]
    named = [(f.name, f.name if f.name not in others else f"{column}_{f.name}") for f in fields]
    out = df.select(*others, *[F.col(f"{column}.{n}").alias(a) for n, a in named])
    for f, (_, alias) in zip(fields, named):
        if f.dataType.typeName() == "struct":
            out = flatten_structs(out, alias)
    return out


def flatten_records(df: DataFrame, column: str, schema: str | None = None) -> DataFrame:
    """One row per item of the ``records`` array, structs unnested."""
    parsed = parse_json(df, column, schema, "_doc").drop(column)
    rows = parsed.withColumn("_rec", F.explode("_doc.records")).drop("_doc")
    return flatten_structs(rows, "_rec")


def record_items(c: Column) -> Column:
    """The object items of ``{"records": [...]}`` or of a top-level list; null for other texts."""
    wrapped = F.from_json(c, "struct<records:array<string>>")["records"]
    plain = F.when(F.trim(c).startswith("["), F.from_json(c, "array<string>"))
    return F.filter(F.coalesce(wrapped, plain), lambda x: F.trim(x).startswith("{"))


def normalise_records(df: DataFrame, column: str) -> DataFrame:
    """Object items of ``{"records": [...]}`` or of a top-level list, as JSON text."""
    return df.select(
        *[x for x in df.columns if x != column], F.posexplode(record_items(F.col(column))).alias("item_idx", "item")
    )


def paragraphs(df: DataFrame, text: str, gap: str = "\n\n", keep: Sequence[str] = ()) -> DataFrame:
    """Trimmed non-empty paragraphs with their index; no shuffle."""
    parts = F.filter(
        F.transform(F.split(F.col(text), gap), lambda p: trimmed(p)), lambda p: p != ""
    )
    return df.select(*keep, F.posexplode(parts).alias("paragraph_index", "paragraph"))


def write_answer_csv(df: DataFrame, folder: str, by: Sequence[str] = ()) -> None:
    # A quote inside a cell is doubled, as other CSV readers expect.
    writer = df.write.option("header", True).option("escape", '"').mode("overwrite")
    (writer.partitionBy(*by) if by else writer).csv(folder)


def write_jsonl(df: DataFrame, folder: str, by: Sequence[str] = ()) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).json(folder)


def write_evidence(df: DataFrame, folder: str) -> None:
    df.write.mode("overwrite").parquet(folder)
