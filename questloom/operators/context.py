"""One profile over every source of a context: CSV files, JSON, documents, pages, tables.

Each kind of source is turned into *cells*, rows of ``(path, type, ordinal, column, value)``
with the value as text. All that follows - column states, type votes, hints - is the same
aggregate for every kind, and one job serves any number of files.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField

from questloom.functions.values import SPACES, number_of, to_number, trimmed
from questloom.operators import profile as P
from questloom.sources.files import record_items
from questloom.sources.tables import safe_name_column

CELL = ("path", "type", "ordinal", "column", "value")

# Spellings of a date, tried in this order, and how each becomes year-month-day.
DATE_FORMS = (
    ("iso", r"^(\d{4}-\d{1,2}-\d{1,2}(?:[ T]\d{1,2}:\d{1,2}(?::\d{1,2}(?:\.\d{1,6})?)?)?)$", "$1"),
    ("month/day", r"^(\d{1,2})/(\d{1,2})/(\d{4})((?: \d{1,2}:\d{2}(?::\d{2})?)?)$", "$3-$1-$2$4"),
    ("day/month", r"^(\d{1,2})/(\d{1,2})/(\d{4})((?: \d{1,2}:\d{2}(?::\d{2})?)?)$", "$3-$2-$1$4"),
    ("day.month", r"^(\d{1,2})\.(\d{1,2})\.(\d{4})((?: \d{1,2}:\d{2}(?::\d{2})?)?)$", "$3-$2-$1$4"),
)
WHOLE = r"^[+-]?\d{1,19}$"
DECIMAL = r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?$"


# CSV --------------------------------------------------------------------------

def source_path(file: Column, root: str) -> Column:
    """Path of a file below ``root``; the part files of one written folder are one source."""
    rel = F.substring_index(F.url_decode(F.replace(file, F.lit("+"), F.lit("%2B"))), root.rstrip("/") + "/", -1)
    return F.regexp_replace(rel, r"/part-[^/]*$", "")


def csv_lines(spark: SparkSession, root: str, glob: str = "*.csv") -> tuple[DataFrame, DataFrame]:
    """``(files, body)`` of all CSV files below ``root`` in one scan each.

    ``files`` has ``_file, path, head``, one row per file with the header of its source; ``body``
    has ``_file, line``, so the path is made once per file, not per line. The header of a file
    is the first line of its first split, so files stay splittable. A cell may not hold a line
    break; a byte order mark is dropped.
    """
    lines = (
        spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(root)
        .select(F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"), F.col("value").alias("line"))
    )
    at = F.monotonically_increasing_id()
    first = lines.withColumn("_at", at).filter(F.col("_start") == 0).groupBy("_file").agg(F.min_by("line", "_at").alias("head"))
    files = first.select("_file", source_path(F.col("_file"), root).alias("path"), F.regexp_replace("head", "^\ufeff", "").alias("head"))
    head = F.min("head").over(Window.partitionBy("path"))
    return files.withColumn("head", head), lines.select("_file", "line")


def _split_csv(c: Column, width: int) -> Column:
    """The cells of a CSV line; empty and missing ones are null, those past ``width`` are not read."""
    row = _csv_row(c, width)
    return F.array(*[row[f"c{i}"] for i in range(width)])


def _csv_row(c: Column, width: int) -> Column:
    schema = ", ".join(f"c{i} string" for i in range(width))
    return F.from_csv(c, F.lit(schema), {"mode": "PERMISSIVE", "escape": '"'})


def _split_lines(rows: DataFrame, width: int) -> DataFrame:
    """``rows`` with ``_cells``, the cells of ``line``: only lines with a quote need a CSV parser, each once."""
    line = F.col("line")
    plain = ~line.contains('"') & ~line.contains("\x00") & (F.ltrim(line) != "")
    parsed = F.array(*[F.col(f"_row.c{i}") for i in range(width)])
    return rows.withColumn("_row", F.when(~plain, _csv_row(line, width))).withColumn(
        "_cells", F.when(plain, F.split(line, ",", -1)).otherwise(parsed)
    ).drop("_row")


#: Headers up to this many characters in all are sent to every task; more are joined.
SMALL_HEADERS = 8_000_000


def _headed(files: DataFrame, body: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """``(heads, rows, width)``: headers with their names, lines that are no header, widest header.

    The driver sees two numbers. Headers of a proven size go to the lines; beyond it both are
    shuffled by file and hot files are left to the skew join.
    """
    commas = F.length("head") - F.length(F.replace("head", F.lit(","), F.lit("")))
    most, size = files.agg(F.max(commas), F.sum(F.length("head") + F.length("path") + F.length("_file"))).first()
    width = (most or 0) + 1
    named = F.transform(F.filter(_split_csv(F.col("head"), width), lambda x: x.isNotNull()), trimmed)
    heads = files.select("_file", "path", "head", named.alias("names"))
    side = F.broadcast(heads) if (size or 0) <= SMALL_HEADERS else heads
    rows = body.join(side, "_file").filter((F.col("line") != F.col("head")) & (F.col("line") != "")).drop("_file")
    return heads.select("path", "head", "names").distinct(), rows, width


def csv_cells(spark: SparkSession, root: str, glob: str = "*.csv") -> DataFrame:
    """Cells of every CSV file below ``root``, each under the header of its own source.

    Lines equal to the header are headers of further part files and hold no cells; cells that
    a short line lacks are null, cells past the header are dropped. A header without lines
    gives no cells.
    """
    _, rows, width = _headed(*csv_lines(spark, root, glob))
    cells = F.arrays_zip(F.col("names").alias("name"), F.slice("_cells", F.lit(1), F.size("names")).alias("value"))
    return _split_lines(rows, width).select("path", F.posexplode(cells).alias("ordinal", "_c")).select(
        "path", F.lit("csv").alias("type"), "ordinal", F.col("_c.name").alias("column"),
        F.when(F.col("_c.value") != "", F.col("_c.value")).alias("value"),
    )


# Other sources ----------------------------------------------------------------

def table_cells(name: str, df: DataFrame) -> DataFrame:
    """Cells of a table; arrays, maps and structs as JSON text."""
    return _cells(name, df, list(enumerate(df.schema.fields)))


def _cells(name: str, df: DataFrame, fields: Sequence[tuple[int, StructField]]) -> DataFrame:
    def text(f: StructField) -> Column:
        c = F.col(f"`{f.name}`")
        return F.to_json(c) if f.dataType.typeName() in ("array", "map", "struct") else c.cast("string")

    cells = F.array(*[
        F.struct(F.lit(i).alias("ordinal"), F.lit(f.name).alias("column"), text(f).alias("value")) for i, f in fields
    ])
    return df.select(F.lit(name).alias("path"), F.lit("table").alias("type"), F.inline(cells))


# Types of few bytes, whose values are counted before they become text.
SHORT_TYPES = {t: "long" for t in ("byte", "short", "integer", "long")} | {
    t: t for t in ("float", "double", "boolean", "date", "timestamp", "timestamp_ntz")
}


def table_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """The cells of tables as ``table_cells`` gives them, equal short values once with their number ``n``.

    Values of one type are counted together over all tables, as what they are, so a number or
    a date becomes text once for each distinct value. Texts and nested values are cells as they stand.
    """
    kinds: dict[str, list[tuple[str, int, str]]] = {}
    rows: dict[str, list[DataFrame]] = {}
    parts = []
    for name, df in tables.items():
        fields = list(enumerate(df.schema.fields))
        for kind in sorted(set(SHORT_TYPES.values())):
            own = [(i, f) for i, f in fields if SHORT_TYPES.get(f.dataType.typeName()) == kind]
            if not own:
                continue
            known = kinds.setdefault(kind, [])
            cells = F.array(*[_short(len(known) + k, F.col(f"`{f.name}`").cast(kind), kind) for k, (_, f) in enumerate(own)])
            known += [(name, i, f.name) for i, f in own]
            rows.setdefault(kind, []).append(df.select(F.inline(cells)))
        if rest := [(i, f) for i, f in fields if f.dataType.typeName() not in SHORT_TYPES]:
            parts.append(_cells(name, df, rest).withColumn("n", F.lit(1).cast("bigint")))
    for kind, known in kinds.items():
        counts = reduce(DataFrame.union, rows[kind]).groupBy("_at", "_v", "_minus").agg(F.count(F.lit(1)).alias("n"))
        names = F.array(*[F.struct(F.lit(a).alias("path"), F.lit(b).alias("ordinal"), F.lit(c).alias("column")) for a, b, c in known])
        text = F.when(F.col("_minus"), F.lit("-0.0")).otherwise(F.col("_v").cast("string"))
        parts.append(counts.withColumn("_c", F.get(names, F.col("_at"))).select("_c.path", F.lit("table").alias("type"), "_c.ordinal", "_c.column", text.alias("value"), "n"))
    return reduce(DataFrame.unionByName, parts)


def _short(at: int, c: Column, kind: str) -> Column:
    """A short value with its column's place; grouping takes both zeros of a float as one, their texts differ."""
    minus = F.when(c == 0, c.cast("string") == "-0.0") if kind in ("float", "double") else F.lit(None).cast("boolean")
    return F.struct(F.lit(at).alias("_at"), c.alias("_v"), minus.alias("_minus"))


def json_cells(df: DataFrame, path: str, text: str) -> DataFrame:
    """Cells of JSON documents: the keys of their records, else those of the object itself.

    ``ordinal`` is the place of the key in its object, so keys are told apart by name.
    """
    c = F.col(text)
    records = record_items(c)
    plain = c.rlike(r"^\s*\{") & ~F.coalesce(F.get_json_object(c, "$.records").startswith("["), F.lit(False))
    items = F.coalesce(records, F.when(plain, F.array(c)))
    items = df.select(F.col(path).alias("path"), F.explode(items).alias("item"))
    entries = F.map_entries(F.from_json("item", "map<string,string>"))
    return items.select("path", F.posexplode(entries).alias("ordinal", "_e")).select(
        "path", F.lit("json").alias("type"), "ordinal", F.col("_e.key").alias("column"), F.col("_e.value").alias("value")
    )


def document_cells(df: DataFrame, path: str, text: str, kind: str = "doc") -> DataFrame:
    """A document or a page is one cell of the column ``text``."""
    return df.select(
        F.col(path).cast("string").alias("path"), F.lit(kind).alias("type"), F.lit(0).alias("ordinal"),
        F.lit("text").alias("column"), F.col(text).alias("value"),
    )


def all_cells(parts: Sequence[DataFrame]) -> DataFrame:
    """All cells, each with the number ``n`` of times it stands for."""
    one = F.lit(1).cast("bigint").alias("n")
    return reduce(DataFrame.unionByName, [p.select(*CELL, "n" if "n" in p.columns else one) for p in parts])


# Column states ----------------------------------------------------------------

def column_states(cells: DataFrame, exact: bool = True) -> DataFrame:
    """One row per source and column, the same fields for every kind of source.

    ``rows`` cells, ``missing`` (null or blank), ``distinct_count``, ``numeric_count`` with
    ``lo`` and ``hi`` of the cells that read as numbers, ``common`` the most frequent value
    (ties: the least) where not all values are numbers, ``is_key`` if no value is missing or
    repeated, ``constant`` if there is one value.

    ``exact`` counts equal values first - map side, so a value in most rows travels once per
    task - and derives every state from the counts, whatever the length of a value. Otherwise
    distinct values come from a sketch that merges in one small shuffle, ``common`` is null and
    ``is_key`` is null.
    """
    key = ["path", "type", "column"]
    n = F.col("n") if "n" in cells.columns else F.lit(1)
    value = F.when(F.ltrim(F.col("value"), F.lit(SPACES)) != "", F.col("value"))
    if exact:
        counts = (
            cells.select(*key, "ordinal", n.alias("_n"), value.alias("_v"))
            .groupBy(*key, "_v").agg(F.sum("_n").alias("_n"), F.min("ordinal").alias("ordinal"))
        )
        there = F.col("_v").isNotNull()
        # A text that begins like no number is not trimmed: that takes an array as long as the text.
        starts = F.substring(F.ltrim("_v", F.lit(SPACES)), 1, 1).isin(*"+-.0123456789")
        counts = counts.withColumn("_t", F.when(starts, trimmed(F.col("_v")))).withColumn("_x", number_of(F.col("_t")))
        states = counts.groupBy(*key).agg(
            F.min("ordinal").alias("ordinal"), F.sum("_n").alias("rows"),
            F.coalesce(F.sum(F.when(~there, F.col("_n"))), F.lit(0)).alias("missing"),
            F.count("_v").alias("distinct_count"),
            F.coalesce(F.sum(F.when(F.col("_x").isNotNull(), F.col("_n"))), F.lit(0)).alias("numeric_count"),
            F.min("_x").alias("lo"), F.max("_x").alias("hi"),
            F.min(F.when(there, F.struct((-F.col("_n")).alias("n"), F.col("_v").alias("v")))).alias("_c"),
        )
        common = F.col("_c.v")
    else:
        number = to_number(value)
        states = cells.groupBy(*key).agg(
            F.min("ordinal").alias("ordinal"), F.sum(n).alias("rows"), F.coalesce(F.sum(F.when(value.isNull(), n)), F.lit(0)).alias("missing"),
            F.approx_count_distinct(value).alias("distinct_count"), F.coalesce(F.sum(F.when(number.isNotNull(), n)), F.lit(0)).alias("numeric_count"),
            F.min(number).alias("lo"), F.max(number).alias("hi"),
        )
        common = F.lit(None).cast("string")
    numbers_only = F.col("numeric_count") == F.col("rows") - F.col("missing")
    unique = (F.col("missing") == 0) & (F.col("distinct_count") == F.col("rows"))
    return states.select(
        *key, "ordinal", "rows", "missing", "distinct_count", "numeric_count", F.round("lo", 4).alias("lo"), F.round("hi", 4).alias("hi"),
        F.when(~numbers_only, common).alias("common"),
        (unique if exact else F.lit(None).cast("boolean")).alias("is_key"),
        (F.col("distinct_count") == 1).alias("constant"),
    )


# Types ------------------------------------------------------------------------

def _as_moment(text: Column, pattern: str, to: str) -> Column:
    return F.when(text.rlike(pattern), F.regexp_replace(text, pattern, to).try_cast("timestamp_ntz"))


def type_votes(cells: DataFrame, share: float = 1.0) -> DataFrame:
    """The type of each column by a vote of all its cells: ``path, column, ordinal, type_name, form, misfits``.

    Blank cells do not vote. The first of bigint, double, boolean and the spellings of a date
    that reads at least ``share`` of the cells wins; a date column without a time of day is a
    ``date``. What no type reads is a string. ``misfits`` counts the cells that the winner
    does not read; a typed scan turns them into nulls.
    """
    v = trimmed(F.col("value"))
    there = F.when(v != "", v)
    moments = [_as_moment(there, p, to) for _, p, to in DATE_FORMS]
    votes = cells.groupBy("path", "column").agg(
        F.min("ordinal").alias("ordinal"), F.count(there).alias("_n"),
        F.count(F.when(there.rlike(WHOLE), there.try_cast("bigint"))).alias("v_bigint"),
        F.count_if(there.rlike(DECIMAL)).alias("v_double"),
        F.count_if(F.lower(there).isin("true", "false")).alias("v_boolean"),
        *[F.count(m).alias(f"v_{i}") for i, m in enumerate(moments)],
        F.count_if(there.rlike(r"\d:\d")).alias("_timed"),
    )
    options = [("bigint", "", "v_bigint"), ("double", "", "v_double"), ("boolean", "", "v_boolean")]
    options += [("", name, f"v_{i}") for i, (name, _, _) in enumerate(DATE_FORMS)]
    moment = F.when(F.col("_timed") > 0, F.lit("timestamp_ntz")).otherwise(F.lit("date"))
    choices = F.array(*[
        F.struct((F.lit(kind) if kind else moment).alias("type_name"), F.lit(form).alias("form"), F.col(n).alias("n"))
        for kind, form, n in options
    ])
    fits = F.filter(choices, lambda x: (F.col("_n") > 0) & (x["n"] >= F.lit(share) * F.col("_n")))
    best = F.coalesce(F.get(fits, F.lit(0)), F.struct(F.lit("string").alias("type_name"), F.lit("").alias("form"), F.col("_n").alias("n")))
    return votes.withColumn("_b", best).select(
        "path", "column", "ordinal", "_b.type_name", "_b.form", (F.col("_n") - F.col("_b.n")).alias("misfits")
    )


def read_typed(df: DataFrame, types: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Cast text columns to ``(column, type_name, form)`` as voted; blanks become nulls in typed columns."""
    forms = {name: (p, to) for name, p, to in DATE_FORMS}

    def typed(name: str, kind: str, form: str) -> Column:
        c = F.col(f"`{name}`")
        if kind == "string":
            return c.alias(name)
        text = trimmed(c)
        text = F.when(text != "", text)
        value = _as_moment(text, *forms[form]) if form else text
        return value.try_cast(kind).alias(name)

    return df.select(*[typed(*t) for t in types])


def scan_csv_voted(spark: SparkSession, path: str, share: float = 1.0) -> DataFrame:
    """One CSV source with the types that all its cells vote for, dates of any known spelling.

    Two scans: the vote, which brings one row per column to the driver, and the typed read.
    """
    raw = spark.read.option("header", True).option("escape", '"').option("mode", "PERMISSIVE").csv(path)
    text = raw.toDF(*[c.strip() for c in raw.columns])
    votes = type_votes(table_cells("csv", text), share)
    types = {r["column"]: (r["type_name"], r["form"]) for r in votes.collect()}
    return read_typed(text, [(c, *types.get(c, ("string", ""))) for c in text.columns])


# Sources ----------------------------------------------------------------------

def json_sources(df: DataFrame, path: str, text: str) -> DataFrame:
    """``path, type, view, summary`` of JSON documents: top type, depth, records table."""
    c = F.col(text)
    value = F.try_parse_json(c)
    top = (
        F.when(value.isNull(), "invalid").when(F.trim(c).startswith("{"), "dict").when(F.trim(c).startswith("["), "list").otherwise("scalar")
    )
    view = safe_name_column(F.col(path))
    records = P.json_wrapper(df.select(F.col(path).alias("path"), c.alias("_text"), top.alias("_top"), view.alias("_view")), "_text", F.regexp_replace(F.substring_index("path", "/", -1), r"\.[^.]+$", ""))
    named = F.when(F.col("records_table").isNotNull(), F.concat(F.lit(", records table: "), "records_table")).otherwise("")
    out = F.when(F.col("records_table").isNotNull(), F.concat("_view", F.lit("_records"))).otherwise(F.col("_view"))
    depth = F.when(F.col("_top") != "invalid", P.json_depth(F.col("_text")))
    return records.select("path", named.alias("_r"), out.alias("view"), depth.alias("_d"), "_top").select(
        "path", F.lit("json").alias("type"), "view",
        F.format_string("JSON '%s': %s, depth %d%s (view: %s)", "path", "_top", F.coalesce("_d", F.lit(0)), "_r", "view").alias("summary"),
    )


def csv_sources(spark: SparkSession, root: str, glob: str = "*.csv") -> DataFrame:
    """``path, type, view, summary`` of the CSV files below ``root``; headers are not rows."""
    heads, rows, _ = _headed(*csv_lines(spark, root, glob))
    heads = heads.select("path", F.size("names").alias("_w"))
    counts = rows.groupBy("path").agg(F.count(F.lit(1)).alias("_n"))
    view = safe_name_column(F.concat("path", F.lit(".csv")))
    view = F.when(F.col("path").endswith(".csv"), safe_name_column(F.col("path"))).otherwise(view)
    return heads.join(counts, "path", "left").select(
        "path", F.lit("csv").alias("type"), view.alias("view"),
        F.format_string("CSV '%s': %d cols x %d rows (view: %s)", "path", "_w", F.coalesce("_n", F.lit(0)), view).alias("summary"),
    )


# Hints ------------------------------------------------------------------------

def column_hints(cells: DataFrame) -> DataFrame:
    """``path, type, hint``: the columns of each source in their order. As long as a source is wide."""
    named = cells.groupBy("path", "type", "column").agg(F.min("ordinal").alias("ordinal"))
    cols = F.array_sort(F.collect_list(F.struct("ordinal", F.col("column").alias("c"))))
    return named.groupBy("path", "type").agg(F.array_join(F.transform(cols, lambda x: x["c"]), "|").alias("hint"))


def json_hints(df: DataFrame, path: str, text: str) -> DataFrame:
    """The top keys of JSON objects, in text order; none for lists, scalars and invalid text."""
    keys = F.when(F.col(text).rlike(r"^\s*\{"), F.json_object_keys(text))
    return df.select(F.col(path).alias("path"), F.lit("json").alias("type"), F.coalesce(F.array_join(keys, "|"), F.lit("")).alias("hint"))


def document_hints(df: DataFrame, path: str, text: str, preview: int = 500) -> DataFrame:
    return df.select(
        F.col(path).cast("string").alias("path"), F.lit("doc").alias("type"), F.coalesce(F.substring(text, 1, preview), F.lit("")).alias("hint")
    )
