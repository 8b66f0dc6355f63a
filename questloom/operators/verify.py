"""Check answer tables, many tasks in one pass.

Answers are long cells ``(task_id, row_idx, col_idx, v)`` with a header table
``(task_id, col_idx, name)``. Checks are aggregates per task; a check row is
``(task_id, check, passed, detail)``.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from questloom.functions.groups import first_per_group
from questloom.functions.rules import squash_space
from questloom.functions.values import any_contains, to_number, trimmed
from questloom.operators.answers import too_precise
from questloom.rules import wording as R
from questloom.sources.files import file_sizes

# Fixed values.
NON_ISO_DATE = r"^\d{1,2}[/-]\d{1,2}[/-]\d{2,4}$"
MAX_ROWS = 1_000_000
MAX_CELL = 20_000
MAX_HEADER = 512
MAX_WIDTH = 1000
MANY_COLUMNS = 10


def equal_columns(cells: DataFrame) -> DataFrame:
    """Classes of two or more columns of a task with equal value sets: ``(task_id, first, columns)``.

    Size and two order-free hashes name a class; every member's values are then checked
    against those of the class's first column, so work and result grow with the cells.
    """
    values = cells.select("task_id", "col_idx", F.coalesce("v", F.lit("")).alias("v")).distinct()
    marks = values.groupBy("task_id", "col_idx").agg(
        F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("v")).alias("h"), F.bit_xor(F.xxhash64(F.lit(1), "v")).alias("i")
    )
    alike = Window.partitionBy("task_id", "n", "h", "i")
    named = marks.select("task_id", "col_idx", "n", F.min("col_idx").over(alike).alias("first"), F.count(F.lit(1)).over(alike).alias("many"))
    named = named.filter(F.col("many") > 1)
    heads = named.select("task_id", "first").distinct()
    firsts = values.withColumnRenamed("col_idx", "first").join(heads, ["task_id", "first"])
    members = values.join(named, ["task_id", "col_idx"])
    proved = (
        members.join(firsts, ["task_id", "first", "v"]).groupBy("task_id", "first", "col_idx", "n")
        .agg(F.count(F.lit(1)).alias("shared")).filter(F.col("shared") == F.col("n"))
    )
    return proved.groupBy("task_id", "first").agg(F.count(F.lit(1)).alias("columns")).filter(F.col("columns") > 1)


def precheck(headers: DataFrame, cells: DataFrame) -> DataFrame:
    """Warnings before an answer is submitted; ``ok`` is false without columns."""
    pairs = F.col("columns") * (F.col("columns") - 1) / 2
    same = equal_columns(cells).groupBy("task_id").agg(F.sum(pairs).cast("bigint").alias("pairs"))
    df = gather(head=header_facts(headers), body=cell_facts(cells), same=same)
    zero = F.lit(0)
    columns = F.coalesce("head.width", zero).cast("bigint")
    return df.filter(F.col("has_head") | F.col("has_body")).select(
        "task_id", columns.alias("columns"), F.coalesce("body.n_rows", zero).alias("rows"),
        F.coalesce("same.pairs", zero).alias("redundant_pairs"),
        F.coalesce("body.long_decimals", zero).alias("long_decimals"),
        F.coalesce("body.non_iso_dates", zero).alias("non_iso_dates"),
        (columns > MANY_COLUMNS).alias("many_columns"), (columns > 0).alias("ok"),
    )


def readability(
    spark: SparkSession, folder: str, expected: DataFrame, name: str, level: int = -1
) -> DataFrame:
    """Missing, empty or not UTF-8 answers below ``folder``.

    An answer is a file, or with ``level=-2`` a folder of part files. Files are read line
    by line, so a large file is split over tasks.
    """
    def file_name(c: Column) -> Column:
        return F.element_at(F.split(c, "/"), level)

    sizes = file_sizes(spark, folder).groupBy(file_name(F.col("path")).alias(name)).agg(F.sum("size").alias("length"))
    lines = (
        spark.read.option("recursiveFileLookup", "true").text(folder)
        .groupBy(file_name(F.col("_metadata.file_path")).alias(name))
        .agg(F.bool_and(F.is_valid_utf8("value")).alias("utf8"))
    )
    out = expected.select(name).join(sizes, name, "left").join(lines, name, "left")
    return out.select(name, *_readable())


def line_readability(lines: DataFrame, expected: DataFrame, name: str, value: str) -> DataFrame:
    """``readability`` of answers kept many to a file: rows ``(name, value)``, one per line."""
    seen = lines.groupBy(name).agg(
        F.sum(F.octet_length(F.coalesce(value, F.lit("")))).alias("length"), F.bool_and(F.is_valid_utf8(value)).alias("utf8")
    )
    return expected.select(name).join(seen, name, "left").select(name, *_readable())


def _readable() -> list[Column]:
    detail = (
        F.when(F.col("length").isNull(), F.lit("missing")).when(F.col("length") == 0, F.lit("empty"))
        .when(~F.col("utf8"), F.lit("not UTF-8")).otherwise(F.lit("readable"))
    )
    return [F.lit("readability_check").alias("check"), (detail == "readable").alias("passed"), detail.alias("detail")]


def gather(**parts: DataFrame) -> DataFrame:
    """One row per task with each part's columns as a struct, and ``has_<part>``.

    The fields are null where a part lacks the task. Parts hold at most one row per task;
    of repeated ones each field's greatest value stays. The rows meet in one grouped
    shuffle, whatever the number of parts, and fields nobody reads are never worked out.
    """
    fields = {name: [c for c in df.columns if c != "task_id"] for name, df in parts.items()}
    rows = [
        df.select("task_id", F.lit(True).alias(f"has_{name}"), *[F.col(c).alias(f"{name}__{c}") for c in fields[name]])
        for name, df in parts.items()
    ]
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rows)
    met = every.groupBy("task_id").agg(*[F.max(c).alias(c) for c in every.columns if c != "task_id"])
    return met.select(
        "task_id", *[F.coalesce(f"has_{name}", F.lit(False)).alias(f"has_{name}") for name in parts],
        *[F.struct(*[F.col(f"{name}__{c}").alias(c) for c in cs]).alias(name) for name, cs in fields.items() if cs],
    )


def header_facts(headers: DataFrame) -> DataFrame:
    """Width, names and faults of each header, from one array as long as the answer is wide."""
    at = F.struct("col_idx", F.col("name").alias("raw"), F.lower(squash_space(F.col("name"))).alias("n"))
    one = headers.groupBy("task_id").agg(F.sort_array(F.collect_list(at)).alias("_h")).select(
        "task_id", "_h", F.transform("_h", lambda x: F.trim(F.coalesce(x["raw"], F.lit("")))).alias("_n")
    )
    filled = F.filter("_n", lambda n: n != "")

    def some(words: Sequence[str]) -> Column:
        return F.exists("_n", lambda n: any_contains(F.lower(n), words))

    return one.select(
        "task_id", F.size("_h").alias("width"), F.size(filled).alias("named"),
        F.size(F.array_distinct(filled)).alias("names"),
        F.size(F.filter("_n", lambda n: F.length(n) > MAX_HEADER)).alias("long_names"),
        F.transform("_h", lambda x: x["n"]).alias("header"),
        some(("text", "comment")).alias("h_text"), some(("id",)).alias("h_id"), some(R.URL_WORDS).alias("h_url"),
    )


def cell_facts(cells: DataFrame) -> DataFrame:
    """All that any check asks of the cells, per task: cells are shuffled once, by answer row.

    The array below holds the cells of one answer row.
    """
    s = trimmed(F.coalesce("v", F.lit("")))
    number = to_number(F.col("v")).isNotNull()
    counts = {
        "filled_cells": s != "", "numeric_cells": number, "long_cells": F.length(s) > MAX_CELL,
        "error_cells": any_contains(F.lower(s), R.SUSPICIOUS), "long_decimals": too_precise(F.col("v")) & number,
        "non_iso_dates": s.rlike(NON_ISO_DATE),
    }
    flags = {
        "packed": (F.col("col_idx") == 0) & F.col("v").rlike(R.PACKED_CELL),
        "v_url": s.rlike(R.URL), "v_percent": s.endswith("%"),
    }
    rows = cells.groupBy("task_id", "row_idx").agg(
        F.count(F.lit(1)).alias("w"), F.max(s != "").alias("filled"),
        *[F.count_if(c).alias(n) for n, c in counts.items()], *[F.max(c).alias(n) for n, c in flags.items()],
        F.sha2(F.to_json(F.sort_array(F.collect_list(F.struct("col_idx", "v")))), 256).alias("mark"),
    )
    return rows.groupBy("task_id").agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("w").alias("narrowest"), F.max("w").alias("widest"),
        F.count_if(~F.col("filled")).alias("empty"), F.count_distinct("mark").alias("unique"),
        *[F.sum(n).alias(n) for n in counts], *[F.max(n).alias(n) for n in flags],
    )


CONTRACT = ("expected_columns", "expected_column_count", "min_rows", "max_rows", "exact_columns")


def _checked(tasks: DataFrame, headers: DataFrame, cells: DataFrame, contracts: DataFrame | None = None, **more: DataFrame) -> DataFrame:
    """Facts of tasks, flat; ``asked`` and further parts as structs; ``has_asked`` marks ``tasks``."""
    parts = {"asked": tasks, "head": header_facts(headers), "body": cell_facts(cells), **more}
    if contracts is not None:
        parts["contract"] = contracts.select("task_id", F.lit(True).alias("_has"), *CONTRACT)
    df = gather(**parts)
    flat = [n for n in ("head", "body", "contract") if n in parts]
    df = df.select("task_id", "has_asked", *(["asked"] if len(tasks.columns) > 1 else []), *more, *[f"has_{n}" for n in more], *[f"{n}.*" for n in flat])
    if contracts is None:
        return df
    return df.withColumn("_want", F.transform("expected_columns", lambda x: F.lower(squash_space(x))))


def _result(name: str, failures: Sequence[tuple[str, Column]]) -> Column:
    """First failure that applies, as a check struct."""
    detail = F.lit(None).cast("string")
    for text, cond in reversed(failures):
        detail = F.when(F.coalesce(cond, F.lit(False)), F.lit(text)).otherwise(detail)
    return F.struct(
        F.lit(name).alias("check"), detail.isNull().alias("passed"),
        F.coalesce(detail, F.lit("ok")).alias("detail"),
    )


def _contract() -> Column:
    width = F.col("width")
    return _result(
        "contract_check",
        [
            ("header missing", width.isNull()), ("header has no names", F.col("named") == 0),
            ("duplicate headers", F.col("names") < F.col("named")),
            ("header too long", F.col("long_names") > 0),
            ("inconsistent width", (F.col("narrowest") != width) | (F.col("widest") != width)),
        ],
    )


def _task_contract() -> Column:
    has = F.coalesce("_has", F.lit(False))
    named = F.size("_want") > 0
    rows = F.coalesce("n_rows", F.lit(0))
    return _result(
        "task_contract_check",
        [
            ("no header", has & F.col("header").isNull()),
            ("column count differs", has & (F.size("header") != F.col("expected_column_count"))),
            ("missing columns", has & named & (F.size(F.array_except("_want", "header")) > 0)),
            ("header mismatch", has & named & F.col("exact_columns") & (F.col("header") != F.col("_want"))),
            ("too few rows", has & (rows < F.col("min_rows"))),
            ("too many rows", has & (rows > F.col("max_rows"))),
        ],
    )


def _sanity() -> Column:
    n = F.col("n_rows")
    return _result(
        "sanity_check",
        [
            ("no data rows", n.isNull()), ("too many rows", n > MAX_ROWS),
            ("too many empty rows", F.col("empty") / n > 0.95),
            ("too many duplicates", (F.col("unique") / n < 0.05) & (n >= 20)),
            ("cell too long", F.col("long_cells") > 0), ("error-like text", F.col("error_cells") > 0),
        ],
    )


def _shape() -> Column:
    lonely = (F.col("n_rows") == 1) & (F.col("width") == 1) & (F.col("empty") == 1)
    return _result(
        "shape_check",
        [
            ("no header", F.col("width").isNull()), ("too many columns", F.col("width") > MAX_WIDTH),
            ("single empty cell", lonely),
        ],
    )


def contract_check(tasks: DataFrame, headers: DataFrame, cells: DataFrame) -> DataFrame:
    """Header present and distinct, not too long, every row as wide as the header."""
    df = _checked(tasks.select("task_id"), headers, cells).filter("has_asked")
    return df.select("task_id", F.inline(F.array(_contract())))


def task_contract_check(tasks: DataFrame, headers: DataFrame, cells: DataFrame, contracts: DataFrame) -> DataFrame:
    """Column count, names in order and row limits of the task's contract."""
    df = _checked(tasks.select("task_id"), headers, cells, contracts).filter("has_asked")
    return df.select("task_id", F.inline(F.array(_task_contract())))


def sanity_check(tasks: DataFrame, cells: DataFrame) -> DataFrame:
    """Plausible data: rows present, not mostly empty or repeated, no error text."""
    df = gather(asked=tasks.select("task_id"), body=cell_facts(cells)).filter("has_asked")
    return df.select("task_id", "body.*").select("task_id", F.inline(F.array(_sanity())))


def shape_check(tasks: DataFrame, headers: DataFrame, cells: DataFrame) -> DataFrame:
    df = _checked(tasks.select("task_id"), headers, cells).filter("has_asked")
    return df.select("task_id", F.inline(F.array(_shape())))


def _checks() -> Column:
    """Results of all layers; an unreadable answer gets no further checks, one not asked for none."""
    first = F.struct("asked.check", "asked.passed", "asked.detail")
    every = F.array(first, _contract(), _task_contract(), _sanity(), _shape())
    return F.when(F.col("asked.passed"), every).when(F.col("has_asked"), F.array(first))


def full_report(
    readable: DataFrame, headers: DataFrame, cells: DataFrame, contracts: DataFrame
) -> DataFrame:
    """All checks per task from one pass over headers and cells.

    ``readable`` is the readability check keyed by task_id; an unreadable answer gets no
    further checks.
    """
    df = _checked(readable.select("task_id", "check", "passed", "detail"), headers, cells, contracts)
    return df.select("task_id", F.inline(_checks()))


def review(
    readable: DataFrame, headers: DataFrame, cells: DataFrame, contracts: DataFrame,
    wording: DataFrame, question: str, evidence: DataFrame,
) -> DataFrame:
    """Report and semantic risks of a task as two arrays, with its cell counts.

    One row per task of any input: headers, cells and steps are each aggregated once and
    meet in one shuffle. ``wording`` is the semantic contract, ``evidence`` the trace's.
    """
    df = _checked(
        readable.select("task_id", "check", "passed", "detail"), headers, cells, contracts,
        wording=_wording(wording, question), evidence=evidence,
    )
    return df.select(
        "task_id", _checks().alias("checks"), _risks().alias("risks"), "n_rows", "filled_cells", "numeric_cells"
    )


def all_passed(report: DataFrame) -> DataFrame:
    return report.groupBy("task_id").agg(
        F.bool_and("passed").alias("all_passed"), F.count_if(~F.col("passed")).alias("failed_checks")
    )


def repair_plan(report: DataFrame, triggers: DataFrame, first: int = 5) -> DataFrame:
    """Actions for failed checks and wording triggers, by priority then type.

    All are kept; ``applied`` marks the first few of a task, which one repair round takes.
    """
    rules = F.create_map(
        *[x for name, p, act in R.CHECK_ACTIONS for x in (
            F.lit(name), F.struct(F.lit(p).alias("priority"), F.lit(act).alias("action_type")))]
    )
    failed = report.filter(~F.col("passed")).select("task_id", rules[F.col("check")].alias("r"), "detail").select(
        "task_id", "r.priority", "r.action_type", "detail", F.lit(True).alias("blocking")
    )
    asked = triggers.select(
        "task_id", "priority", "action_type", F.lit("question wording").alias("detail"), "blocking"
    )
    # A task has a handful of actions: one shuffle serves their grouping and their order.
    every = failed.unionByName(asked).repartition("task_id").groupBy("task_id", "action_type", "detail").agg(
        F.min("priority").alias("priority"), F.max("blocking").alias("blocking")
    )
    order = [F.col("priority"), F.col("action_type"), F.col("detail")]
    step = F.row_number().over(Window.partitionBy("task_id").orderBy(*order))
    return every.withColumn("step", step).withColumn("applied", F.col("step") <= first)


# Semantics --------------------------------------------------------------------

EVIDENCE = (
    # name, terms: fixed values
    ("count_star", ("count(*)",)), ("distinct", ("distinct",)), ("numerator", ("numerator",)),
    ("denominator", ("denominator",)), ("sum", ("sum(",)), ("avg", ("avg(",)),
    ("limits", (" between ", ">=", "<=", "threshold", "range")), ("outside", R.OUTSIDE_WORDS),
    ("filters", ("> 0", ">0", "dropna", "notnull", "is not null")),
    ("doc_tool", ("extract_doc_records", "read_doc", "search_doc")), ("text", ("text",)),
)
SELECTED_ID = r"\bselect\s+(?:c\.)?id\b"


def trace_evidence(steps: DataFrame, text: str, last: int = 12) -> DataFrame:
    """What the last steps of each task mention, one flag per kind.

    The steps are cut to the last few before any text is read; texts are never joined.
    """
    recent = first_per_group(steps, ["task_id"], [F.col("step_index").desc()], last)
    low = F.lower(F.coalesce(text, F.lit("")))
    return recent.groupBy("task_id").agg(
        *[F.max(any_contains(low, terms)).alias(f"e_{n}") for n, terms in EVIDENCE],
        F.max(low.rlike(SELECTED_ID)).alias("e_selected_id"),
    )


def _wording(contracts: DataFrame, question: str) -> DataFrame:
    return contracts.select(
        "task_id", F.col(question).alias("question"), "aggregation", "requested_fields", "risk_codes"
    )


def _risks() -> Column:
    """Risk codes with a severity, from the wording, the answer and the trace."""
    q = F.col("wording.question")
    low = F.lower(q)
    no = F.lit(False)

    def ev(name: str) -> Column:
        return F.coalesce(F.col(f"evidence.e_{name}"), no)

    def fact(name: str) -> Column:
        return F.coalesce(F.col(name), no)

    width, rows = F.coalesce("width", F.lit(0)), F.coalesce("n_rows", F.lit(0))
    has_rows = rows > 0
    packed = has_rows & (width == 1) & fact("packed")
    wanted = F.size("wording.requested_fields")

    def risk(code: str) -> Column:
        return F.array_contains("wording.risk_codes", code)

    def check(code: str, when: Column, severity: Column | str) -> Column:
        level = F.lit(severity) if isinstance(severity, str) else severity
        return F.when(when, F.struct(F.lit(code).alias("code"), level.alias("severity")))

    def level(warn: Column) -> Column:
        return F.when(warn, F.lit("warning")).otherwise(F.lit("info"))

    comment = low.contains("comment") & ~low.rlike(r"\bcomment\s+id\b|\bid\s+of\s+the\s+comment\b")
    id_only = (width == 1) & fact("h_id") & ~fact("h_text")
    id_read = ev("selected_id") & ~ev("text")
    checks = [
        check("target_noun_count_risk", risk("target_noun_count_risk"), level(ev("count_star") & ~ev("distinct"))),
        check("denominator_risk", risk("denominator_risk"), level(~(ev("numerator") & ev("denominator")))),
        check("temporal_aggregation_risk", risk("temporal_aggregation_risk"), level(ev("sum") & ~ev("avg") & low.contains("average"))),
        check("rank_semantics_risk", risk("rank_semantics_risk"), "info"),
        check("threshold_grounding_risk", risk("threshold_grounding_risk"), level(~(ev("limits") & ~ev("outside")))),
        check("output_shape_semantic_risk", risk("output_shape_semantic_risk"), level((width < wanted) | packed)),
        check("output_shape_semantic_risk", ~risk("output_shape_semantic_risk") & packed & q.rlike(r"(?i)\b(score|result|tally|record)\b"), "warning"),
        check("target_field_semantic_risk", comment & (id_only | id_read), "warning"),
        check("target_field_semantic_risk", any_contains(low, R.URL_WORDS) & ~fact("h_url") & ~fact("v_url"), "warning"),
        check("target_field_semantic_risk", low.contains("final score") & any_contains(low, ("home", "away", "between")) & packed, "warning"),
        check("scalar_format_semantic_risk", any_contains(low, R.PERCENT_WORDS) & fact("v_percent"), "warning"),
        check("population_filter_semantic_risk", (F.col("wording.aggregation") == "average") & q.rlike(r"(?i)\ball\b") & ev("filters"), "warning"),
        check("field_attachment_risk", risk("field_attachment_risk"), level(~q.rlike(R.GROUPING) & (rows > 1))),
        check("entity_identity_risk", risk("entity_identity_risk"), "info"),
        check("long_doc_metric_risk", risk("long_doc_metric_risk"), level(~ev("doc_tool"))),
    ]
    return F.when(F.col("has_wording"), F.array_compact(F.array(*checks)))


def semantic_checks(
    contracts: DataFrame, question: str, headers: DataFrame, cells: DataFrame, evidence: DataFrame
) -> DataFrame:
    """Risk codes with a severity, from the wording, the answer and the trace."""
    df = gather(
        wording=_wording(contracts, question), head=header_facts(headers), body=cell_facts(cells), evidence=evidence
    ).select("task_id", "has_wording", "wording", "evidence", "head.*", "body.*")
    return df.select("task_id", F.posexplode(_risks()).alias("check_no", "c")).select(
        "task_id", "check_no", "c.code", "c.severity"
    )


def range_audit(outputs: DataFrame, name: str, value: str, question: str) -> DataFrame:
    """Numbers outside the plausible range of the first metric word that applies."""
    n, q = F.lower(name), F.lower(question)
    rule = F.coalesce(
        *[
            F.when(
                n.contains(word) | q.contains(word),
                F.struct(F.lit(word).alias("metric"), F.lit(lo).alias("low"), F.lit(hi).alias("high")),
            )
            for word, lo, hi in R.RANGES
        ]
    )
    x = F.col(value)
    return (
        outputs.withColumn("_r", rule).filter(F.col("_r").isNotNull() & ~n.contains("bytes"))
        .select(*outputs.columns, "_r.metric", "_r.low", "_r.high")
        .filter((x < F.col("low")) | (x > F.col("high")))
    )


def output_warnings(outputs: DataFrame, rows: str, text: str) -> DataFrame:
    """Empty results and error-like output text; the first pattern that applies."""
    low = F.lower(F.coalesce(text, F.lit("")))
    pattern = F.coalesce(*[F.when(low.contains(p), F.lit(p)) for p in R.OUTPUT_ERRORS])
    return outputs.withColumn("empty_result", F.coalesce(F.col(rows) == 0, F.lit(False))).withColumn(
        "error_pattern", pattern
    )
