"""Label questions: signals, routes, task profiles, intents, contracts, risks, triggers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from questloom.functions.rules import (
    distinct_ignoring_case, holds, names_of, pick, squash_space,
)
from questloom.functions.values import any_contains, any_word, bound
from questloom.rules import wording as R


def signals(q: Column, words: Sequence[str]) -> Column:
    """Signal words found; phrases as substrings, single words between boundaries."""
    return bound(
        squash_space(F.lower(q)),
        lambda text: names_of(
            [(w, text.contains(w) if " " in w else text.rlike(rf"\b{w}\b")) for w in words]
        ),
    )


def intents(q: Column, rules: Sequence[tuple[str, str]] = R.LOG_INTENTS) -> Column:
    return names_of([(n, q.rlike(p)) for n, p in rules])


def file_counts(files: DataFrame, key: str, path: str, size: str) -> DataFrame:
    """How many files of each kind a context holds."""
    name = F.lower(F.regexp_replace(path, "^.*/", ""))
    suffix = F.regexp_extract(name, r"\.([^.]+)$", 1)
    knowledge = name == "knowledge.md"
    return files.groupBy(key).agg(
        F.count_if(suffix == "csv").alias("csv_files"),
        F.count_if((suffix == "csv") & (F.col(size) >= R.LARGE_FILE)).alias("large_csv_files"),
        F.count_if(suffix.isin("sqlite", "db", "sqlite3", "db3", "duckdb")).alias("db_files"),
        F.count_if(suffix == "json").alias("json_files"),
        F.count_if(~knowledge & suffix.isin("md", "txt", "pdf")).alias("doc_files"),
        F.count_if(knowledge).alias("knowledge_files"),
    )


def with_file_counts(questions: DataFrame, counts: DataFrame, key: str) -> DataFrame:
    """Questions with the counts of their files, 0 for a question without files."""
    names = [c for c in counts.columns if c != key]
    return questions.join(counts, key, "left").fillna(0, subset=names)


def route_scores(df: DataFrame, question: str, difficulty: str) -> DataFrame:
    """Five route scores from the file mix, the wording and the difficulty, and the winner."""
    q = F.col(question)
    counted = df.select(
        "*", F.size(signals(q, R.SQL_SIGNALS)).alias("_s"), F.size(signals(q, R.PYTHON_SIGNALS)).alias("_p"),
        F.size(signals(q, R.DOCUMENT_SIGNALS)).alias("_d"),
    )
    s, p, d = F.col("_s"), F.col("_p"), F.col("_d")
    csv, large, db = F.col("csv_files") > 0, F.col("large_csv_files") > 0, F.col("db_files") > 0
    js, doc, know = F.col("json_files") > 0, F.col("doc_files") > 0, F.col("knowledge_files") > 0
    table = db | csv | js
    fast = F.lower(difficulty).isin("easy", "medium") & table & ~doc

    def add(cond: Column, n: Column | int) -> Column:
        return F.when(cond, n).otherwise(0)

    sql = add(db, 4) + add(large, 5) + add(s > 0, s + 2) + add(fast & (db | large), 4)
    python = (
        add(csv, 3) + add(js, 2) + add(p > 0, p + 2) + add(~table & ~(doc | know), 1)
        + add(fast & ~db & ~large, 4)
    )
    document = add(doc, 3) + add(know & doc & (d > 0), 1) + add(d > 0, d + 2)
    mixed = (
        add(db, 2) + add(csv, 1) + add(large, 3) + s + p + add(db & csv, 3) + add(db & (p > 0), 3)
        + add(fast & (db | large), 2) + add(fast & ~db & ~large, 1)
    )
    both = add(doc, 2) + d + add(doc & table, 3) + add(doc & (s > 0), 2)
    scored = counted.select(
        "*", sql.alias("sql_first"), python.alias("python_first"),
        F.when(fast, F.least(document, F.lit(1))).otherwise(document).alias("document_first"),
        mixed.alias("hybrid_sql_python"), F.when(fast, 0).otherwise(both).alias("hybrid_doc_table"),
    )
    best = F.array_max(
        F.array(
            *[
                F.struct(F.col(r).alias("s"), F.lit(-i).alias("o"), F.lit(r).alias("r"))
                for i, r in enumerate(R.ROUTES)
            ]
        )
    )
    return scored.withColumn(
        "route", F.when(best["s"] == 0, F.lit("python_first")).otherwise(best["r"])
    ).drop("_s", "_p", "_d")


def task_profile(df: DataFrame, question: str, has_table: Column, has_doc: Column) -> DataFrame:
    """Task type, operation, output shape, flags and what to verify."""
    q = F.col("_q")
    base = df.withColumn("_q", squash_space(F.lower(question))).select(
        "*", *[q.rlike(p).alias(f"_{n}") for n, p in R.PROFILE_FLAGS],
        has_table.alias("_table"), has_doc.alias("_doc"),
    )
    c = {n: F.col(f"_{n}") for n, _ in R.PROFILE_FLAGS}
    both = F.col("_table") & F.col("_doc")
    is_sum = c["is_sum"] & ~c["is_count"]
    shape = (
        F.when(c["is_table"], F.lit("table"))
        .when(c["is_lookup"] & c["is_pair"], F.lit("single_record")).otherwise(F.lit("scalar"))
    )
    ordered = (
        (c["is_threshold"] & c["is_count"], "threshold_count", F.lit("threshold_count")),
        (c["is_ratio"], "ratio", F.lit("ratio_or_percentage")),
        (c["is_average"], "aggregate_average", F.lit("aggregation")),
        (is_sum, "aggregate_sum", F.lit("aggregation")),
        (c["is_rank"], "rank_lookup", F.lit("rank_lookup")),
        (c["is_count"], "count", F.lit("count")),
        (c["is_lookup"], "lookup", F.when(both, F.lit("document_table_lookup")).otherwise(F.lit("lookup"))),
    )
    operation, kind = F.lit(None), F.lit(None)
    for cond, op, t in reversed(ordered):
        operation = F.when(cond, F.lit(op)).otherwise(operation)
        kind = F.when(cond, t).otherwise(kind)
    typed = base.select(
        "*", F.coalesce(operation, F.lit("analysis")).alias("operation"),
        F.coalesce(kind, F.lit("general_analysis")).alias("task_type"), shape.alias("output_shape"),
    )
    t = F.col("task_type")
    single = (F.col("output_shape") == "scalar") & t.isin(
        "count", "aggregation", "ratio_or_percentage", "threshold_count"
    )
    flags = names_of(
        [("join_likely", c["is_join"] | both), ("doc_table_grounding", both), ("single_value_expected", single)]
    )
    focus = names_of(
        [(text, t.isin(*kinds)) for kinds, text in R.FOCUS]
        + [("extract document rules first, then apply them to table rows", both)]
    )
    hidden = [f"_{n}" for n, _ in R.PROFILE_FLAGS] + ["_table", "_doc", "_q"]
    return typed.select("*", flags.alias("flags"), focus.alias("validation_focus")).drop(*hidden)


def domain_tags(questions: DataFrame, names: DataFrame, key: str, question: str, name: str) -> DataFrame:
    """Domains whose terms occur in the question or in a schema name of the task.

    Each name is reduced to a bit mask, so the names of a task are never collected. Terms
    are tested inside one name, not across two neighbouring ones.
    """
    def mask(c: Column) -> Column:
        out = F.lit(0)
        for i, (_, terms) in enumerate(R.DOMAINS):
            out = out.bitwiseOR(F.when(any_contains(c, terms), F.lit(1 << i)).otherwise(F.lit(0)))
        return out

    per_task = names.groupBy(key).agg(F.bit_or(mask(F.lower(name))).alias("_n"))
    every = questions.join(per_task, key, "left").withColumn(
        "_m", bound(squash_space(F.lower(question)), mask).bitwiseOR(F.coalesce("_n", F.lit(0)))
    )
    tags = names_of(
        [(n, F.col("_m").bitwiseAND(F.lit(1 << i)) != 0) for i, (n, _) in enumerate(R.DOMAINS)]
    )
    return every.withColumn("domains", tags).drop("_n", "_m")


# Contracts --------------------------------------------------------------------

def _columns(items: Column) -> Column:
    return distinct_ignoring_case(
        F.filter(F.transform(items, lambda x: squash_space(x)), lambda x: x != "")
    )


def named_columns(q: Column) -> Column:
    """Column names stated in the question, empty when there are none."""
    none = F.expr("cast(array() as array<string>)")
    out = none
    for pattern in reversed(R.NAMED_COLUMNS):
        raw = F.regexp_replace(F.regexp_extract(q, pattern, 1), R.NAMED_END, "")
        cols = _columns(F.split(raw, ","))
        out = F.when(F.size(cols) > 0, cols).otherwise(out)
    return out


def _listed(q: Column, pattern: str) -> Column:
    phrase = F.btrim(
        F.regexp_replace(F.regexp_extract(q, pattern, 1), r"\b(and\s+)?their\b", ""), F.lit(" ,")
    )
    parts = F.transform(F.split(phrase, R.LIST_GAP), lambda p: F.btrim(p, F.lit(" ,")))
    kept = F.filter(
        parts,
        lambda p: (p != "") & ~p.isin(*R.LIST_STOP) & (F.size(F.split(p, r"\s+")) <= 6),
    )
    return F.when(F.size(kept) >= 2, F.size(kept))


def column_count(question: Column) -> Column:
    """How many columns the wording asks for, NULL when it does not say."""
    q = F.lower(F.trim(question))
    two = holds(q, (("type",), ("expense",), ("total value", "total cost", "sum", "total"))) | holds(
        q, (("website", "web site", "url"), ("name", "reference", "ref"))
    )
    single = F.lit(False)
    for p in R.SINGLE_FIELD:
        single = single | q.rlike(p)
    return F.when(two, F.lit(2)).otherwise(
        F.coalesce(*[_listed(q, p) for p in R.LISTED_FIELDS], F.when(single, F.lit(1)))
    )


def row_cap(question: Column) -> Column:
    q = F.lower(question)
    found = [pick(q, p).try_cast("bigint") for p in R.ROW_CAPS]
    return F.coalesce(*[F.when(x > 0, x) for x in found])


def contract_from_wording(df: DataFrame, question: str) -> DataFrame:
    q = F.col(question)
    named = df.withColumn("expected_columns", named_columns(q))
    n = F.size("expected_columns")
    return named.withColumn(
        "expected_column_count", F.when(n > 0, n).otherwise(column_count(q)).cast("bigint")
    ).withColumn("max_rows", row_cap(q))


def _from_list(v: Column) -> Column:
    items = F.from_json(v, "array<string>")
    named = F.transform(
        items,
        lambda x: F.when(
            x.startswith("{"),
            F.coalesce(*[F.nullif(F.get_json_object(x, f"$.{k}"), F.lit("")) for k in ("name", "column", "field")]),
        ).otherwise(x),
    )
    return _columns(F.array_compact(named))


def _from_text(v: Column) -> Column:
    return _columns(F.split(F.regexp_replace(F.trim(v), R.COLUMN_LEAD, ""), ","))


def _flat(v: Column) -> Column:
    none = F.expr("cast(array() as array<string>)")
    return (
        F.when(v.isNull() | v.startswith("{"), none).when(v.startswith("["), _from_list(v))
        .otherwise(_from_text(v))
    )


def contract_from_fields(df: DataFrame, payload: str) -> DataFrame:
    """Expected columns and row limits from the fields of a task definition.

    A field may hold a text, a list of names or objects, or a schema object. All places
    that may name columns are listed in order; the first that does wins.
    """
    c = F.col(payload)
    keys = (*R.COLUMN_KEYS, *R.SCHEMA_KEYS)

    def place(source: Column, v: Column) -> Column:
        return F.struct(source.alias("source"), v.alias("v"))

    tops = F.array(*[place(F.lit(k), F.get_json_object(c, f"$.{k}")) for k in keys])

    def inside(x: Column) -> Column:
        props = F.json_object_keys(F.get_json_object(x["v"], "$.properties"))
        fields = F.get_json_object(x["v"], "$.fields")
        return F.array(
            *[place(x["source"], F.get_json_object(x["v"], f"$.{k}")) for k in R.COLUMN_KEYS],
            place(x["source"], F.to_json(props)),
            place(x["source"], F.when(fields.startswith("["), fields)),
        )

    places = F.flatten(
        F.transform(tops, lambda x: F.when(x["v"].startswith("{"), inside(x)).otherwise(F.array(x)))
    )
    named = F.filter(
        F.transform("_p", lambda x: F.struct(x["source"].alias("source"), _flat(x["v"]).alias("cols"))),
        lambda x: F.size(x["cols"]) > 0,
    )
    best = F.try_element_at(named, F.lit(1))

    def limit(a: str, b: str) -> Column:
        first = F.get_json_object(c, f"$.{a}").try_cast("bigint")
        second = F.get_json_object(c, f"$.{b}").try_cast("bigint")
        v = F.coalesce(F.when(first != 0, first), second)
        return F.when(v >= 0, v)

    known = df.withColumn("_p", F.filter(places, lambda x: x["v"].isNotNull())).withColumn("_b", best)
    return known.select(
        *df.columns, F.col("_b.source").alias("source"), F.col("_b.cols").alias("expected_columns"),
        limit("min_rows", "expected_min_rows").alias("min_rows"),
        limit("max_rows", "expected_max_rows").alias("max_rows"),
        F.coalesce(F.get_json_object(c, "$.exact_columns").try_cast("boolean"), F.lit(True)).alias("exact_columns"),
    )


# Semantics --------------------------------------------------------------------

def _clean_target(c: Column) -> Column:
    s = F.btrim(F.lower(c), F.lit(" ?.,:;"))
    return F.nullif(squash_space(F.regexp_replace(s, R.TARGET_LEAD, "")), F.lit(""))


def count_target(q: Column) -> Column:
    ante = _clean_target(F.regexp_extract(q, R.ANTECEDENT, 1))
    options = []
    for p in R.COUNT_TARGETS:
        t = _clean_target(F.regexp_extract(q, p, 1))
        options.append(F.when(t.isin(*R.PRONOUNS), F.coalesce(ante, t)).otherwise(t))
    return F.coalesce(*options)


def requested_fields(q: Column) -> Column:
    """Fields named as 'list A, B and C'; empty unless there are at least two."""
    text = F.trim(q)
    options = []
    for p in R.REQUESTED:
        span = F.regexp_extract(text, p, 1)
        parts = F.transform(
            F.split(span, R.REQUEST_GAP),
            lambda x: F.trim(F.regexp_replace(F.btrim(x, F.lit(" .,:;")), r"(?i)^(?:the|a|an)\s+", "")),
        )
        kept = F.filter(parts, lambda x: (x != "") & ~x.rlike(R.COUNT))
        options.append(
            F.when((F.length(span) <= 120) & (F.size(kept) >= 2), distinct_ignoring_case(kept))
        )
    return F.coalesce(*options, F.expr("cast(array() as array<string>)"))


def semantic_contract(df: DataFrame, question: str) -> DataFrame:
    """Intents, aggregation, counted noun, requested fields, output shape and risk codes."""
    q = F.col(question)
    agg = F.lit(None)
    for name, pattern in reversed(R.AGGREGATIONS):
        agg = F.when(q.rlike(pattern), F.lit(name)).otherwise(agg)
    base = df.select(
        "*", intents(q, R.INTENTS).alias("intents"), agg.alias("aggregation"),
        requested_fields(q).alias("requested_fields"),
    ).withColumn("target_noun", F.when(F.col("aggregation") == "count", count_target(q)))
    n = F.size("requested_fields")
    shape = (
        F.when(F.col("aggregation").isNotNull() & (n == 0), F.lit("scalar"))
        .when(n > 0, F.concat(n.cast("string"), F.lit(" requested field(s)"))).otherwise(F.lit("unknown"))
    )
    noun = F.col("target_noun")
    risks = names_of(
        [
            ("target_noun_count_risk", noun.isNotNull() & ~noun.isin(*R.ROW_NOUNS)),
            ("denominator_risk", q.rlike(R.RATIO)),
            ("temporal_aggregation_risk", q.rlike(R.AVERAGE) & q.rlike(R.TEMPORAL)),
            ("rank_semantics_risk", q.rlike(R.RANK)),
            ("threshold_grounding_risk", q.rlike(R.THRESHOLD)),
            ("output_shape_semantic_risk", n > 0),
            ("field_attachment_risk", q.rlike(R.ATTACHMENT) & q.rlike(R.METRIC)),
            ("entity_identity_risk", q.rlike(R.IDENTITY)),
            ("long_doc_metric_risk", q.rlike(R.DOCUMENT)),
        ]
    )
    return base.withColumn("output_shape", shape).withColumn("risk_codes", risks)


def schema_risk_hints(df: DataFrame, question: str, split_names: Column) -> DataFrame:
    """Risk hints of the wording; ``split_names`` says the schema has first and last names."""
    q = F.lower(question)
    person = q.contains("full name") | holds(q, (("name",), R.IDENTITY_HINT))
    pairs = [(n, holds(q, g)) for n, g in R.RISK_HINTS]
    pairs[2:2] = [
        ("entity_identity_risk: split columns", person & split_names),
        ("entity_identity_risk: check source", person & ~split_names),
    ]
    return df.withColumn("risk_hints", names_of(pairs))


def repair_triggers(df: DataFrame, question: str) -> DataFrame:
    """Repair actions asked for by wording and answer shape.

    ``df`` has one row per task with ``width``, ``data_rows``, ``text_cells``,
    ``numeric_cells``, ``first_cell``, ``headers`` and ``keep_column``.
    """
    q = F.lower(question)

    def act(name: str, priority: int, blocking: bool, cond: Column) -> Column:
        return F.when(
            cond,
            F.struct(
                F.lit(priority).alias("priority"), F.lit(name).alias("action_type"),
                F.lit(blocking).alias("blocking"),
            ),
        )

    cell = F.trim(F.coalesce("first_cell", F.lit("")))
    one = F.col("width") == 1
    actions = [
        act("recompute_numeric", 30, True, any_word(q, R.NUMERIC_WORDS) & (F.col("text_cells") > 0) & (F.col("numeric_cells") == 0)),
        act("regenerate_comparison", 31, True, any_word(q, R.COMPARE_WORDS) & (F.col("data_rows") == 0)),
        act("split_full_name", 12, False, q.contains("full name") & F.arrays_overlap(F.transform("headers", lambda h: F.lower(F.trim(h))), F.array(*[F.lit(x) for x in R.FULL_NAME_COLUMNS]))),
        act("prune_redundant_columns", 14, False, F.col("keep_column").isNotNull()),
        act("split_final_score", 12, False, q.contains("final score") & one & (F.col("data_rows") >= 1) & cell.rlike(r"^\d+\s*[-:]\s*\d+$")),
        act("strip_percent_symbol", 12, False, any_contains(q, ("percentage", "percent", "how much faster")) & one & (F.col("data_rows") == 1) & cell.rlike(r"^[-+]?\d+(?:\.\d+)?\s*%$")),
    ]
    actions += [act(n, p, False, holds(q, g)) for n, p, g in R.WORD_TRIGGERS]
    return df.select("task_id", F.explode(F.array_compact(F.array(*actions))).alias("a")).select(
        "task_id", "a.priority", "a.action_type", "a.blocking"
    )


