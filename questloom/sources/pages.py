"""Paged documents: bounded reading, keyword search, tables and profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from questloom.functions.groups import first_per_group
from questloom.functions.values import trimmed

# Reading limits.
PAGE_CHARS = 2000
TOTAL_CHARS = 8000
MAX_PAGES = 5
BEFORE, AFTER = 180, 320


def split_pages(df: DataFrame, doc: str, text: str, mark: str) -> DataFrame:
    return df.select(
        doc, F.posexplode(F.split(F.col(text), mark)).alias("_p", "text")
    ).select(doc, (F.col("_p") + 1).alias("page_no"), "text")


def read_bounded(
    pages: DataFrame, doc: str, max_pages: int = MAX_PAGES, total: int = TOTAL_CHARS, page_chars: int = PAGE_CHARS
) -> DataFrame:
    """First pages of each document within a character budget.

    The page filter comes first, so the window sees at most ``max_pages`` rows per document.
    """
    counts = pages.groupBy(doc).agg(F.count(F.lit(1)).alias("page_count"))
    w = Window.partitionBy(doc).orderBy("page_no").rowsBetween(Window.unboundedPreceding, -1)
    size = F.least(F.length("text"), F.lit(page_chars))
    head = (
        pages.filter(F.col("page_no") <= max_pages)
        .withColumn("_left", F.lit(total) - F.coalesce(F.sum(size).over(w), F.lit(0)))
        .filter(F.col("_left") > 0)
        .withColumn("excerpt", F.substring(F.col("text"), F.lit(1), F.least(size, F.col("_left")).cast("int")))
    )
    return head.join(counts, doc).select(
        doc, "page_no", "excerpt", (F.length("text") > F.length("excerpt")).alias("truncated"),
        "page_count",
    )


def search(pages: DataFrame, doc: str, query: str, max_matches: int | None = None) -> DataFrame:
    """First hit on each page with its surroundings; all pages, or the first ``max_matches``."""
    q = query.lower().strip()
    at = F.instr(F.lower("text"), q) - 1
    start = F.greatest(at - BEFORE, F.lit(0))
    end = F.least(at + len(q) + AFTER, F.length("text"))
    hits = pages.filter(F.lower("text").contains(q)).select(
        doc, "page_no", trimmed(F.substring(F.col("text"), start + 1, end - start)).alias("excerpt")
    )
    return hits if max_matches is None else first_per_group(hits, [doc], [F.col("page_no")], max_matches).drop("rn")


def html_tables(
    df: DataFrame, doc: str, html: str, table: str = "table", row: str = "tr", cell: str = "t[dh]",
    max_tables: int | None = None, max_rows: int | None = None,
) -> DataFrame:
    """Rows of the tables inside each page; all work stays within the page's own row.

    All tables and rows, unless limits are given; ``truncated`` then marks cut tables.
    """
    def tag(name: str) -> str:
        return rf"(?is)<{name}(?:\s[^>]*)?>(.*?)</{name}>"

    tables = F.regexp_extract_all(F.col(html), F.lit(tag(table)), F.lit(1))
    tables = tables if max_tables is None else F.slice(tables, 1, max_tables)
    one = df.select(doc, F.posexplode(tables).alias("_t", "_body")).withColumn(
        "_rows", F.regexp_extract_all("_body", F.lit(tag(row)), F.lit(1))
    )
    cells = F.transform(
        F.regexp_extract_all("_row", F.lit(tag(cell)), F.lit(1)),
        lambda c: F.trim(F.regexp_replace(c, "<[^>]*>", "")),
    )
    shown, cut = (F.col("_rows"), F.lit(False)) if max_rows is None else (F.slice("_rows", 1, max_rows), F.size("_rows") > max_rows)
    return one.select(
        doc, (F.col("_t") + 1).alias("table_index"), F.size("_rows").alias("row_count"),
        cut.alias("truncated"), F.posexplode(shown).alias("row_index", "_row"),
    ).select(
        doc, "table_index", "row_count", "truncated", "row_index",
        F.array_join(cells, "|").alias("cells"),
    )


def profile(pages: DataFrame, doc: str, tables: str, preview: int = 3) -> DataFrame:
    """Page count, characters and estimated tables of the first pages."""
    early = F.col("page_no") <= preview
    return pages.groupBy(doc).agg(
        F.count(F.lit(1)).alias("page_count"),
        F.sum(F.when(early, F.length("text")).otherwise(0)).alias("preview_chars"),
        F.sum(F.when(early, F.col(tables)).otherwise(0)).alias("table_count_estimate"),
        (F.max("page_no") > preview).alias("truncated"),
    )
