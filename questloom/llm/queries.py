"""One query per operator, with production parameters, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from questloom.llm import (
    conversations, decontam, langid, lines, mixing, neardup, neighbours, pii, quality, repeats, secret_scan, spelling, tokens,
)
from questloom.llm.registry import query, table


def tokenizer_file(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op1_token_counts")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.token_counts(table(spark, folder, "documents"), tokenizer_file())


@query("op2_mix_sources", "WITH " + mixing.MIX_SQL.format(docs="documents") + " SELECT * FROM _mixed")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents"))


@query(
    "op5_line_dedup",
    "WITH " + lines.LINES_SQL.format(docs="documents")
    + " SELECT doc_id, n_lines, n_dropped, sha256(kept) AS kept_sha256 FROM _kept",
)
def op5(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return lines.dedup_lines(docs).select(
        "doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"),
        F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"),
    )


@query("op10_secret_scan")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    found = secret_scan.find_secrets(table(spark, folder, "documents"))
    return found.select(
        "doc_id", "n_assign", "n_access", "n_hex",
        F.sha2(secret_scan.spans_text(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        secret_scan.spans_text(F.col("spans")).alias("spans"),
    )


@query("op4_quality_rules")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    return quality.judge(table(spark, folder, "documents"))


@query("op3_personal_data")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    found = pii.find_personal_data(table(spark, folder, "documents"))
    base = F.array_join(
        F.transform("spans", lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ","
    )
    terms = F.array_join(
        F.transform("terms", lambda x: F.concat_ws(":", F.lit("term"), x["start"].cast("string"), x["end"].cast("string"))), ","
    )

    def n(kind: str):
        return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id", *map(n, pii.KINDS), F.sha2(base.cast("binary"), 256).alias("base_sha256"),
        F.concat_ws(",", F.nullif(base, F.lit("")), F.nullif(terms, F.lit(""))).alias("spans"),
    )


@query("op7_language_id")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return langid.identify(table(spark, folder, "documents"))


@query("op9_ngram_jaccard_join")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, folder, "documents"))


@query("op8_repeated_strings")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    cut = repeats.cut_repeats(table(spark, folder, "documents"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query("op6_decontamination")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    return decontam.find_contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op11_spelling_variants")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, folder, "documents"))


@query("op12_nearest_neighbours")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.search(table(spark, folder, "embeddings"))


@query("op13_conversation_repair")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return conversations.repair_summary(conversations.damage(table(spark, folder, "conversations")))
