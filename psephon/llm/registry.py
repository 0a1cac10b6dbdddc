"""Queries of the corpus operators: each applies its operator to its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary() -> tuple[bytes, str]:
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        return f.read(), public_tokenizers.PATTERN


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from psephon.llm import jaccard

    return jaccard.jaccard_components(table(spark, sf_dir, "documents")).drop("node")


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from psephon.llm import byteruns

    out = byteruns.byte_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from psephon.llm import lines

    return lines.line_dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from psephon.llm import decontaminate

    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from psephon.llm import substrings

    out = substrings.substring_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"), F.size("spans").cast("long").alias("n_spans"))


def op6_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from psephon.llm import jpeg

    return jpeg.read_media(jpeg.encode_media(table(spark, sf_dir, "documents"))).drop("media")


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from psephon.llm import urls

    return urls.judge(table(spark, sf_dir, "pages"), urls.RULES)


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from psephon.llm import lm

    out = lm.score(table(spark, sf_dir, "documents"))
    return out.withColumns({c: F.round(c, 7) for c in ("base_score", "score")})


def op9_byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from psephon.llm import bpe

    return bpe.round_trip(table(spark, sf_dir, "documents"), *vocabulary())


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from psephon.llm import quality

    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict:
    own = [op1_ngram_jaccard, op2_suffix_array_dedup, op3_line_dedup, op4_decontamination, op5_substring_dedup, op6_media_columns, op7_url_filters, op8_lm_scoring, op9_byte_level_bpe, op10_quality_classifier]
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    from psephon.llm import oracles, urls

    return {
        "op1_ngram_jaccard": oracles.JACCARD, "op2_suffix_array_dedup": oracles.BYTES, "op3_line_dedup": oracles.LINES,
        "op5_substring_dedup": oracles.SUBSTRINGS, "op7_url_filters": urls.oracle(), "op8_lm_scoring": oracles.MODEL,
    }
