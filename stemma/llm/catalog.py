"""The queries of this subpackage, ``opN_<name>`` and ``pipeline``, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, katz, language, media, mixing, negatives, neardup, quality, ranked, secrets, toxicity, urlrules


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder_is(mod: int, rest: int) -> Column:
    """crc32(doc_id as text) mod ``mod`` is ``rest``; false for a null doc_id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % mod == rest, F.lit(False))


def learned_from(mod: int, rest: int) -> Column:
    """The rows to learn from: those with a doc_id that aren't held out."""
    return F.col("doc_id").isNotNull() & ~remainder_is(mod, rest)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    found = toxicity.score(docs, toxicity.fit(docs, labels, learned_from(3, 1)))
    return found.select("doc_id", remainder_is(3, 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.report(table(spark, sf_dir, "documents"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    found = quality.score(docs, quality.fit(docs, labels, learned_from(3, 1)))
    return found.select("doc_id", remainder_is(3, 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.report(table(spark, sf_dir, "documents"))


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.col("doc_id").isNull() | remainder_is(7, 2)
    scores, _, m = katz.score(table(spark, sf_dir, "documents"), held)
    return scores.select("doc_id", (F.col("held_out") & F.col("doc_id").isNotNull()).alias("held_out"), "n_tokens", "n_known", F.lit(m.n).cast("long").alias("train_tokens"), "base_score", "score")


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def proximity_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beside op6's exact matches: windows whose words each stand at most one word from their place."""
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), slop=1)


def op7_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(table(spark, sf_dir, "documents"))


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(urlrules.RULES, "host string, path string, verdict string")
    return urlrules.judge(table(spark, sf_dir, "pages").select("page_id", "url"), rules)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language.identify(docs, language.fit(docs, learned_from(4, 2)))
    return found.select("doc_id", remainder_is(4, 2).alias("held_out"), "lang_pred", "score")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op11_byte_bpe(spark: SparkSession, sf_dir: str, vocabulary: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    import public_tokenizers

    with open(public_tokenizers.path(vocabulary), "rb") as f:
        found = bpe.Vocabulary.read(f.read(), public_tokenizers.PATTERN)
    return bpe.report(table(spark, sf_dir, "documents"), found)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.report(table(spark, sf_dir, "embeddings"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_toxicity": op1_toxicity,
        "op2_media_columns": op2_media_columns,
        "op3_quality_classifier": op3_quality_classifier,
        "op4_minhash_near_dedup": op4_minhash_near_dedup,
        "op5_lm_scoring": op5_lm_scoring,
        "op6_benchmark_decontamination": op6_benchmark_decontamination,
        "proximity_matches": proximity_matches,
        "op7_secret_scans": op7_secret_scans,
        "op8_url_filters": op8_url_filters,
        "op9_language_id": op9_language_id,
        "op10_mixing": op10_mixing,
        "op11_byte_bpe": op11_byte_bpe,
        "op12_hard_negatives": op12_hard_negatives,
        "op13_ranked_search": op13_ranked_search,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_minhash_near_dedup": neardup.ORACLE, "op6_benchmark_decontamination": decontaminate.ORACLE, "op8_url_filters": urlrules.ORACLE, "op10_mixing": mixing.ORACLE, "op12_hard_negatives": negatives.ORACLE, "op13_ranked_search": ranked.ORACLE}
