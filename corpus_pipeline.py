"""A corpus from raw documents, in five stages.

Each stage is a function of (spark, docs, sf_dir) and works on all rows its
predecessor kept. All but the last return the columns of ``docs`` unchanged in
name and type; the last adds ``mix_copy``, the number of the copy, from 1 (a
column of that name in ``docs`` is replaced by it). Other columns pass through.

1. language_id: learns rank-order profiles from the rows that have a language,
   writes the prediction into ``lang`` and drops texts that are in none: without a
   letter, or too far from every profile (``language.LEAST``).
2. near_dedup: of documents linked by a similarity of 0.8 or more on five-word
   shingles, the one of the smallest doc_id stays.
3. decontamination: drops documents of which a twentieth or more is covered by
   13-word windows of ``benchmark``.
4. secret_scans: replaces secrets in the text by a mark; no document is dropped.
5. mixing: emits each document as often as its source's target asks for.

Null texts go with stage 1, as do empty ones. Repeated rows are one after stage 2.
Empty tables pass through all stages. Very long texts are handled whole throughout.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stemma.llm import decontaminate, language, mixing, neardup, secrets
from stemma.llm.shared import materialize


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns profiles from the rows with a language and keeps texts near one of them, the prediction in ``lang``. Ties go to the
    first language by name; without rows to learn from nothing is kept."""
    return language.keep_identified(docs, language.fit(docs, F.lit(True)))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of linked documents the one of the smallest doc_id stays; of repeated rows one."""
    return neardup.drop_copies(docs, k=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of which a twentieth or more lies in windows of ``benchmark``; without benchmark items all stay."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, secrets in their texts replaced; texts without any are returned as they were."""
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as its source's target asks, with ``mix_copy``; rows of equal doc_id draw alike."""
    return mixing.mix(docs)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("secret_scans", secret_scans),
    ("mixing", mix_sources),
]

#: Language identification and redaction aren't expressible in SQL; tests/llm hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
