"""A training-data pipeline over documents: each stage reads what the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sealmark.llm import common, decontaminate, near_dedup, quality, secret_scan, sp_codec
from sealmark.llm.queries import vocabulary


@common.bounded
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the quality rules reject; a document without an id can't be named, and stays."""
    rejected = common.table(quality.rate(docs).filter("not kept").select("doc_id").distinct(), "rejected")
    return docs.join(common.maybe_broadcast(rejected, 2_000_000), "doc_id", "left_anti").select(*docs.columns)


@common.bounded
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies."""
    return near_dedup.keep_one(docs)


@common.bounded
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that contain a benchmark item."""
    return decontaminate.clean(docs, common.read(spark, sf_dir, "benchmark"))


@common.bounded
def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets by a mark."""
    found = secret_scan.clean(docs, names=secret_scan.identifiers(docs))
    return found.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in docs.columns else found


@common.bounded
def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes the cleaned texts, decodes them again, and returns each document's digest."""
    path = vocabulary("piece_bpe_32k.model")
    return sp_codec.encode(docs, path, digests=True, small=True)


STAGES = [("quality rules", quality_rules), ("near-duplicates", near_duplicates), ("decontamination", decontamination), ("secret scans", secrets), ("sentencepiece", sentencepiece)]

#: The stages' sketches and token ids have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = common.table(docs, f"stage{k + 1}")
    return docs
