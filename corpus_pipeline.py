"""The corpus pipeline: quality rules, line dedup, near-dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet and read again as the next one's docs.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from trackline.llm.common import table
from trackline.llm.decontaminate import drop_contaminated
from trackline.llm.lines import drop_repeated_lines
from trackline.llm.packing import pack
from trackline.llm.quality import judged, quality
from trackline.llm.simhash import drop_near_duplicates
from trackline.session import require_settings, shared_dir

# Tokenisers, fingerprints and chunk hashes lie beyond SQL; tests hold each stage to brute force.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the quality rules keep, by bands from the statistics of all documents of a language.

    A null or empty text has no words and goes; a null language is one of its own; repeated rows are judged alike and
    each stays or goes; an empty table stays empty.
    """
    measured = shared_dir(spark, f"quality-{uuid.uuid4().hex}")
    quality(docs).write.parquet(measured)
    return judged(spark.read.parquet(measured), "lang").where("kept").select(docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated chunks of lines; a document with nothing else in it goes.

    The first occurrence stays, by id, so of whole copies the first is left. A text that nothing was cut from, null and
    empty ones included, stays as it is; ``n_chars`` follows where something was. An empty table stays empty.
    """
    cut = drop_repeated_lines(docs)
    left = cut.where((F.col("n_removed_lines") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    if "n_chars" in docs.columns:
        kind = dict(docs.dtypes)["n_chars"]
        changed = F.when(F.col("n_removed_lines") > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars"))
        left = left.withColumn("n_chars", changed)
    return left.select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: 4-word shingles, fingerprints within 4 bits, chains included.

    The smallest id stays, a null id after all others; of rows equal in id and text one stays. Texts without words, nulls
    included, share a fingerprint, so one of them stays. An empty table stays empty.
    """
    return drop_near_duplicates(docs).select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, by containment of its five-word shingles of 0.8 or more.

    A null or empty text holds none and stays; repeated rows go or stay together. An empty table stays empty.
    """
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark")).select(docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' token ids in sequences of 4096.

    A null or empty text has its end id only; repeated rows are packed one by one; an empty table gives no pieces.
    """
    return pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, with the tables between them in the cluster's shared folder."""
    docs = table(require_settings(spark), sf_dir, "documents")
    folder = shared_dir(spark, f"pipeline-{uuid.uuid4().hex}")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
