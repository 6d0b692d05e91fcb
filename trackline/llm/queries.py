"""The registered queries of the operators, thin over their general interfaces, with SQL where SQL can say it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from trackline.llm.bestfit import pack_whole
from trackline.llm.collocations import SQL as COLLOCATIONS_SQL, phrases
from trackline.llm.common import table
from trackline.llm.decontaminate import SQL as DECONTAMINATE_SQL, contaminated
from trackline.llm.extract import extract
from trackline.llm.langid import fold, identify, train
from trackline.llm.lines import SQL as LINES_SQL, drop_repeated_lines
from trackline.llm.lm import score
from trackline.llm.merkle import audited
from trackline.llm.merkle_sql import SQL as MERKLE_SQL
from trackline.llm.packing import pack
from trackline.llm.quality import judged, quality
from trackline.llm.secrets import find_secrets, sql as secrets_sql
from trackline.llm.sharding import shard
from trackline.llm.simhash import near_duplicates
from trackline.session import checkpointed, require_settings, shared_dir

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = lambda spark, sf_dir: fn(require_settings(spark), sf_dir)
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


@query("op1_simhash_components")
def simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"),
        F.lpad(F.lower(F.hex("w0")), 16, "0").alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


@query("op2_line_chunks", LINES_SQL)
def line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op3_naive_bayes")
def naive_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = fold(F.col("doc_id"), 4) == 2
    model = train(docs.where(~held_out), "text", "lang")
    found = identify(docs.select("doc_id", "text", held_out.alias("held_out")), model)
    return found.select("doc_id", "held_out", "lang_pred", "score")


@query("op4_trigram_secrets", secrets_sql())
def trigram_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


@query("op5_jump_shards")
def jump_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = shard(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "size", "text_crc32", "law", "shard", "slot", F.col("grown_shard").cast("int"))


@query("op6_host_wrappers")
def host_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


@query("op7_fertility_rules")
def fertility_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured = checkpointed(quality(table(spark, sf_dir, "documents").select("doc_id", "lang", "text")).drop("text"))
    return judged(measured, "lang").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "chars_per_token", "byte_share", "token_entropy",
    )


@query("op8_log_bilinear")
def log_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = fold(F.col("doc_id"), 10) == 0
    found = score(docs.select("doc_id", held_out.alias("held_out"), "text"), docs.where(~held_out))
    return found.select(
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


@query("op9_benchmark_containment", DECONTAMINATE_SQL)
def benchmark_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        F.col("id").alias("doc_id"), F.col("item").alias("item_id"), "n_shared", "n_shingles", "containment"
    )


@query("op10_cutting_stock")
def cutting_stock(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


@query("op11_bin_completion")
def bin_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_whole(table(spark, sf_dir, "documents"))


@query("op12_merkle_manifest", MERKLE_SQL)
def merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    even = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    tampered = F.when(even, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    folder = shared_dir(spark, f"manifest-{uuid.uuid4().hex}")
    columns = ["doc_id", "source", "lang", "n_chars", "text"]
    return audited(spark, docs, folder, columns, claimed={"text": tampered}).withColumnRenamed("id", "doc_id")


@query("op13_phrase_collocations", COLLOCATIONS_SQL)
def phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases(table(spark, sf_dir, "documents"))
