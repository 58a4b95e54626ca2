"""The queries of this subpackage, with production parameters over whole tables, and their SQL."""

from __future__ import annotations

import importlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakesift.llm import bpe, conversations, decontamination, divergence, jaccard, media, packing, secrets, sharding, substrings, token_counts, toxicity, warc
from lakesift.llm.common import materialise

SHARDS = [f"shard-{i:03d}" for i in range(64)]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_join(_table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "class_id", "n_links", "copy_id", "n_copies")


def op3_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan_rows(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("spans", 256).alias("base_sha256"), "spans")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.train(docs, _table(spark, sf_dir, "labels")))
    return scored.select("doc_id", toxicity.is_held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_table(spark, sf_dir, "documents"), SHARDS).select("doc_id", "slot", "shard", "shard_name")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(_table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op8_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.read_back(materialise(media.media_column(_table(spark, sf_dir, "documents")), "media"))


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read_archives(warc.write_archives(_table(spark, sf_dir, "pages"))).drop("uri")


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_table(spark, sf_dir, "documents"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations")
    return conversations.audit(turns, conversations.damaged(turns))


def op13_bpe_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = bpe.decode(bpe.encode(_table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text"))
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def queries() -> dict:
    own = {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}
    return dict(sorted(own.items(), key=lambda x: int(x[0][2:].split("_")[0])))


def oracle_sql() -> dict[str, str]:
    return importlib.import_module("lakesift.llm.oracles").oracle_sql()
