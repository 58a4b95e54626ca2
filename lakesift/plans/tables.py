"""The analytic tables, and the store's relations as they derive from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakesift.blocks import dealt

CUTOFF = "2024-01-15 00:00:00"
NOW = "2024-01-20 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Columns of a table of texts, dealt out to all cores where it is small."""
    return dealt(table(spark, sf_dir, name).select(*columns))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, collection, path, hash, doc, active: documents that labels call poor are deactivated."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select(F.col("doc_id").alias("l_id"), "quality")
    joined = docs.join(labels, docs.doc_id == labels.l_id, "left")
    return joined.select(F.col("doc_id").alias("id"), F.col("source").alias("collection"), F.concat(F.lit("notes/doc-"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), F.sha2("text", 256).alias("hash"), F.col("text").alias("doc"), (F.coalesce("quality", F.lit(1)) == 1).alias("active"))


DOCUMENTS_SQL = "SELECT d.doc_id AS id, source AS collection, 'notes/doc-' || d.doc_id || '.md' AS path, sha256(text) AS hash, text AS doc, coalesce(quality, 1) = 1 AS active FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The change log that events are: key, ts, event_id, kind, hash."""
    e = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "error", "deleted").when(F.col("event_type") == "signup", "added").otherwise("modified")
    return e.select(F.col("user_id").alias("key"), F.col("ts"), "event_id", kind.alias("kind"), F.sha2(F.coalesce("props", F.lit("")), 256).alias("hash"))


CHANGES_SQL = "SELECT user_id AS key, ts, event_id, CASE event_type WHEN 'error' THEN 'deleted' WHEN 'signup' THEN 'added' ELSE 'modified' END AS kind, sha256(coalesce(props, '')) AS hash FROM events"


def cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as cache entries: purchases stay, others live a day."""
    e = table(spark, sf_dir, "events")
    end = F.when(F.col("event_type") != "purchase", F.col("ts") + F.expr("interval 1 day"))
    return e.select(F.sha2(F.concat_ws("/", "event_type", F.col("user_id").cast("string")), 256).alias("hash"), F.when(F.col("event_type") == "click", "llm").otherwise("search").alias("type"), F.coalesce("props", F.lit("")).alias("result"), F.col("ts").alias("created_at"), end.alias("expires_at"), "event_id")


CACHE_SQL = "SELECT sha256(event_type || '/' || user_id) AS hash, CASE WHEN event_type = 'click' THEN 'llm' ELSE 'search' END AS type, coalesce(props, '') AS result, ts AS created_at, CASE WHEN event_type <> 'purchase' THEN ts + INTERVAL 1 DAY END AS expires_at, event_id FROM events"
