"""Queries of ingestion, lifecycle, caches and collections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakesift.functions import text as tx
from lakesift.operators import ingest, lifecycle
from lakesift.operators.chunking import chunk_documents
from lakesift.plans.tables import CACHE_SQL, CHANGES_SQL, CUTOFF, DOCUMENTS_SQL, NOW, cache, changes, documents, table, texts
from lakesift.streaming.watch import last_changes

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def _ts(text: str):
    return F.lit(text).cast("timestamp_ntz")


@query("SELECT sha256(text) AS hash, min(doc_id) AS first_doc, count(*) AS n_docs, max(n_chars) AS n_chars FROM documents GROUP BY 1")
def content_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.groupBy(tx.content_hash(F.col("text")).alias("hash")).agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("n_docs"), F.max("n_chars").alias("n_chars"))


@query(f"WITH d AS ({DOCUMENTS_SQL}), e AS (SELECT DISTINCT hash FROM d WHERE NOT active) SELECT hash, 'kept' AS origin FROM e UNION ALL SELECT DISTINCT hash, 'inserted' FROM d WHERE hash NOT IN (SELECT hash FROM e)")
def content_insert_ignore(spark, sf_dir):
    d = documents(spark, sf_dir)
    return lifecycle.insert_ignore(d.where("not active").select("hash").distinct().withColumn("origin", F.lit("kept")), d.select("hash").withColumn("origin", F.lit("inserted")), "hash")


_STATES = f"""WITH c AS ({CHANGES_SQL}),
 old AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts DESC, event_id DESC) AS n, min(event_id) OVER (PARTITION BY key) AS first_id FROM c WHERE ts < TIMESTAMP '{CUTOFF}') WHERE n = 1),
 new AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts DESC, event_id DESC) AS n, min(event_id) OVER (PARTITION BY key) AS first_id FROM c WHERE ts >= TIMESTAMP '{CUTOFF}') WHERE n = 1)"""


def _old_new(spark, sf_dir):
    c = changes(spark, sf_dir)
    old, new = c.where(F.col("ts") < _ts(CUTOFF)), c.where(F.col("ts") >= _ts(CUTOFF))
    first = lambda df: df.groupBy("key").agg(F.min("event_id").alias("id"))
    return [lifecycle.latest(df, ["key"], "ts", "event_id").join(first(df), "key") for df in (old, new)]


@query(_STATES + " SELECT coalesce(o.key, n.key) AS key, coalesce(o.first_id, n.first_id) AS id, coalesce(n.hash, o.hash) AS hash, coalesce(n.ts, o.ts) AS modified_at, coalesce(n.kind, o.kind) AS kind FROM old o FULL JOIN new n ON o.key = n.key")
def doc_upsert_latest(spark, sf_dir):
    old, new = (df.select("key", "id", "hash", F.col("ts").alias("modified_at"), "kind") for df in _old_new(spark, sf_dir))
    return lifecycle.upsert(old, new, ["key"], ["id"])


@query(_STATES + " SELECT n.key AS key, CASE WHEN o.key IS NULL THEN 'added' WHEN o.hash = n.hash THEN 'unchanged' ELSE 'updated' END AS status FROM new n LEFT JOIN old o ON o.key = n.key")
def doc_status(spark, sf_dir):
    old, new = _old_new(spark, sf_dir)
    return lifecycle.statuses(new, old, ["key"]).select("key", "status")


@query("SELECT page_id, coalesce(nullif(trim(regexp_extract(html, '<h1>([^<]*)</h1>', 1)), ''), regexp_replace(list_extract(string_split(url, '/'), -1), '(.)[.][^.]*$', '\\1')) AS title FROM pages")
def title_extract(spark, sf_dir):
    md = F.concat(F.lit("# "), F.regexp_extract("html", "<h1>([^<]*)</h1>", 1))
    return table(spark, sf_dir, "pages").select("page_id", F.coalesce(tx.heading(md), tx.stem(F.col("url"))).alias("title"))


@query("SELECT page_id, CASE WHEN starts_with(url, 'https://') THEN substr(url, 9) ELSE list_extract(string_split(url, '/'), -1) END AS path FROM pages")
def relative_path(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", tx.relative_path(F.col("url"), F.lit("https:/")).alias("path"))


_NAMES = ("documents", "embeddings", "pages", "benchmark", "labels", "conversations", "events")


@query(" UNION ALL ".join(f"SELECT '{n}' AS name, count(*) AS n_rows FROM {n}" for n in _NAMES))
def db_check_counts(spark, sf_dir):
    return ingest.table_counts(spark, {n: table(spark, sf_dir, n) for n in _NAMES})


@query(f"WITH d AS ({DOCUMENTS_SQL}) SELECT collection, count(*) FILTER (active AND collection <> 'src3') AS n_active, count(*) FILTER (active AND collection = 'src3') AS n_deleted FROM d GROUP BY 1")
def soft_delete(spark, sf_dir):
    d = documents(spark, sf_dir).drop("doc").withColumn("deleted_at", F.lit(None).cast("timestamp_ntz"))
    out = lifecycle.soft_delete(d, F.col("collection") == "src3", _ts(NOW))
    return out.groupBy("collection").agg(F.count_if("active").alias("n_active"), F.count("deleted_at").alias("n_deleted"))


@query(f"WITH d AS ({DOCUMENTS_SQL}) SELECT collection, count(*) FILTER (active AND path ILIKE '%7.MD') AS n_suffix, count(*) FILTER (active AND path = 'notes/doc-7.md') AS n_exact FROM d GROUP BY 1")
def watch_delete_suffix(spark, sf_dir):
    d = documents(spark, sf_dir)
    d = d.withColumn("deleted_at", F.lit(None).cast("timestamp_ntz"))
    gone = [lifecycle.soft_delete(d, lifecycle.path_ends(F.col("path"), "7.MD"), _ts(NOW)), lifecycle.soft_delete(d, F.col("path") == "notes/doc-7.md", _ts(NOW))]
    counts = [df.groupBy("collection").agg(F.count("deleted_at").alias(n)) for df, n in zip(gone, ("n_suffix", "n_exact"), strict=True)]
    return counts[0].join(counts[1], "collection")


@query(f"WITH d AS ({DOCUMENTS_SQL}), o AS (SELECT DISTINCT hash FROM d WHERE NOT active AND hash NOT IN (SELECT hash FROM d WHERE active)) SELECT (SELECT count(*) FROM d WHERE NOT active) AS n_docs, (SELECT count(*) FROM o) AS n_contents, (SELECT count(DISTINCT d.hash) FROM d JOIN o ON d.hash = o.hash) AS n_chunks")
def purge_dry_run(spark, sf_dir):
    d = documents(spark, sf_dir).withColumn("deleted_at", F.when(~F.col("active"), _ts(CUTOFF)))
    content = d.select("hash").distinct()
    out = lifecycle.purge(d, content, content.select(F.col("hash").alias("content_hash")), _ts(NOW))
    counts = [out[k].agg(F.count("*").alias(n)) for k, n in (("doomed", "n_docs"), ("orphans", "n_contents"), ("doomed_chunks", "n_chunks"))]
    return counts[0].crossJoin(counts[1]).crossJoin(counts[2])  # three single rows


@query(f"WITH d AS ({DOCUMENTS_SQL}) SELECT hash, min(id) AS first_doc FROM d WHERE hash NOT IN (SELECT hash FROM d WHERE active) GROUP BY 1")
def orphan_content_anti(spark, sf_dir):
    d = documents(spark, sf_dir)
    return lifecycle.unreferenced(d.groupBy("hash").agg(F.min("id").alias("first_doc")), d.where("active"))


_LAST = f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY hash ORDER BY created_at DESC, event_id DESC) AS n FROM ({CACHE_SQL})) WHERE n = 1"


@query(f"SELECT hash, type, result, event_id FROM ({_LAST}) WHERE expires_at IS NULL OR expires_at > TIMESTAMP '{NOW}'")
def cache_lookup_ttl(spark, sf_dir):
    return lifecycle.cache_valid(lifecycle.latest(cache(spark, sf_dir), ["hash"], "created_at", "event_id"), _ts(NOW)).select("hash", "type", "result", "event_id")


@query(f"WITH c AS ({_LAST}) SELECT hash, event_id FROM c WHERE hash NOT IN (SELECT hash FROM c WHERE expires_at <= TIMESTAMP '{NOW}' ORDER BY expires_at, hash LIMIT 100)")
def cache_evict_capped(spark, sf_dir):
    return lifecycle.cache_evict(lifecycle.latest(cache(spark, sf_dir), ["hash"], "created_at", "event_id"), _ts(NOW)).select("hash", "event_id")


@query(f"SELECT hash, type, created_at, event_id FROM ({_LAST})")
def cache_replace(spark, sf_dir):
    c = cache(spark, sf_dir)
    old, new = (lifecycle.latest(x, ["hash"], "created_at", "event_id") for x in (c.where(F.col("created_at") < _ts(CUTOFF)), c.where(F.col("created_at") >= _ts(CUTOFF))))
    return lifecycle.cache_put(old, new).select("hash", "type", "created_at", "event_id")


@query(f"WITH d AS ({DOCUMENTS_SQL}) SELECT DISTINCT hash AS content_hash FROM d WHERE active AND hash NOT IN (SELECT hash FROM d WHERE collection IN ('src1', 'src2'))")
def index_staleness(spark, sf_dir):
    d = documents(spark, sf_dir).select(F.col("hash").alias("content_hash"), "collection", "active").withColumn("model", F.lit("m"))
    return lifecycle.stale(d.where("active").select("content_hash", "model").distinct(), d.where(F.col("collection").isin("src1", "src2")), ["model"]).select("content_hash")


@query(f"SELECT key, kind, event_id FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts DESC, event_id DESC) AS n FROM ({CHANGES_SQL})) WHERE n = 1")
def batch_watch_replay(spark, sf_dir):
    c = changes(spark, sf_dir).withColumnRenamed("key", "path").withColumn("collection", F.lit("events"))
    return last_changes(c).select(F.col("path").alias("key"), "kind", "event_id")


_MD = "('---' || chr(10) || 'title: ' || source || chr(10) || '---' || chr(10) || text)"


@query(f"SELECT doc_id, sha256(regexp_replace({_MD}, '^---\\n.*?\\n---\\n', '', 's')) AS body_hash, length({_MD}) - n_chars AS front_chars FROM documents")
def frontmatter_strip(spark, sf_dir):
    md = F.concat(F.lit("---\ntitle: "), F.col("source"), F.lit("\n---\n"), F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(tx.body(md), 256).alias("body_hash"), (F.length(md) - F.length(tx.body(md))).cast("long").alias("front_chars"))


@query("SELECT doc_id, seq, sha256(substr(text, seq * 1875 + 1, 2100)) AS chunk_hash FROM documents, unnest(range(0, greatest(1, (n_chars + 1874) // 1875))) u(seq)")
def chunk_text_substr(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    cut = docs.select("doc_id", "text", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(1), F.ceil(F.col("n_chars") / 1875).cast("int")) - 1)).alias("seq"))
    return cut.select("doc_id", F.col("seq").cast("long").alias("seq"), F.sha2(tx.slice_text(F.col("text"), F.col("seq") * 1875, F.lit(2100)), 256).alias("chunk_hash"))
