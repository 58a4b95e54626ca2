"""Bringing files into the store and indexing what is new."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from lakesift.blocks import forget, materialise, picked
from lakesift.functions.text import content_hash, heading, stem
from lakesift.operators import fulltext, lifecycle, statistics
from lakesift.operators.chunking import chunk_documents
from lakesift.providers import Embedder, embed_rows, loaded
from lakesift.schema import COLLECTIONS, Settings
from lakesift.sources.files import many_files, qualified, read_files, write_file
from lakesift.store import Store


@F.pandas_udf(StructType([StructField("title", StringType()), StructField("metadata", StringType())]))
def _front_matter(texts: pd.Series) -> pd.DataFrame:
    """Title and JSON of YAML front matter; nulls where there is none, or it isn't a mapping."""
    import yaml

    def one(text: str | None) -> tuple[str | None, str | None]:
        if not text or not text.startswith("---\n") or "\n---\n" not in text[3:]:
            return None, None
        try:
            found = yaml.safe_load(text[4:text.index("\n---\n", 3) + 1])
        except yaml.YAMLError:
            return None, None
        if not isinstance(found, dict) or not found:
            return None, None
        return str(found["title"]) if found.get("title") else None, json.dumps(found, default=str)

    return pd.DataFrame([one(t) for t in texts], columns=["title", "metadata"])


def described(files: DataFrame) -> DataFrame:
    """path, text, ... with hash, title and metadata. Only texts that begin with front matter meet Python."""
    front = F.when(F.startswith("text", F.lit("---\n")), _front_matter("text"))
    found = files.withColumn("__front", front)
    title = F.coalesce(F.col("__front.title"), heading(F.col("text")), stem(F.col("path")))
    return found.withColumns({"hash": content_hash(F.col("text")), "title": title, "metadata": F.col("__front.metadata")}).drop("__front")


def add_documents(store: Store, files: DataFrame, collection: str, now: str) -> dict[str, int]:
    """Merge ``files`` (path, text, source_uri, modified_at) into a collection; counts by status.

    Of repeated paths the latest file counts. A collection has to be registered, but ``default``, which is made. What is
    written follows what comes in, not what is there: new texts, and the rows of the documents that came.
    """
    names = {r["name"] for r in store.table("store_collections").select("name").collect()}
    changed, work = {}, []
    if collection not in names:
        if collection != "default":
            raise ValueError(f"no collection {collection}")
        changed["store_collections"] = collection_rows(store, "default", "", "**/*.md", True)
    stamp = F.lit(now).cast("timestamp")
    # texts are written where they are read, and looked up when it is known which are new: what moves until then are their hashes
    read = held = materialise(described(files), "incoming")
    twice = materialise(held.groupBy("path").agg(F.count("*").alias("n")).where("n > 1").select(F.col("path").alias("__twice")), "twice")
    if twice.head(1):
        same = F.col("path").eqNullSafe(F.col("__twice"))
        read = held.join(twice, same, "left_anti").unionByName(lifecycle.latest(held.join(twice, same, "left_semi"), ["path"], "modified_at", "text"))
    incoming = read.drop("text").withColumns({"collection": F.lit(collection), "active": F.lit(True), "deleted_at": F.lit(None).cast("timestamp"), "created_at": stamp})
    existing = store.table("documents")
    marked = lifecycle.statuses(incoming, existing, ["collection", "path"]).persist()
    try:
        counts = {r["status"]: r["count"] for r in marked.groupBy("status").count().collect()}
        if not counts:
            return {"added": 0, "updated": 0, "unchanged": 0}
        first = marked.groupBy("hash").agg(F.min("path").alias("__path")).join(store.table("content").select("hash"), "hash", "left_anti").withColumnRenamed("__path", "path")
        texts, marks = picked(read.select("hash", "path", "text"), first, ["hash", "path"])
        work.append(marks)
        fresh = texts.select("hash", F.col("text").alias("doc"), stamp.alias("created_at"))
        new = marked.select("collection", "path", "title", "hash", "metadata", "active", "deleted_at", "created_at", "modified_at", "source_uri").withColumn("id", F.xxhash64("collection", "path"))
        # rows that are held just so stay where they are
        new = new.join(existing.where("active").select("collection", "path", "hash", "modified_at"), ["collection", "path", "hash", "modified_at"], "left_anti")
        before = existing.join(new.select("collection", "path"), ["collection", "path"], "left_semi")
        merged = lifecycle.upsert(before, new, ["collection", "path"], ["id", "created_at"])
        after = existing.where("active").join(before.select("id"), "id", "left_anti").select("hash").unionByName(new.select("hash"))
        rows, gone = statistics.of_change(store, before.select("hash").unionByName(new.select("hash")), after)
        store.append(changed | {"content": fresh, "documents": merged} | rows, {"documents": before.select("id")} | gone)
    finally:
        marked.unpersist()
        forget(held, twice, *work)
    return {s: counts.get(s, 0) for s in ("added", "updated", "unchanged")}


def vectors_of_chunks(store: Store, chunks: DataFrame, model: Embedder | Callable[[], Embedder], batch: int = 64) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(vectors, fresh, digests): chunk_id, model, embedding, digest of each of ``chunks`` (chunk_id, text); digest, embedding of those
    texts that the model was asked for; chunk_id, digest. The last two are written tables, which ``vectors`` reads.

    Equal texts are embedded once, and those that the store has a vector of by this model not at all. Both are found by digests, and
    texts are embedded where they are read (``picked``). A null text counts as an empty one.
    """
    name = loaded(model).name
    places = chunks.select("chunk_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("digest", F.sha2("text", 256))
    digests = materialise(places.select("chunk_id", "digest"), "digests")
    first = digests.groupBy("digest").agg(F.min("chunk_id").alias("chunk_id"))
    held = store.table("vectors").where((F.col("model") == name) & F.col("digest").isNotNull()).join(first.select("digest"), "digest", "left_semi")
    known = held.groupBy("digest").agg(F.min_by("embedding", "chunk_id").alias("embedding"))
    todo = first.join(held.select("digest"), "digest", "left_anti")
    asked, marks = picked(places, todo, ["chunk_id"])  # one row of each text
    fresh = materialise(embed_rows(asked, model, key="digest", batch=batch).select("digest", "embedding"), "fresh")
    forget(marks)
    found = digests.join(known.unionByName(fresh), "digest")
    return found.select("chunk_id", F.lit(name).alias("model"), "embedding", "digest"), fresh, digests


def index_documents(store: Store, model: Embedder | Callable[[], Embedder], settings: Settings, now: str, doc_id: int | None = None) -> dict[str, int]:
    """Chunk, tokenise and embed each different active text that isn't indexed with this model and these sizes.

    Texts that give no chunk are kept as indexed too. Tokens are stems. Of a text that was edited only chunks with new
    texts are embedded: ``embedded`` counts the texts that the model was asked for.
    """
    c = settings.chunking
    params = f"{c.target_chars}/{c.overlap_chars}/{c.min_chars}"
    name = loaded(model).name  # the one that its vectors carry, also where a function makes the model
    documents = store.table("documents")
    wanted = documents.where("active" if doc_id is None else F.col("id") == doc_id).select(F.col("hash").alias("content_hash")).distinct().withColumns({"model": F.lit(name), "params": F.lit(params)})
    todo = lifecycle.stale(wanted, store.table("indexed"), ["model", "params"]).select("content_hash").persist()
    try:
        total, done = wanted.count(), todo.count()
        if not done:
            return {"indexed": 0, "skipped": total, "chunks_written": 0, "embedded": 0}
        stamp = {"model": F.lit(name), "params": F.lit(params), "embedded_at": F.lit(now).cast("timestamp")}
        texts, marks = picked(store.table("content").select(F.col("hash").alias("content_hash"), "doc"), todo, ["content_hash"])
        cut = chunk_documents(texts, target=c.target_chars, overlap=c.overlap_chars, least=c.min_chars, cut=True)
        # texts are read and cut once, where they are; their tokens, postings and vectors are made of what is written here
        new = materialise(cut.withColumn("chunk_id", F.xxhash64("content_hash", "seq")), "cut")
        forget(marks)
        replaced = store.table("chunks").join(todo, "content_hash", "left_semi").select("chunk_id").persist()
        had = replaced.limit(1).count() > 0
        # what the chunks that go were counted for is taken away again
        counted = store.table("chunks").join(todo.join(store.table("counted"), "content_hash", "left_semi"), "content_hash", "left_semi").select("chunk_id")
        less = materialise(statistics.term_counts(store.table("tokens").join(counted, "chunk_id", "left_semi"), -1), "less") if had else None
        words = store.draft("tokens", fulltext.stems_of_texts(new))
        index = store.draft("postings", fulltext.with_levels(fulltext.postings(words.rows, "chunk_id", None, fulltext.RUN)))
        counted = todo.join(new.groupBy("content_hash").agg(F.count("*").alias("n_chunks")), "content_hash", "left").fillna(0, ["n_chunks"]).withColumns(stamp)
        if doc_id is None:  # all texts are of active documents
            live, more = todo, statistics.term_counts(words.rows, index=index.rows)
        else:
            live = todo.join(documents.where("active").select(F.col("hash").alias("content_hash")), "content_hash", "left_semi")
            of_live = new.join(live, "content_hash", "left_semi").select("chunk_id")
            more = statistics.term_counts(words.rows.join(of_live, "chunk_id", "left_semi"))
        more = more if less is None else more.unionByName(less)
        vectors, fresh, digests = vectors_of_chunks(store, new.select("chunk_id", "text"), model, settings.embedding.batch)
        written = {"chunks": new.drop("text").withColumns(stamp), "vectors": vectors, "tokens": words, "postings": index, "indexed": counted,
                   "statistics": more.sortWithinPartitions("term", "level"), "counted": live}
        if doc_id is not None:  # a document that isn't active can be indexed by its id
            written["dead"] = new.join(live, "content_hash", "left_anti").select("chunk_id")
        store.append(written, ({k: replaced for k in ("chunks", "vectors", "tokens", "postings", "dead")} if had else {}) | {"indexed": todo} | ({"counted": todo} if had else {}))
        replaced.unpersist()
        out = {"indexed": done, "skipped": total - done, "chunks_written": digests.count(), "embedded": fresh.count()}
        forget(new, fresh, digests, *([] if less is None else [less]))
        return out
    finally:
        todo.unpersist()


def collection_rows(store: Store, name: str, path: str, pattern: str, include_by_default: bool, ignore: list[str] | None = None, context: dict[str, str] | None = None) -> DataFrame:
    return store.spark.createDataFrame([(name, path, pattern, ignore or [], include_by_default, None, context or {})], COLLECTIONS)


def register_collection(store: Store, name: str, path: str, pattern: str = "**/*.md", include_by_default: bool = True, ignore: list[str] | None = None, context: dict[str, str] | None = None) -> bool:
    """Add a collection; False where the name is taken. The path has to exist. Files that fit a pattern of ``ignore`` are not read."""
    where = store._jvm_path(path)
    if not where.getFileSystem(store.spark._jsc.hadoopConfiguration()).exists(where):
        raise ValueError(f"no folder {path}")
    if store.table("store_collections").where(F.col("name") == name).limit(1).count():
        return False
    store.append({"store_collections": collection_rows(store, name, path, pattern, include_by_default, ignore, context)})
    return True


def update_collection(store: Store, name: str, now: str) -> dict[str, int]:
    """Read a collection's files again by its whole pattern; files that went are not deactivated."""
    rows = store.table("store_collections").where(F.col("name") == name).collect()
    if not rows:
        raise ValueError(f"no collection {name}")
    with many_files(store.spark):
        return add_documents(store, read_files(store.spark, rows[0]["path"], rows[0]["pattern"], rows[0]["ignore_patterns"] or []), name, now)


def copy_to_vault(store: Store, collection: str, folder: str) -> DataFrame:
    """path and copied_to of a collection's active documents, whose texts are written below ``folder`` by their paths.

    Tasks write the files, each under a draft name first; a path that isn't below the collection's root can't be in it.
    """
    own = store.table("documents").where("active").where(F.col("collection") == collection).join(store.table("content").select("hash", "doc"), "hash").select("path", "doc")
    target = qualified(store.spark, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths = batch.column(0).to_pylist()
            done = [write_file(f"{target}/{p}", t.encode()) for p, t in zip(paths, batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(paths), pa.array(done)], ["path", "copied_to"])

    return materialise(own.mapInArrow(run, "path string, copied_to string"), "vault")


def _deactivate(store: Store, hit: DataFrame, now: str) -> int:
    """Mark the active documents of ``hit`` as deleted: their rows are written again, the others stay where they are."""
    hit = hit.where("active").persist()
    try:
        n = hit.count()
        if n:
            after = store.table("documents").where("active").join(hit.select("id"), "id", "left_anti")
            rows, gone = statistics.of_change(store, hit.select("hash"), after.select("hash"))
            store.append({"documents": lifecycle.soft_delete(hit, F.lit(True), F.lit(now).cast("timestamp"))} | rows, {"documents": hit.select("id")} | gone)
        return n
    finally:
        hit.unpersist()


def remove(store: Store, path: str, now: str, collection: str | None = None) -> int:
    """Deactivate a document by its path, in all collections where none is given; how many there were."""
    where = (F.col("path") == path) & (F.lit(True) if collection is None else F.col("collection") == collection)
    return _deactivate(store, store.table("documents").where(where), now)


def remove_all(store: Store, keys: DataFrame, now: str) -> int:
    """Deactivate the documents of ``keys`` (collection, path); how many there were."""
    return _deactivate(store, store.table("documents").join(keys, ["collection", "path"], "left_semi"), now)


def purge(store: Store, before: str, dry_run: bool = False, keep_versions: int = 1) -> tuple[int, int, int]:
    """Drop documents deactivated before a time, with contents, chunks, vectors and tokens that only they use; their counts.

    Their tables are put together anew, and all versions but the last ``keep_versions`` go, so that with 1 the texts are no longer on disk.
    """
    out = lifecycle.purge(store.table("documents"), store.table("content"), store.table("chunks"), F.lit(before).cast("timestamp"))
    counts = tuple(out[k].count() for k in ("doomed", "doomed_chunks", "orphans"))
    if not dry_run and counts[0]:
        chunks = materialise(out["doomed_chunks"].select("chunk_id"), "doomed-chunks")
        texts = materialise(out["orphans"].select("hash"), "orphans")
        documents = materialise(out["doomed"].select("id"), "doomed")
        store.append(gone={"documents": documents, "content": texts, "indexed": texts.withColumnRenamed("hash", "content_hash")} | {k: chunks for k in ("chunks", "vectors", "tokens", "postings", "dead")})
        store.compact("documents", "content", "indexed", "chunks", "vectors", "tokens", "postings", "statistics", "dead")
        store.vacuum(keep_versions)
    return counts


def registry(collections: DataFrame, documents: DataFrame) -> DataFrame:
    """The registered collections with the number of their active documents, by name."""
    own = documents.where("active").groupBy(F.col("collection").alias("__name")).agg(F.count("*").alias("n_documents"))
    return collections.join(own, F.col("name") == F.col("__name"), "left").drop("__name").fillna(0, ["n_documents"]).orderBy("name")


def table_counts(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """name and rows of each table."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("name"), "n_rows")
        out = one if out is None else out.unionAll(one)
    return out
