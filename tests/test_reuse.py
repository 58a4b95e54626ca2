"""Chunks whose texts the store has vectors of aren't embedded again."""

import pytest
from pyspark.sql import functions as F

from lakesift.operators import ingest
from lakesift.providers import HashingEmbedder
from lakesift.schema import Chunking, Settings
from lakesift.store import Store

T, LATER = "2024-05-01 10:00:00", "2024-06-01 10:00:00"
SETTINGS = Settings(chunking=Chunking(200, 20, 10))
PARTS = [f"Paragraph {k} tells of things {k * 7} and of others, at some length, so that it is cut alone. " + f"word{k} " * 12 + "\n\n" for k in range(8)]


def files(spark, *rows):
    return spark.createDataFrame([(p, "u", t, T) for p, t in rows], "path string, source_uri string, text string, modified_at string").withColumn("modified_at", F.col("modified_at").cast("timestamp"))


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "store"))


def test_an_edit_embeds_what_it_changed(spark, store):
    class Marked(HashingEmbedder):
        def vectors(self, texts):
            return super().vectors(texts) + 10

    ingest.add_documents(store, files(spark, ("a.md", "".join(PARTS)), ("copy.md", "".join(PARTS)), ("b.md", PARTS[0] + "Other words follow.")), "default", T)
    first = ingest.index_documents(store, HashingEmbedder(), SETTINGS, T)
    assert first["indexed"] == 2 and first["embedded"] <= first["chunks_written"]
    edited = "".join(PARTS[:7]) + PARTS[7].replace("word7 ", "new7 ")
    ingest.add_documents(store, files(spark, ("a.md", edited)), "default", LATER)
    again = ingest.index_documents(store, Marked(), SETTINGS, LATER)
    assert again["indexed"] == 1 and 0 < again["embedded"] < again["chunks_written"]
    marked = store.table("vectors").where(F.array_max("embedding") > 5)
    assert marked.select("digest").distinct().count() == again["embedded"]
    # every chunk has one vector, of the digest of its text
    chunks = store.table("chunks").join(store.table("content"), F.col("hash") == F.col("content_hash")).select("chunk_id", F.sha2(F.substring("doc", F.col("pos") + 1, F.col("len")), 256).alias("digest"))
    assert chunks.count() == store.table("vectors").count() == store.table("vectors").join(chunks, ["chunk_id", "digest"]).count()


def test_other_models_and_old_vectors_are_not_reused(spark, store):
    ingest.add_documents(store, files(spark, ("a.md", PARTS[0])), "default", T)
    ingest.index_documents(store, HashingEmbedder(), SETTINGS, T)
    other = ingest.index_documents(store, HashingEmbedder(32), SETTINGS, LATER)
    assert other["embedded"] == other["chunks_written"] > 0
    assert {len(r["embedding"]) for r in store.table("vectors").collect()} == {32}
    # vectors from before there were digests
    rows = store.table("vectors").withColumn("digest", F.lit(None).cast("string"))
    store.append({"vectors": rows}, {"vectors": rows.select("chunk_id")})
    ingest.add_documents(store, files(spark, ("b.md", PARTS[0] + " ")), "default", LATER)
    assert ingest.index_documents(store, HashingEmbedder(32), SETTINGS, LATER)["embedded"] > 0


def test_equal_chunks_of_one_batch_and_nulls(spark, store):
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(["same", "same", "same", "other", None, ""])], "chunk_id long, text string")
    found, fresh, _ = ingest.vectors_of_chunks(store, rows, HashingEmbedder())
    assert fresh.count() == 3 and found.count() == 6
    assert found.where("size(embedding) = 64").select("chunk_id").distinct().count() == 6
    empty, none, _ = ingest.vectors_of_chunks(store, rows.where("false"), HashingEmbedder())
    assert empty.count() == none.count() == 0


def test_indexing_makes_the_postings_once(spark, store, monkeypatch):
    from lakesift.operators import fulltext

    made, own = [], fulltext.postings
    monkeypatch.setattr(fulltext, "postings", lambda *a: made.append(1) or own(*a))
    ingest.add_documents(store, files(spark, ("a.md", PARTS[0])), "default", T)
    ingest.index_documents(store, HashingEmbedder(), SETTINGS, T)
    assert len(made) == 1  # for the index and its statistics
    posted = store.table("postings").groupBy("term", "level").agg(F.count("*").alias("n")).collect()
    assert {(r["term"], r["level"]): r["n"] for r in posted} == {(r["term"], r["level"]): r["n_docs"] for r in store.table("statistics").where("term != ''").collect()}
