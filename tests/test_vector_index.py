"""The inverted file against exact distances: recall, every row held, and what is exact."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakesift.operators import ingest, retrieval, search, vector_index
from lakesift.operators.vector_index import VectorIndex
from lakesift.providers import HashingEmbedder
from lakesift.schema import Chunking, Search, Settings
from lakesift.store import Store

T = "2024-05-01 10:00:00"


def table(spark, data):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(data)], "chunk_id long, embedding array<float>")


def recall(found, exact):
    pairs = {(r["query_id"], r["chunk_id"]) for r in exact.collect()}
    return len(pairs & {(r["query_id"], r["chunk_id"]) for r in found.collect()}) / len(pairs)


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall_on_given_tables(spark, sf):
    vectors = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").withColumnRenamed("vec_id", "chunk_id")
    queries = vectors.where("chunk_id % 50 = 0").select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    own = VectorIndex.build(vectors)
    assert own.codes().select("chunk_id").distinct().count() == own.codes().count() == vectors.count()
    assert recall(own.nearest(vectors, queries, 10), retrieval.nearest_of_many(vectors, queries, 10)) >= 0.95


def test_recall_on_clusters(spark):
    """Many clusters, queries that are no rows, an odd width, and a hot cluster with a third of all rows."""
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(40, 21))
    which = np.where(rng.random(3000) < 0.33, 0, rng.integers(0, 40, 3000))
    vectors = table(spark, centres[which] + 0.3 * rng.normal(size=(3000, 21)))
    asked = centres[rng.integers(0, 40, 50)] + 0.3 * rng.normal(size=(50, 21))
    queries = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(asked)], "query_id long, query_vector array<double>")
    own = VectorIndex.build(vectors, parts=7)
    exact = retrieval.nearest_of_many(vectors, queries, 10)
    assert recall(own.nearest(vectors, queries, 10, refine=30), exact) >= 0.95 and own.quantiser().probes < len(own.quantiser().centres) // 2
    assert recall(own.nearest(vectors, queries, 10, probes=1, refine=5), exact) < 1.0  # fewer lists find less
    everything = own.nearest(vectors, queries, 10, probes=len(own.quantiser().centres), refine=300)
    assert sorted((r["query_id"], r["rank"], r["chunk_id"]) for r in everything.collect()) == sorted((r["query_id"], r["rank"], r["chunk_id"]) for r in exact.collect())


def test_ties_nulls_and_few_rows(spark):
    rows = [(i, [1.0, 0.0, 0.0]) for i in range(20)] + [(20, None), (21, [0.0, 1.0, 0.0])]
    vectors = spark.createDataFrame(rows, "chunk_id long, embedding array<float>")
    queries = spark.createDataFrame([(1, [1.0, 0.0, 0.0]), (2, None)], "query_id long, query_vector array<float>")
    own = VectorIndex.build(vectors)
    assert own.codes().count() == 21
    assert [(r["query_id"], r["chunk_id"]) for r in own.nearest(vectors, queries, 3, probes=9).orderBy("rank").collect()] == [(1, 0), (1, 1), (1, 2)]
    assert own.nearest(vectors, queries.where("false"), 3).count() == 0
    assert own.nearest(vectors.where("chunk_id > 17"), queries, 3, probes=9).count() == 3  # only rows that are asked for
    with pytest.raises(Exception, match="width"):
        own.nearest(vectors, spark.createDataFrame([(1, [1.0])], "query_id long, query_vector array<float>"), 3).count()
    with pytest.raises(ValueError, match="no vectors"):
        VectorIndex.build(vectors.where("false"))


def test_fitting_is_bounded(spark):
    """The sample holds no more rows than its bound, and equal samples give equal quantisers."""
    vectors = table(spark, np.random.default_rng(2).normal(size=(500, 8)))
    one, two = (vector_index.fit(vectors.repartition(n), parts=4, sample_rows=60) for n in (1, 3))
    assert len(one.centres) == 22 and one.words.shape == (4, 60, 2) and np.array_equal(one.centres, two.centres) and np.array_equal(one.words, two.words)


def test_search_by_the_index_of_the_store(spark, tmp_path):
    store, settings = Store(spark, str(tmp_path / "store")), Settings(chunking=Chunking(120, 10, 5), search=Search(probes=-1, bm25_gap=2.0))
    rows = [(f"{k}.md", f"Note {k} about {'foxes' if k % 2 else 'rivers'} and stone number {k}.", "x") for k in range(30)]
    files = spark.createDataFrame(rows, "path string, text string, source_uri string").withColumn("modified_at", F.lit(T).cast("timestamp"))
    ingest.add_documents(store, files, "default", T)
    ingest.index_documents(store, HashingEmbedder(), settings, T)
    found, exact = ([(r["chunk_id"], r["vector_rank"]) for r in search.search(store, "rivers and stone", HashingEmbedder(), T, s, count=4)] for s in (settings, Settings(chunking=settings.chunking, search=Search(bm25_gap=2.0))))
    assert {c for c, _ in found} & {c for c, _ in exact} and search.vector_index(store, "hashing-64").codes().count() == 30
    ingest.add_documents(store, files.limit(1).withColumn("text", F.lit("A new text.")).withColumn("path", F.lit("new.md")), "default", T)
    ingest.index_documents(store, HashingEmbedder(), settings, T)
    assert search.vector_index(store, "hashing-64").codes().count() == 31


def test_what_is_measured_stays_in_the_tasks(spark, monkeypatch):
    """However many vectors are measured, the k nearest of each query are all that a task gives away."""
    from lakesift.operators import vector_index

    rng = np.random.default_rng(5)
    data = rng.normal(size=(300, 4)).astype(np.float32)
    vectors = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(data)], "chunk_id long, embedding array<float>")
    queries = spark.createDataFrame([(q, [float(x) for x in data[q]]) for q in range(3)], "query_id long, query_vector array<float>")
    given, own = [], vector_index.by_blocks

    def counted(*a):
        found = own(*a)
        given.append((found.count(), len(found.inputFiles())))
        return found

    monkeypatch.setattr(vector_index, "by_blocks", counted)
    wanted = {(q, r, int(c)) for q in range(3) for r, c in enumerate(np.lexsort((np.arange(300), ((data.astype(float) - data[q].astype(float)) ** 2).sum(1)))[:5], 1)}
    index = VectorIndex.build(vectors, lists=4, parts=2)
    for most in (10_000, 10):  # by code, and all
        monkeypatch.setattr(vector_index, "BY_CODE", most)
        found = index.nearest(vectors, queries, 5, probes=4, refine=60)
        assert {(r["query_id"], r["rank"], r["chunk_id"]) for r in found.collect()} == wanted
    assert all(n <= 3 * 5 * max(files, 1) for n, files in given)
