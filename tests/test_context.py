"""Contexts are cut from contents, and files are written from a store without an index."""

from pyspark.sql import functions as F

from lakesift.operators import ingest, retrieval
from lakesift.plans import corpus_queries

SF = "/root/testdata/sf0.001"


def test_contexts_are_those_of_a_window(spark):
    store = corpus_queries.filled(spark, SF)
    own = store.table("chunks").join(store.table("content"), F.col("content_hash") == F.col("hash")).select("content_hash", "seq", F.substring("doc", F.col("pos") + 1, F.col("len")).alias("text"))
    wanted = {(r["content_hash"], r["seq"]): r["context"] for r in retrieval.windowed_context(own, "content_hash", "seq", "text").collect()}
    results = own.select("content_hash", "seq", F.lit(1).alias("n")).unionByName(own.select("content_hash", "seq", F.lit(2).alias("n")))
    found = retrieval.with_context(results, store.table("chunks"), store.table("content"))
    assert found.columns == ["content_hash", "seq", "n", "context"]
    rows = [((r["content_hash"], r["seq"]), r["n"], r["context"]) for r in found.collect()]
    assert len(rows) == 2 * len(wanted) and all(wanted[k] == c for k, _, c in rows) and {(k, n) for k, n, _ in rows} == {(k, n) for k in wanted for n in (1, 2)}


def test_the_vault_needs_no_index(spark, monkeypatch):
    monkeypatch.setattr(ingest, "index_documents", lambda *a, **k: 1 / 0)
    corpus_queries._added.cache_clear()
    corpus_queries._filled.cache_clear()
    found = corpus_queries.QUERIES["vault_files"](spark, SF)
    n = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id % 10 = 7 and source like 'src1%' and not startswith(source, 'src12')").count()
    assert found.count() == n > 0
    monkeypatch.undo()
    # the store of the vault is the one that is indexed then
    assert corpus_queries.filled(spark, SF).path == corpus_queries.added(spark, SF).path
