"""Semi-joins in which rows stay where they are, and what an index moves and writes."""

import pytest
from pyspark.sql import functions as F

from lakesift import blocks
from lakesift.blocks import forget, picked
from lakesift.functions.text import tokens
from lakesift.operators import fulltext, ingest
from lakesift.providers import HashingEmbedder
from lakesift.schema import Chunking, Settings
from lakesift.store import Store

T = "2024-05-01 10:00:00"


@pytest.mark.parametrize("most", [1 << 20, 3, 0])
@pytest.mark.parametrize("wanted", ["k % 10 = 0", "k % 10 > 0", "true", "false", "k < 10"])
def test_picked_is_a_semi_join(spark, monkeypatch, most, wanted):
    monkeypatch.setattr(blocks, "MOST_KEYS", most)
    rows = spark.range(40).selectExpr("id % 20 as k", "if(id % 20 = 7, null, concat('a', id % 20)) as name", "id as text")
    found, marks = picked(rows, rows.where(wanted).select("k", "name").unionByName(rows.limit(0).select("k", "name")), ["k", "name"])
    assert sorted(r["text"] for r in found.collect()) == sorted(r["text"] for r in rows.where(wanted).collect())
    plan = found._jdf.queryExecution().toString()
    assert most < 1 << 20 or "SortMergeJoin" not in plan.split("Physical Plan")[-1]
    forget(marks)


def test_picked_where_one_hash_stands_for_two_keys(spark, monkeypatch):
    monkeypatch.setattr(blocks.F, "xxhash64", lambda *c: F.lit(1))
    rows = spark.range(9).selectExpr("id as k", "id as text")
    found, _ = picked(rows, rows.where("k < 4").select("k"), ["k"])
    monkeypatch.undo()
    assert sorted(r["text"] for r in found.collect()) == [0, 1, 2, 3]


def test_tokens_in_tasks_are_those_of_columns(spark):
    texts = ["", None, "One  two-THREE", "É é ÀB x Y", "..", " a", "b ", "x\x00y\x7fz", "漢字 and İ K", "A" * 3]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "chunk_id long, text string").coalesce(1)
    own = {r["chunk_id"]: r["tokens"] or [] for r in fulltext.with_stems(rows.select("chunk_id", tokens(F.col("text")).alias("tokens"))).collect()}
    found = {r["chunk_id"]: (r["dl"], r["tokens"]) for r in fulltext.stems_of_texts(rows).collect()}
    assert found == {k: (len(t), t) for k, t in own.items()}


def test_postings_are_sorted_in_runs(spark):
    rows = spark.createDataFrame([(k, [f"w{(k * j) % 23}" for j in range(k % 9)]) for k in range(300)], "chunk_id long, tokens array<string>").coalesce(1)
    plain = fulltext.with_levels(fulltext.postings(rows))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 40)
    runs = fulltext.with_levels(fulltext.postings(rows, "chunk_id", None, 400))
    assert sorted(map(str, runs.collect())) == sorted(map(str, plain.collect()))
    order = [(r["term"], -r["level"]) for r in runs.collect()]
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    ends = sum(a > b for a, b in zip(order, order[1:], strict=False))
    assert 0 < ends <= len(order) // 400


def test_filling_writes_tables_once(spark, tmp_path, monkeypatch):
    """What is written besides the store's own tables is the files and chunks that come in, and nothing of the size of the postings."""
    made, own = [], ingest.materialise
    monkeypatch.setattr(ingest, "materialise", lambda df, name: made.append((name, df.columns)) or own(df, name))
    store = Store(spark, str(tmp_path / "store"))
    files = spark.createDataFrame([(f"{k}.md", "u", f"Text {k % 50} has words. " * 30) for k in range(60)], "path string, source_uri string, text string").withColumn("modified_at", F.lit(T).cast("timestamp"))
    ingest.add_documents(store, files, "default", T)
    out = ingest.index_documents(store, HashingEmbedder(), Settings(chunking=Chunking(200, 20, 10)), T)
    assert out["indexed"] == 50 and not [n for n, columns in made if "positions" in columns or "tokens" in columns]
    assert [n for n, columns in made if "text" in columns] == ["incoming", "cut"]
    assert store.table("content").count() == 50 and store.table("tokens").count() == store.table("chunks").count() == out["chunks_written"]
    again = ingest.index_documents(store, HashingEmbedder(), Settings(chunking=Chunking(300, 20, 10)), T)
    assert again["indexed"] == 50 and store.table("chunks").count() == store.table("tokens").count() == store.table("vectors").count() == again["chunks_written"]
