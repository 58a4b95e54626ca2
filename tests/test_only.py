"""Searches that are about some documents or chunks only."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from lakesift import cli
from lakesift.operators import ingest, search
from lakesift.providers import HashingEmbedder
from lakesift.schema import Chunking, Search, Settings
from lakesift.store import Store

T = "2024-05-01 10:00:00"
SETTINGS = Settings(chunking=Chunking(200, 20, 5), search=Search(bm25_gap=2.0))
TEXTS = {
    "a.md": ("---\nauthor:\n  name: Ann\ntags: [red, blue]\nyear: 2020\n---\n# A\n\nA fox in the text.\n", "2024-01-01"),
    "b.md": ("---\nauthor:\n  name: Bob\ntags: [blue]\n---\n# B\n\nAnother fox in a text.\n", "2024-03-01"),
    "c.md": ("# C\n\nA fox without front matter.\n", "2024-04-01"),
    "d.md": ("# D\n\n```python\ndef fox():\n    return 'fox'\n```\n", "2024-02-01"),
}


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    own = Store(spark, str(tmp_path_factory.mktemp("only") / "store"))
    files = spark.createDataFrame([(p, t, "x", d) for p, (t, d) in TEXTS.items()], "path string, text string, source_uri string, at string").select("path", "text", "source_uri", F.col("at").cast("timestamp").alias("modified_at"))
    ingest.add_documents(own, files, "default", T)
    ingest.index_documents(own, HashingEmbedder(), SETTINGS, T)
    return own


def found(store, only):
    """Documents by their paths, from chunks, from one search and from the plan of many."""
    path = {r["id"]: r["path"] for r in store.table("documents").collect()}
    chunks = {path[r["doc_id"]] for r in search.chunks_of(store, only=only).collect()}
    one = {path[r["doc_id"]] for r in search.search(store, "fox", HashingEmbedder(), T, SETTINGS, count=9, only=only)}
    many = {path[r["doc_id"]] for r in search.search_many(store, store.spark.createDataFrame([(1, "fox")], "query_id long, query string"), HashingEmbedder(), SETTINGS, count=9, only=only).collect()}
    assert one == many == chunks
    return "".join(sorted(p[0] for p in one))


@pytest.mark.parametrize("only, expected", [
    (search.Only(fields=(("year", "2020"), ("tags", "red"))), "a"), (search.Only(since="2024-02-01", fields=(("tags", "blue"),)), "b"), (search.Only(language="Python"), "d"), (search.Only(fields=(("none.there", "x"),)), ""),
])
def test_only(store, only, expected):
    assert found(store, only) == expected


def test_documents_by_paths(store):
    for only, expected in ((search.Only(fields=(("author.name", "Bob"),)), "b"), (search.Only(fields=(("tags", "blue"),)), "ab"), (search.Only(since="2024-03-01"), "bc"), (search.Only(fields=(("author", "Ann"),)), "")):
        assert "".join(sorted(r["path"][0] for r in only.documents(store.table("documents")).collect())) == expected


def test_options():
    read = lambda *a: cli.only_of(cli.parser().parse_args(["--store", "s", "search", "q", *a]), datetime(2024, 5, 10))
    assert read() == search.Only()
    assert read("--since", "3d", "--field", "a.b=c=d", "--field", "t=1", "--language", "go") == search.Only("2024-05-07 00:00:00", "go", (("a.b", "c=d"), ("t", "1")))
    assert read("--since", "2024-01-02").since == "2024-01-02 00:00:00"
    with pytest.raises(ValueError, match="PATH=VALUE"):
        read("--field", "x")
