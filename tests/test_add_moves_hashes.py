"""Adding documents: hashes are compared, and texts looked up only where they are new."""

from lakesift.operators import ingest, lifecycle
from lakesift.store import Store


def files(spark, *rows):
    return spark.createDataFrame([(p, f"file:{p}", t, at) for p, t, at in rows], "path string, source_uri string, text string, modified_at string").selectExpr("path", "source_uri", "text", "cast(modified_at as timestamp) as modified_at")


def held(store):
    return {r["path"]: r["doc"] for r in store.table("documents").where("active").join(store.table("content"), "hash").collect()}


def test_texts_are_no_part_of_the_comparison(spark, tmp_path, monkeypatch):
    seen = []
    compared = lifecycle.statuses
    monkeypatch.setattr(lifecycle, "statuses", lambda incoming, *a, **k: seen.append(incoming.columns) or compared(incoming, *a, **k))
    store = Store(spark, str(tmp_path / "s"))
    assert ingest.add_documents(store, files(spark, ("a.md", "one", "2024-01-01"), ("b.md", "one", "2024-01-01"), ("c.md", "two", "2024-01-01")), "default", "2024-01-02 00:00:00") == {"added": 3, "updated": 0, "unchanged": 0}
    assert held(store) == {"a.md": "one", "b.md": "one", "c.md": "two"} and store.table("content").count() == 2
    assert seen and "text" not in seen[0]


def test_of_repeated_paths_the_latest_counts(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    rows = [("a.md", "old", "2024-01-01"), ("a.md", "new", "2024-01-03"), ("a.md", "mid", "2024-01-02"), ("b.md", "x", "2024-01-01"), ("b.md", "y", "2024-01-01"), ("c.md", "c", "2024-01-01")]
    assert ingest.add_documents(store, files(spark, *rows), "default", "2024-01-02 00:00:00")["added"] == 3
    assert held(store) == {"a.md": "new", "b.md": "y", "c.md": "c"} and store.table("content").count() == 3
    assert ingest.add_documents(store, files(spark, ("a.md", "new", "2024-01-03"), ("c.md", "d", "2024-01-04")), "default", "2024-01-05 00:00:00") == {"added": 0, "updated": 1, "unchanged": 1}
    assert held(store) == {"a.md": "new", "b.md": "y", "c.md": "d"} and store.table("content").count() == 4
