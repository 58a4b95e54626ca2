import json

import pytest

from lakesift import cli
from lakesift.operators import ingest, lifecycle, search
from lakesift.providers import CannedWriter, Embedder, HashingEmbedder
from lakesift.schema import Chunking, Search, Settings
from lakesift.sources.files import read_files
from lakesift.store import Store
from lakesift.streaming.watch import watch

T = "2024-05-01 10:00:00"
LATER = "2024-06-01 10:00:00"
SETTINGS = Settings(chunking=Chunking(200, 20, 5))
NEVER_EARLY = Settings(chunking=Chunking(200, 20, 5), search=Search(bm25_gap=2.0, bm25_threshold=2.0))


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "store"))


@pytest.fixture
def notes(tmp_path):
    folder = tmp_path / "notes"
    (folder / "sub").mkdir(parents=True)
    (folder / "a.md").write_text("---\ntitle: Alpha\ndate: 2024-01-01\n---\n# Other\n\nToken validation of web requests.\n")
    (folder / "sub" / "b.md").write_bytes(b"# Beta\r\n\r\nThe quick brown fox jumps over the lazy dog.\r\n")
    (folder / "c.md").write_text("no heading here, but a fox and a token")
    (folder / "skip.txt").write_text("not read")
    return str(folder)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_life_of_documents(spark, store, notes, tmp_path):
    assert ingest.register_collection(store, "notes", notes) and not ingest.register_collection(store, "notes", notes)
    with pytest.raises(ValueError):
        ingest.register_collection(store, "x", notes + "/none")
    assert ingest.update_collection(store, "notes", T) == {"added": 3, "updated": 0, "unchanged": 0}
    assert rows(store.table("documents").select("path", "title")) == [("a.md", "Alpha"), ("c.md", "c"), ("sub/b.md", "Beta")]
    assert "\r" not in store.table("content").where("doc like '# Beta%'").head()["doc"]
    embedder = HashingEmbedder()
    assert isinstance(embedder, Embedder)
    assert ingest.index_documents(store, embedder, SETTINGS, T)["indexed"] == 3
    assert ingest.index_documents(store, embedder, SETTINGS, T) == {"indexed": 0, "skipped": 3, "chunks_written": 0, "embedded": 0}
    (tmp_path / "notes" / "c.md").write_text("now a different text about foxes and tokens")
    before = store.table("documents").where("path = 'c.md'").head()
    assert ingest.update_collection(store, "notes", LATER) == {"added": 0, "updated": 1, "unchanged": 2}
    after = store.table("documents").where("path = 'c.md'").head()
    assert (after["id"], after["created_at"]) == (before["id"], before["created_at"]) and after["hash"] != before["hash"]
    assert ingest.remove(store, "a.md", T, "notes") == 1 and ingest.remove(store, "a.md", T, "notes") == 0
    assert ingest.purge(store, LATER, dry_run=True)[0] == 1
    docs, chunks, contents = ingest.purge(store, LATER)
    assert (docs, contents) == (1, 1) and chunks >= 1
    assert store.table("documents").count() == 2 and ingest.purge(store, LATER) == (0, 0, 0)
    assert ingest.update_collection(store, "notes", LATER)["added"] == 1
    with pytest.raises(ValueError):
        ingest.add_documents(store, read_files(spark, notes), "unknown", T)
    assert ingest.add_documents(store, read_files(spark, notes), "default", T)["added"] == 3
    assert rows(lifecycle.unreferenced(store.table("content"), store.table("documents")).select("created_at")) != []


def test_search(store, spark, notes):
    ingest.add_documents(store, read_files(spark, notes), "default", T)
    ingest.index_documents(store, HashingEmbedder(), SETTINGS, T)
    seen = []
    found = search.search(store, "quick brown", HashingEmbedder(), T, SETTINGS, log=lambda k, v: seen.append(k))
    assert found[0]["title"] == "Beta" and "early" in seen
    full = search.search(store, "fox", HashingEmbedder(), T, NEVER_EARLY, model=CannedWriter({"fox": "lazy dog\nbrown \"fox\""}), count=3)
    assert {r["title"] for r in full} >= {"Beta", "c"} and all(r["context"] for r in full)
    seen.clear()
    assert search.search(store, "fox", HashingEmbedder(), T, NEVER_EARLY, model=CannedWriter(), count=3, log=lambda k, v: seen.append(k)) == full and seen == ["cache"]
    assert search.search(store, "what is a fox?", HashingEmbedder(), T, NEVER_EARLY, model=CannedWriter({"Question": "A fox jumps."}), reranker=False, count=2)
    assert search.search(store, "nothingness", HashingEmbedder(), T, NEVER_EARLY, reranker=False, collection="none") == []


def test_watch(spark, store, tmp_path):
    folder = tmp_path / "log"
    folder.mkdir()
    log = [("default", "x.md", "added", "first text here", "2024-01-01T00:00:00", 1), ("default", "x.md", "modified", "second text here", "2024-01-02T00:00:00", 2), ("default", "y.md", "added", "other words", "2024-01-01T00:00:00", 3), ("default", "y.md", "deleted", None, "2024-01-03T00:00:00", 4), ("default", "other-x.md", "added", "kept", "2024-01-01T00:00:00", 5)]
    write = lambda name, part: (folder / name).write_text("\n".join(json.dumps(dict(zip(("collection", "path", "kind", "text", "ts", "event_id"), r, strict=True))) for r in part))
    write("0.json", log[:3])
    watch(spark, store, str(folder), str(tmp_path / "cp"), HashingEmbedder(), SETTINGS).awaitTermination()
    write("1.json", log[3:])
    watch(spark, store, str(folder), str(tmp_path / "cp"), HashingEmbedder(), SETTINGS).awaitTermination()
    state = {r["path"]: r["active"] for r in store.table("documents").collect()}
    assert state == {"x.md": True, "y.md": False, "other-x.md": True}
    assert store.table("documents").join(store.table("content"), "hash").where("path = 'x.md'").head()["doc"] == "second text here"


def test_command_line(spark, notes, tmp_path):
    (tmp_path / "conf.json").write_text('{"chunking": {"min_chars": 5}}')
    run = lambda *a: cli.main(["--store", str(tmp_path / "s"), "--config", str(tmp_path / "conf.json"), *a], spark)
    assert run("add", notes, "--index")["added"] == 3
    assert "Beta" in run("search", "quick brown")
    assert json.loads(run("search", "absent words", "--json", "--no-rerank")) is not None
    assert run("db-check")["documents"] == 3
    assert run("collections", "list")[0]["name"] == "default"
    assert run("remove", "c.md") == 1
    assert run("purge", "--dry-run")[0] in (0, 1)
    with pytest.raises(ValueError):
        cli.age("3x")


def test_settings_file(tmp_path):
    path = tmp_path / "c.json"
    path.write_text('{"search": {"default_count": 9}}')
    loaded = Settings.load(str(path))
    assert loaded.search.default_count == 9 and loaded.chunking == Chunking()
    loaded.save(str(path))
    assert Settings.load(str(path)) == loaded
