"""The store appends; what is purged is gone from disk; patterns, folders, stems, models and vaults."""

import json
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakesift import cli
from lakesift.operators import fulltext, ingest, search
from lakesift.providers import Embedder, HashingEmbedder, PairScorer, ServedModel, loaded
from lakesift.schema import Chunking, Search, Settings
from lakesift.sources.files import fitting, glob_pattern, read_files
from lakesift.store import Store
from lakesift.streaming.watch import sync_folder

T, LATER = "2024-05-01 10:00:00", "2024-06-01 10:00:00"
SETTINGS = Settings(chunking=Chunking(200, 20, 5), search=Search(bm25_gap=2.0, bm25_threshold=2.0))


@pytest.fixture(scope="module")
def filled(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("notes")
    for i in range(12):
        (folder / f"n{i}.md").write_text(f"# Note {i}\n\nThis note is about running number {i}. The secretword{i} stands here.\n")
    (folder / "empty.md").write_text("hi")
    store = Store(spark, str(tmp_path_factory.mktemp("store") / "s"))
    ingest.register_collection(store, "notes", str(folder))
    ingest.update_collection(store, "notes", T)
    ingest.index_documents(store, HashingEmbedder(), SETTINGS, T)
    return store, folder


def files_of(store):
    return {str(p.relative_to(store.path)) for p in Path(store.path).rglob("*.parquet")}


def test_adding_a_file_writes_one_file_a_table(filled, spark):
    store, folder = filled
    before, rows = files_of(store), store.table("content").count()
    (folder / "new.md").write_text("# New\n\nQuite another text, added later on.\n")
    assert ingest.update_collection(store, "notes", LATER)["added"] == 1
    assert ingest.index_documents(store, HashingEmbedder(), SETTINGS, LATER)["indexed"] == 1
    assert before <= files_of(store) and store.table("content").count() == rows + 1
    new = {}
    for p in files_of(store) - before:
        n = spark.read.parquet(f"{store.path}/{p}").count()
        new.setdefault(p.split("/")[1], []).extend([n] * (n > 0))  # the first task may write a file without rows
    assert {t: new[t] for t in ("content", "chunks", "vectors", "tokens", "documents")} == {t: [1] for t in ("content", "chunks", "vectors", "tokens", "documents")}
    assert sum(new["postings"]) < 10
    # a text that gives no chunk isn't looked at again
    assert ingest.index_documents(store, HashingEmbedder(), SETTINGS, LATER)["indexed"] == 0


def test_stems_and_sources(filled):
    store, _ = filled
    found = search.search(store, "runs", HashingEmbedder(), T, SETTINGS, count=3, context=False)
    assert len(found) == 3 and all("running" in r["excerpt"] and "context" not in r for r in found)
    assert store.table("tokens").where(F.array_contains("tokens", "run")).count() == 12


def test_pair_models_rank_and_are_made_once(filled):
    store, _ = filled

    class Elevens(PairScorer):
        name, made = "elevens", 0

        def __init__(self):
            Elevens.made += 1

        def scores(self, query, texts):
            return np.array([float(t.count("11")) for t in texts])

    best = search.search(store, "number", HashingEmbedder, T, SETTINGS, reranker=Elevens, count=2)
    assert "number 11" in best[0]["excerpt"] and best[0]["score"] == 2.0
    assert loaded(Elevens) is loaded(Elevens) and Elevens.made == 1


def test_purged_texts_leave_the_disk(spark, tmp_path):
    folder = tmp_path / "n"
    folder.mkdir()
    (folder / "a.md").write_text("The uniqueword stays here, in a sentence of its own.")
    (folder / "b.md").write_text("Another text that is kept for good and all.")
    store = Store(spark, str(tmp_path / "s"))
    ingest.add_documents(store, read_files(spark, str(folder)), "default", T)
    ingest.index_documents(store, HashingEmbedder(), SETTINGS, T)
    ingest.remove(store, "a.md", T)

    def held():
        out = set()
        for p in Path(store.path).rglob("*.parquet"):
            rows = spark.read.parquet(str(p))
            out |= {str(x) for x in rows.select([F.col(c).cast("string") for c in rows.columns]).collect()}
        return " ".join(out)

    assert "uniqueword" in held()
    assert ingest.purge(store, LATER) == (1, 1, 1)
    assert "uniqueword" not in held() and "kept for good" in held() and len(store.versions()) == 1
    assert store.table("postings").where("term = 'kept'").count() == 1 and store.table("vectors").count() == 1


def test_versions_and_many_deletions(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    row = lambda i, x: spark.createDataFrame([(str(i), "llm", x)], "hash string, type string, result string").withColumn("created_at", F.lit(T)).withColumn("expires_at", F.lit(None).cast("timestamp"))
    for i in range(12):
        store.append({"cache": row(i % 3, f"v{i}")}, {"cache": row(i % 3, "")})
    assert sorted(tuple(r) for r in store.table("cache").select("hash", "result").collect()) == [("0", "v9"), ("1", "v10"), ("2", "v11")]
    assert sum(p["gone"] for p in store.parts()["cache"]) <= 8
    assert [r["result"] for r in store.table("cache", 1).collect()] == ["v0"]
    assert store.vacuum() > 5 and store.table("cache").count() == 3 and len(store.versions()) == 1


def test_patterns(spark):
    paths = ["a.md", "docs/b.md", "docs/deep/c.md", "other/d.md", "docs/e.txt", "node_modules/x/f.md", "a1.md"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    fit = lambda *a: sorted(r["path"] for r in fitting(df, *a).collect())
    assert fit("docs/*.md") == ["docs/b.md"] and fit("docs/**/*.md") == ["docs/b.md", "docs/deep/c.md"]
    assert fit("*.md", ["node_modules", "other/*"]) == ["a.md", "a1.md", "docs/b.md", "docs/deep/c.md"]
    assert fit("**/*") == sorted(paths) and fit("a?.md") == ["a1.md"] and fit("[!a]*.md") == ["docs/b.md", "docs/deep/c.md", "node_modules/x/f.md", "other/d.md"]
    assert glob_pattern("a+b*.md") == r"^a\+b[^/]*\.md$"


def test_folder_sync_and_vault(spark, tmp_path):
    folder = tmp_path / "n"
    (folder / "docs").mkdir(parents=True)
    (folder / "docs" / "a.md").write_text("first text")
    (folder / "docs" / "b.md").write_text("second text")
    (folder / "skip.md").write_text("not in the pattern")
    store = Store(spark, str(tmp_path / "s"))
    ingest.register_collection(store, "c", str(folder), "docs/*.md", ignore=["docs/x*"])
    (folder / "docs" / "xx.md").write_text("ignored")
    assert sync_folder(store, "c", T) == {"changed": 2, "gone": 0} and sync_folder(store, "c", T) == {"changed": 0, "gone": 0}
    (folder / "docs" / "a.md").unlink()
    import os

    (folder / "docs" / "b.md").write_text("second text, changed")
    os.utime(folder / "docs" / "b.md", (2_000_000_000, 2_000_000_000))
    assert sync_folder(store, "c", LATER) == {"changed": 1, "gone": 1}
    copied = ingest.copy_to_vault(store, "c", str(tmp_path / "vault")).collect()
    assert [r["path"] for r in copied] == ["docs/b.md"] and (tmp_path / "vault" / "docs" / "b.md").read_text() == "second text, changed"
    with pytest.raises(ValueError):
        sync_folder(store, "none", T)


def test_served_model(monkeypatch):
    seen = []

    class Answer:
        def __init__(self, data):
            self.data = data

        def read(self, *a):
            return self.data

        def __enter__(self):
            return self

        def __exit__(self, *a):
            return False

    def urlopen(request, timeout):
        body = json.loads(request.data)
        seen.append((request.full_url, body))
        return Answer(json.dumps({"embeddings": [[1.0, 2.0]] * len(body.get("input", []))} if "input" in body else {"response": " a reply "}).encode())

    monkeypatch.setattr("urllib.request.urlopen", urlopen)
    model = ServedModel("m", "http://h:1/")
    assert isinstance(model, Embedder) and model.vectors([]).shape[0] == 0 and model.vectors(["a", "b"]).tolist() == [[1, 2], [1, 2]] and model.width == 2
    assert model.reply("p", 9) == "a reply" and seen[-1][1]["options"] == {"num_predict": 9, "temperature": 0} and [u for u, _ in seen] == ["http://h:1/api/embed", "http://h:1/api/generate"]


def test_command_line_flags(filled, spark, tmp_path):
    store, folder = filled
    run = lambda *a: cli.main(["--store", store.path, *a], spark)
    text = run("search", "secretword3", "--no-context", "--no-expand")
    assert text.startswith("[1] █") and "Note 3" in text and "(notes" in text
    assert run("add", str(folder / "n1.md"), "--vault", str(tmp_path / "v"))["copied"] >= 1 and (tmp_path / "v" / "n1.md").exists()
    assert run("compact") == store.version and run("vacuum") >= 1
    assert run("collections", "add", "more", str(folder), "--ignore", "x*", "--context", "about")
    assert store.table("store_collections").where("name = 'more'").head()["context"] == {"/": "about"}


def test_postings_keep_places(spark):
    rows = spark.createDataFrame([(1, ["b", "a", "b"]), (2, []), (3, None), (4, ["a"])], "chunk_id long, tokens array<string>")
    assert sorted(tuple(r) for r in fulltext.postings(rows).collect()) == [("a", 1, [1], 3), ("a", 4, [0], 1), ("b", 1, [0, 2], 3)]
    assert [r["tokens"] for r in fulltext.with_stems(spark.createDataFrame([(1, ["running", "runs"]), (2, None)], "chunk_id long, tokens array<string>")).collect()] == [["run", "run"], []]
