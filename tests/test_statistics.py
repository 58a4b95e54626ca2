"""Stored counts and skipped levels give the rows of BM25 over all live chunks, after any change of documents."""

import math
import random

import pytest
from pyspark.sql import functions as F

from lakesift.functions.text import tokens
from lakesift.operators import fulltext, ingest, search, statistics
from lakesift.providers import HashingEmbedder
from lakesift.schema import Chunking, Settings
from lakesift.store import Store

T, LATER = "2024-05-01 10:00:00", "2024-06-01 10:00:00"
SETTINGS = Settings(chunking=Chunking(200, 20, 5))
QUERIES = ['"fox"', '"fox" OR "dog"', "fo", '"fox" OR ("dog" OR "fox") OR "missing"', '"the fox"', '"fox" AND "dog"', '"fox" NOT "dog"', '"owl"*', '"missing"', '^"fox"']


def files(spark, rng, names, extra=""):
    words = ["fox", "dog", "the", "owl", "owls", "forest", "a", "runs"]
    rows = [(f"{n}.md", "\n\n".join(" ".join(rng.choices(words, [9, 5, 9, 1, 1, 1, 3, 3], k=rng.randint(1, 40))) + "." for _ in range(rng.randint(1, 5))) + extra, None) for n in names]
    return spark.createDataFrame(rows, "path string, text string, source_uri string").withColumn("modified_at", F.lit(T).cast("timestamp"))


def agree(store, k, queries=QUERIES[:3]):
    """The best scores of each query, from the store and from all live chunks' texts."""
    live = search.chunks_of(store)
    texts = search.with_text(store, live.select("chunk_id"), store.table("chunks")).select("chunk_id", tokens(F.col("text")).alias("tokens"))
    rows = [(r["chunk_id"], r["tokens"]) for r in fulltext.with_stems(texts).collect()]
    n, avgdl = len(rows), sum(len(x) for _, x in rows) / len(rows)
    for query in queries:
        wanted = fulltext.query(query, stemmed=True)
        found = sorted(round(r["raw_score"], 9) for r in statistics.best(store, wanted, k).collect())
        assert found == plain(rows, wanted, n, avgdl)[:k], query


def plain(rows, wanted, n, avgdl):
    """BM25 of phrases in plain Python, for OR, AND and NOT of phrases."""
    def occurrences(p, own):
        m = len(p.words)
        at = [0] if p.first else range(len(own) - m + 1)
        return sum(all(own[i + k] == w or (p.prefix and k == m - 1 and own[i + k].startswith(w)) for k, w in enumerate(p.words)) for i in at if i + m <= len(own))

    def holds(q, f):
        if isinstance(q, fulltext.Phrase):
            return f[q] > 0
        a, b = holds(q.left, f), holds(q.right, f)
        return a and b if q.kind == "AND" else a or b if q.kind == "OR" else a and not b

    def scored(q):
        return [q] if isinstance(q, fulltext.Phrase) else scored(q.left) if q.kind == "NOT" else scored(q.left) + scored(q.right)

    counts = [{p: occurrences(p, own) for p in wanted.phrases()} for _, own in rows]
    held = {p: sum(f[p] > 0 for f in counts) for p in wanted.phrases()}
    idf = {p: max(math.log((n - m + 0.5) / (m + 0.5)), 0) or 1e-6 for p, m in held.items()}
    return sorted(round(-sum(idf[p] * f[p] * 2.2 / (f[p] + 1.2 * (0.25 + 0.75 * len(own) / avgdl)) for p in scored(wanted)), 9) for (_, own), f in zip(rows, counts, strict=True) if holds(wanted, f))


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    own = Store(spark, str(tmp_path_factory.mktemp("counted") / "store"))
    ingest.add_documents(own, files(spark, random.Random(2), range(60)), "default", T)
    ingest.index_documents(own, HashingEmbedder(), SETTINGS, T)
    return own


def test_counts_follow_documents(spark, store):
    agree(store, 7, QUERIES)
    agree(store, 1000)
    ingest.remove(store, "3.md", T)
    ingest.remove_all(store, spark.createDataFrame([("default", f"{k}.md") for k in range(10, 30)], "collection string, path string"), T)
    assert store.table("dead").count() > 0
    agree(store, 7)
    # one text comes back under another name; another document changes, and is indexed again
    again = files(spark, random.Random(2), range(60)).where("path = '12.md'").withColumn("path", F.lit("back.md"))
    ingest.add_documents(store, again.unionByName(files(spark, random.Random(8), [1])), "default", LATER)
    ingest.index_documents(store, HashingEmbedder(), SETTINGS, LATER)
    agree(store, 5)
    ingest.index_documents(store, HashingEmbedder(), Settings(chunking=Chunking(90, 10, 5)), LATER)  # other sizes: all chunks are replaced
    agree(store, 5)
    before = {tuple(r) for r in store.table("statistics").groupBy("term", "level").agg(F.sum("n_docs"), F.sum("n")).where("sum(n_docs) != 0").collect()}
    ingest.purge(store, "2025-01-01 00:00:00")
    agree(store, 5)
    assert {tuple(r) for r in store.table("statistics").collect()} == before
    assert store.table("dead").join(store.table("chunks"), "chunk_id", "left_anti").count() == 0


def test_low_levels_are_skipped(spark, tmp_path):
    """Of a word in many rows only those of its high levels are read: the filter reaches the file."""
    rng = random.Random(5)
    rows = spark.createDataFrame([(i, ["w"] * (1 if i % 50 else rng.randint(2, 9)) + ["x"] * rng.randint(0, 400)) for i in range(4000)], "chunk_id long, tokens array<string>")
    index = fulltext.with_levels(fulltext.postings(rows))
    fulltext.by_term(index, 2).write.parquet(str(tmp_path / "index"))
    stored = spark.read.parquet(str(tmp_path / "index"))
    levels = {r["level"]: r["count"] for r in stored.where("term = 'w'").groupBy("level").count().collect()}
    total = rows.agg(F.count("*"), F.avg(F.size("tokens"))).head()
    found = fulltext.best_of_levels(stored, {"w": fulltext.TermCounts(levels, *total)}, {"w": 1}, 10)
    full = fulltext.bm25(rows, fulltext.phrase("w"))
    best = lambda df: [(r["chunk_id"], round(r["raw_score"], 9)) for r in fulltext.top(df, 10, "raw_score", "chunk_id").collect()]
    assert best(found) == best(full)
    assert found.count() < 400 and "GreaterThanOrEqual(level" in found._jdf.queryExecution().toString()


@pytest.mark.parametrize("avgdl", [40.0, 300.0, 2500.0])
def test_bounds_of_levels(avgdl):
    rng = random.Random(int(avgdl))
    part = lambda f, dl, a: f * 2.2 / (f + 1.2 * (0.25 + 0.75 * dl / a))
    rows = [(rng.randint(1, 9), rng.randint(1, 3000)) for _ in range(500)]
    levels: dict[int, int] = {}
    for f, dl in rows:
        level = int(part(f, dl, 300.0) * 8)
        levels[level] = levels.get(level, 0) + 1
    own = fulltext.TermCounts(levels, 1000, avgdl)
    weights = sorted((part(f, dl, avgdl) for f, dl in rows), reverse=True)
    assert weights[0] <= own.most
    for k in (1, 5, 50, 499):
        assert weights[k - 1] >= own.reached(k)
        assert all(int(part(f, dl, 300.0) * 8) >= own.level_of(w) for f, dl in rows if (w := part(f, dl, avgdl)) > 0)
    assert own.reached(501) == 0.0


def test_excluded_collections(spark, tmp_path):
    """A collection that is not included by default is found by its name only."""
    store = Store(spark, str(tmp_path / "store"))
    (tmp_path / "a").mkdir()
    for name in ("open", "closed"):
        assert ingest.register_collection(store, name, str(tmp_path / "a"), include_by_default=name == "open")
        ingest.add_documents(store, files(spark, random.Random(len(name)), [name], f" {name} words"), name, T)
    ingest.index_documents(store, HashingEmbedder(), SETTINGS, T)
    found = lambda **kw: {r["collection"] for r in search.search(store, "words", HashingEmbedder(), T, SETTINGS, count=9, **kw)}
    assert found() == {"open"} and found(collection="closed") == {"closed"}
    assert search.search(store, '"closed"', HashingEmbedder(), T, Settings(chunking=Chunking(200, 20, 5)), count=3, reranker=False)[0]["collection"] == "open"
