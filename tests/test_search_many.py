"""The plan over all queries against the same stages one query at a time, and searches with the model of the index."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakesift import cli
from lakesift.functions.porter import stem
from lakesift.functions.text import tokens
from lakesift.operators import fulltext, ingest, retrieval, search
from lakesift.providers import HashingEmbedder, OverlapScorer, words_of
from lakesift.schema import Chunking, Search, Settings
from lakesift.store import Store

T = "2024-05-01 10:00:00"
SETTINGS = Settings(chunking=Chunking(150, 15, 5), search=Search(candidates=3))


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    own, rng = Store(spark, str(tmp_path_factory.mktemp("many") / "store")), random.Random(3)
    words = "token validation web request fox dog cat river stone light quick brown".split()
    rows = [(f"{k}.md", "\n\n".join(" ".join(rng.choices(words, k=rng.randint(4, 25))) + "." for _ in range(rng.randint(1, 4))), "x") for k in range(40)]
    rows.append(("odd.md", "A zebra unlike all others.", "x"))
    files = spark.createDataFrame(rows, "path string, text string, source_uri string").withColumn("modified_at", F.lit(T).cast("timestamp"))
    ingest.add_documents(own, files, "default", T)
    ingest.index_documents(own, HashingEmbedder(), SETTINGS, T)
    ingest.remove(own, "5.md", T)
    return own


def one_by_one(store, query, count, s):
    """The stages in plain Python over the store's live chunks: rows of (chunk_id, place, bm25_rank, vector_rank)."""
    live = search.chunks_of(store)
    rows = search.with_text(store, live.select("chunk_id"), store.table("chunks")).select("chunk_id", "text", tokens(F.col("text")).alias("tokens")).collect()
    own = {r["chunk_id"]: ([stem(w) for w in r["tokens"]], r["text"]) for r in rows}
    asked = [stem(w) for w in words_of(query)]
    avgdl = sum(len(t) for t, _ in own.values()) / len(own)
    scores = {}
    for chunk, (held, _) in own.items():
        total, hit = 0.0, False
        for w in asked:
            n = sum(w in t for t, _ in own.values())
            f = held.count(w)
            hit |= f > 0
            total += (max(np.log((len(own) - n + 0.5) / (n + 0.5)), 0) or 1e-6) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(held) / avgdl))
        if hit:
            scores[chunk] = -total
    by_text = sorted(scores, key=lambda c: (round(scores[c], 9), c))
    shown = [scores[c] for c in by_text[:count * 5]]
    norm = [1.0 if shown[0] == shown[-1] else (x - shown[-1]) / (shown[0] - shown[-1]) for x in shown]
    if norm and norm[0] >= s.bm25_threshold and (len(norm) == 1 or norm[0] - norm[1] >= s.bm25_gap):
        return [(c, i, None, None) for i, c in enumerate(by_text[:count], 1)]
    n = count * s.candidates ** 2
    vector = HashingEmbedder().vectors([query])[0].astype(np.float32).astype(float)
    vectors = {r["chunk_id"]: np.array(r["embedding"], dtype=float) for r in store.table("vectors").collect() if r["chunk_id"] in own}
    near = sorted(vectors, key=lambda c: (round(float(np.sqrt(((vectors[c] - vector) ** 2).sum())), 9), c))[:n]
    br, vr = ({c: i for i, c in enumerate(x[:n], 1)} for x in (by_text, near))
    fused = sorted(br.keys() | vr.keys(), key=lambda c: (-((1 / (60 + br[c]) if c in br else 0) + (1 / (60 + vr[c]) if c in vr else 0)), br.get(c, 10**9), vr.get(c, 10**9)))
    best = fused[:min(count * s.candidates, s.rerank * count)]
    mark = dict(zip(best, OverlapScorer().scores(query, [own[c][1] for c in best]), strict=True))
    ranked = sorted(best, key=lambda c: (-mark[c], best.index(c)))[:count]
    return [(c, i, br.get(c), vr.get(c)) for i, c in enumerate(ranked, 1)]


def test_plan_is_each_query(spark, store):
    queries = [(1, "fox dog dogs"), (2, "zebra"), (3, "river"), (4, ""), (5, None), (6, "validation of TOKENS in the web"), (7, "nothing known here")]
    found = search.search_many(store, spark.createDataFrame(queries, "query_id long, query string"), HashingEmbedder(), SETTINGS, count=2).collect()
    for key, query in queries:
        own = sorted((r["place"], r["chunk_id"], r["bm25_rank"], r["vector_rank"]) for r in found if r["query_id"] == key)
        assert own == [(i, c, b, v) for c, i, b, v in one_by_one(store, query or "", 2, SETTINGS.search)], query
    assert [r["context"] for r in found if r["query_id"] == 2 and r["place"] == 1] == [None]  # a clear winner is shown without its neighbours
    late = [r for r in found if r["bm25_rank"] or r["vector_rank"]]
    assert late and all(r["excerpt"] in r["context"] for r in late)


def test_ways_without_rerank_and_by_collection(spark, store):
    queries = spark.createDataFrame([(1, "fox river")], "query_id int, query string")
    plain = search.search_many(store, queries, HashingEmbedder(), SETTINGS, reranker=False, count=3, context=False).orderBy("place").collect()
    assert [r["place"] for r in plain] == [1, 2, 3] and plain[0]["score"] >= plain[1]["score"] and "context" not in plain[0]
    assert search.search_many(store, queries, HashingEmbedder(), SETTINGS, count=3, collection="none").count() == 0
    assert search.search_many(store, queries.where("false"), HashingEmbedder(), SETTINGS).count() == 0


def test_many_words_are_joined(spark):
    """Words beyond the bound of a broadcast give the same rows."""
    rows = spark.createDataFrame([(1, ["a", "b"]), (2, ["b", "b", "c"]), (3, ["d"])], "chunk_id long, tokens array<string>")
    words = fulltext.words_of_queries(spark.createDataFrame([(1, "b c"), (2, "a a d"), (3, "z")], "query_id long, query string"))
    index, total = fulltext.postings(rows), rows.agg(F.count("*").alias("n_rows"), F.avg(F.size("tokens")).alias("avgdl"))
    held = index.groupBy("term").agg(F.count("*").alias("n_docs"))
    ways = [sorted(tuple(r) for r in fulltext.bm25_of_many(index, total, held, words, 5, small=k).collect()) for k in (0, 1000)]
    assert ways[0] == ways[1] and {(r[0], r[1]) for r in ways[0]} == {(1, 1), (1, 2), (2, 1), (2, 3)}


# ------------------------------------------------------------------------------- the model of the index
def lengths():
    from lakesift.providers import Embedder

    class Lengths(Embedder):
        """Another model, of another width; made in here, so that tasks get it by value."""

        name, width = "lengths", 3

        def vectors(self, texts):
            import numpy as np

            return np.array([[len(t), t.count(" "), 1.0] for t in texts])

    return Lengths()


def test_index_of_another_model(spark, store, tmp_path):
    with pytest.raises(ValueError, match="hashing-64"):
        search.search(store, "fox", lengths(), T, SETTINGS)
    with pytest.raises(ValueError, match="hashing-64"):
        search.search_many(store, spark.createDataFrame([(1, "fox")], "query_id long, query string"), lengths(), SETTINGS)
    other = Store(spark, str(tmp_path / "other"))
    files = spark.createDataFrame([("a.md", "Some short text.", "x"), ("b.md", "Another text that is longer by some words.", "x")], "path string, text string, source_uri string").withColumn("modified_at", F.lit(T).cast("timestamp"))
    ingest.add_documents(other, files, "default", T)
    assert ingest.index_documents(other, (lambda own: lambda: own)(lengths()), SETTINGS, T)["indexed"] == 2  # a function that makes the model: its own name is kept
    assert {r["model"] for r in other.table("indexed").collect()} == {"lengths"} == set(search.models(other))
    assert ingest.index_documents(other, lengths(), SETTINGS, T)["indexed"] == 0
    found = search.search(other, "Some short word.", lengths(), T, SETTINGS, count=1, reranker=False)
    assert found[0]["vector_rank"] == 1 and found[0]["excerpt"].startswith("Some")


def test_widths_have_to_agree(spark):
    vectors = spark.createDataFrame([(0, [1.0, 0.0]), (1, None), (2, [0.0, 1.0])], "chunk_id long, embedding array<float>")
    assert [r["chunk_id"] for r in retrieval.nearest(vectors, [0.0, 1.0], 5).collect()] == [2, 0]
    with pytest.raises(Exception, match="unlike widths"):
        retrieval.nearest(vectors, [0.0, 1.0, 2.0, 3.0], 2).collect()


def test_command_line_takes_the_model_of_the_index(spark, store):
    assert cli.embedder_of(store, None, "http://none", 128).name == "hashing-64"
    assert cli.embedder_of(store, "other", "http://none", 64).name == "other"


def test_texts_give_what_postings_give(spark):
    """The scan of texts keeps each query's best, equal scores by their keys, also where tasks keep hits of few queries at once."""
    import random

    rng = random.Random(3)
    texts = [[rng.choice("abcdefghij") for _ in range(rng.randrange(12))] for _ in range(150)]
    rows = spark.createDataFrame([(i, t or None) for i, t in enumerate(texts + texts[:60])], "chunk_id long, tokens array<string>").repartition(3)
    words = fulltext.words_of_queries(spark.createDataFrame([(1, "b c"), (2, "a a d"), (3, "z"), (4, "a b c d e f g h i j"), (5, "")], "query_id int, query string"))
    index, total = fulltext.postings(rows), rows.agg(F.count("*").alias("n_rows"), F.avg(F.coalesce(F.size("tokens"), F.lit(0))).alias("avgdl"))
    held = index.groupBy("term").agg(F.count("*").alias("n_docs"))
    wanted, found = (sorted(tuple(r) for r in f.select("query_id", "rank", "chunk_id", "raw_score").collect()) for f in (fulltext.bm25_of_many(index, total, held, words, 7), fulltext.bm25_of_texts(rows, total, held, words, 7)))
    assert found == wanted and len(found) == 21
