"""Matches and scores against SQLite's full-text index."""

import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from lakesift.functions.porter import stem
from lakesift.functions.text import score_bar, seconds_of, tokens
from lakesift.operators import fulltext, retrieval

WORDS = "run running runs cat cats relational hopping the of a an élan Élan x1 state stated".split()


@pytest.fixture(scope="module")
def texts():
    r = random.Random(3)
    return [" ".join(r.choice(WORDS) + r.choice(["", ".", ",", "-", "_"]) for _ in range(r.randrange(0, 25))) for _ in range(120)]


def sqlite_scores(texts, query, tokenizer):
    con = sqlite3.connect(":memory:")
    con.execute(f"create virtual table t using fts5(x, tokenize = '{tokenizer}')")
    con.executemany("insert into t(rowid, x) values (?, ?)", list(enumerate(texts, 1)))
    return dict(con.execute("select rowid, bm25(t) from t where t match ?", (query,)).fetchall())


QUERIES = ["the of", '"run" OR "cat"', '"run" AND "cat"', '"cat" NOT "the"', '("run" OR "cat") AND "of"', 'cat* run', '"the the"', "élan", '"x1" OR "state"* NOT "the"', '^"run"', '^the OR "of" + "a"', '"cat" + "the" + of*', '^"the" + "of"']


@pytest.mark.parametrize("query", QUERIES)
def test_scores(spark, texts, query):
    rows = fulltext.with_tokens(spark.createDataFrame(list(enumerate(texts, 1)), "chunk_id long, text string"))
    wanted = fulltext.query(query)
    found = {r["chunk_id"]: r["raw_score"] for r in fulltext.bm25(rows, wanted).collect()}
    said = f'"{query}"*' if isinstance(wanted, fulltext.Phrase) and '"' not in query else query
    expected = sqlite_scores(texts, said, "ascii")
    assert found.keys() == expected.keys()
    assert all(abs(found[k] - expected[k]) < 1e-9 for k in expected)
    indexed = {r["chunk_id"]: r["raw_score"] for r in fulltext.bm25_indexed(fulltext.postings(rows), rows.select("chunk_id", F.size("tokens").alias("dl")), wanted).collect()}
    assert indexed.keys() == expected.keys() and all(abs(indexed[k] - expected[k]) < 1e-9 for k in expected)


def test_stemmed(spark, texts):
    rows = fulltext.with_stems(fulltext.with_tokens(spark.createDataFrame([(i, t) for i, t in enumerate(texts, 1)], "chunk_id long, text string")))
    found = {r["chunk_id"] for r in fulltext.bm25(rows, fulltext.phrase("running", stemmed=True)).collect()}
    assert found == sqlite_scores(texts, '"running"', "porter ascii").keys()


def test_stems_as_sqlite_has_them():
    words = sorted({b + s for b in "run hop relat adjust form generaliz happi troubl siz fil agre plaster electric commun y sk cris".split() for s in ("", "s", "ed", "ing", "ation", "ies", "ness", "ful", "ly", "ement", "ous", "ive", "ize", "e", "y", "al", "ational", "sses", "eed")})
    con = sqlite3.connect(":memory:")
    con.execute("create virtual table t using fts5(x, tokenize = 'porter ascii')")
    con.executemany("insert into t(rowid, x) values (?, ?)", list(enumerate(words, 1)))
    con.execute("create virtual table v using fts5vocab(t, 'instance')")
    expected = {words[doc - 1]: term for term, doc in con.execute("select term, doc from v")}
    assert {w: stem(w) for w in words} == expected


@pytest.mark.parametrize("bad", ["(", '"open', "a AND", "OR b", "cross-encoder x", "a ) b", "+ a", '"a" +', '"a" + (b)', "a ^", '"a"* + "b"'])
def test_bad_queries(bad):
    with pytest.raises(fulltext.QuerySyntaxError):
        fulltext.query(bad)


def test_index_and_edges(spark):
    rows = spark.createDataFrame([(1, "a b a b"), (2, ""), (3, None), (4, "b a")], "chunk_id long, text string").withColumn("tokens", tokens(F.coalesce("text", F.lit(""))))
    index = fulltext.postings(rows)
    assert {(r["chunk_id"], r["f"]) for r in fulltext.phrase_rows(index, fulltext.phrase("a b")).collect()} == {(1, 2)}
    assert fulltext.bm25(rows.where("false"), fulltext.phrase("a")).count() == 0
    assert fulltext.bm25(rows, fulltext.phrase("")).count() == 0
    first = fulltext.Phrase(("b",), first=True)
    assert [r["chunk_id"] for r in rows.where(first.count(F.col("tokens")) > 0).collect()] == [4]
    assert [r["chunk_id"] for r in rows.where(fulltext.near(F.col("tokens"), "a", "b", 0)).orderBy("chunk_id").collect()] == [1, 4]


def test_min_max_and_early(spark):
    one = spark.createDataFrame([(1, -3.0)], "chunk_id long, raw_score double")
    assert fulltext.min_max(one).head()["score"] == 1.0
    rows = fulltext.min_max(spark.createDataFrame([(1, -3.0), (2, -2.9), (3, -1.0)], "chunk_id long, raw_score double"))
    assert fulltext.early(rows).head()[0] is False
    assert fulltext.early(rows.where("chunk_id <> 2")).head()[0] is True
    assert fulltext.early(rows.where("false")).head()[0] is False


def test_small_functions(spark):
    row = spark.range(1).select(score_bar(F.lit(0.0)).alias("bar"), seconds_of(F.lit("2w")).alias("w"), seconds_of(F.lit("x")).alias("x"), retrieval.query_kind(F.lit("how to run")).alias("k")).head()
    assert (row["bar"], row["w"], row["x"], row["k"]) == ("█████░░░░░", 1209600, None, "hyde")


def test_many_nearest(spark):
    r = random.Random(5)
    data = [(i, [r.random() for _ in range(4)]) for i in range(60)]
    vectors = spark.createDataFrame(data, "chunk_id long, embedding array<float>")
    queries = spark.createDataFrame([(i, v) for i, v in data[:7]], "query_id long, query_vector array<float>")
    found = retrieval.nearest_of_many(vectors, queries, 3).collect()
    assert len(found) == 21 and all(x["chunk_id"] == x["query_id"] for x in found if x["rank"] == 1)
    assert retrieval.nearest_of_many(vectors, queries.where("false"), 3).count() == 0


def test_many_nearest_of_equal_vectors(spark):
    r = random.Random(7)
    ids = list(range(700))
    r.shuffle(ids)
    data = [(i, [0.1, 0.7, 0.3, 0.9] if i % 3 else [r.random() + 2 for _ in range(4)]) for i in ids]
    vectors = spark.createDataFrame(data, "chunk_id long, embedding array<float>").coalesce(1)
    queries = spark.createDataFrame([(1, [0.1, 0.7, 0.3, 0.9]), (2, [0.4, 0.2, 0.8, 0.1]), (3, [2.5, 2.5, 2.5, 2.5])], "query_id long, query_vector array<float>")
    found = sorted((x["query_id"], x["rank"], x["chunk_id"]) for x in retrieval.nearest_of_many(vectors, queries, 5).collect())
    pairs = vectors.crossJoin(queries).withColumn("d", retrieval.l2(F.col("embedding"), F.col("query_vector"))).collect()
    expected = [(q, n, p["chunk_id"]) for q in (1, 2, 3) for n, p in enumerate(sorted((p for p in pairs if p["query_id"] == q), key=lambda p: (p["d"], p["chunk_id"]))[:5], 1)]
    assert found == expected and [c for q, _, c in found if q < 3] == [1, 2, 4, 5, 7] * 2
