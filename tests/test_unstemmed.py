"""Words as they stand, found by an index of stems."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from lakesift.functions.porter import kept_by_stems, stem
from lakesift.operators import fulltext, statistics
from lakesift.plans import corpus_queries
from tests.test_registry import rows

FILL = " ".join(f"word{i}" for i in range(60)) + ". "
TEXTS = [FILL + "one of the many", FILL + "hoofs ofed the many", FILL + "ofes these", FILL + "of theses of the", FILL + "the of", FILL + "offing the offed the of they " * 3, FILL, "of the", FILL + "one of the many"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    own = str(tmp_path_factory.mktemp("sf"))
    table = spark.createDataFrame([(k, t, "en", "src1", len(t)) for k, t in enumerate(TEXTS)], "doc_id long, text string, lang string, source string, n_chars long")
    table.coalesce(1).write.parquet(f"{own}/documents.parquet")
    return own


def test_search_index_is_its_sql(spark, folder):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{folder}/documents.parquet/*.parquet'")
    assert rows(corpus_queries.QUERIES["search_index"](spark, folder).toPandas()) == rows(con.execute(corpus_queries.SQL["search_index"]).df())


@pytest.mark.parametrize("text", ['"ofed the" OR "theses"', '"of" NOT "offing"', 'NEAR("of" they, 2)', '"th"*', '^"word0" AND "of the"*', '"s"*'])
def test_other_queries_are_a_scan(spark, folder, text):
    store, wanted = corpus_queries.filled(spark, folder), fulltext.query(text)
    own = store.table("chunks").join(store.table("content"), F.col("content_hash") == F.col("hash")).select("chunk_id", F.substring("doc", F.col("pos") + 1, F.col("len")).alias("text"))
    scanned = {r["chunk_id"]: round(r["raw_score"], 9) for r in fulltext.bm25(fulltext.with_tokens(own).drop("text"), wanted).collect()}
    assert {r["chunk_id"]: round(r["raw_score"], 9) for r in statistics.unstemmed(store, wanted).collect()} == scanned


def test_stems_alone_find_more(spark, folder):
    store = corpus_queries.filled(spark, folder)
    stemmed = fulltext.bm25_indexed(statistics.live_postings(store), statistics.corpus(store), fulltext.query("of the", stemmed=True))
    assert stemmed.count() > statistics.unstemmed(store, fulltext.query("of the")).count()


def test_stems_keep_the_beginning():
    rng = random.Random(3)
    ends = ["s", "es", "ed", "ing", "eed", "y", "ies", "sses", "ational", "iveness", "ement", "ion", "e", "ll", "ization", "biliti"]
    for _ in range(20_000):
        word = "".join(rng.choices("aeoythsléz", k=rng.randint(1, 6))) + "".join(rng.choices(ends, k=rng.randint(0, 2)))
        for k in range(1, len(word) + 1):
            assert stem(word).startswith(kept_by_stems(word[:k])), word
