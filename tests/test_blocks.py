"""What is collected in blocks: the driver never holds more than one."""

import random

import pytest

from lakesift.operators import retrieval


@pytest.fixture
def collected(spark, monkeypatch):
    """The numbers of rows that come to the driver at once."""
    kind, sizes = type(spark.range(0)), []
    collect, listed = kind.collect, kind.toLocalIterator
    monkeypatch.setattr(kind, "collect", lambda self: sizes.append(len(out := collect(self))) or out)
    monkeypatch.setattr(kind, "toLocalIterator", lambda self, *a: iter(sizes.append(len(out := list(listed(self, *a)))) or out))
    return sizes


def test_queries_in_blocks(spark, collected, monkeypatch):
    r = random.Random(2)
    data = [(i, [r.random() for _ in range(4)]) for i in range(40)]
    vectors = spark.createDataFrame(data, "chunk_id long, embedding array<float>")
    queries = spark.createDataFrame([(i, v) for i, v in data[:11]], "query_id long, query_vector array<float>").repartition(3)
    whole = retrieval.nearest_of_many(vectors, queries, 3).toPandas().sort_values(["query_id", "rank"]).values.tolist()
    monkeypatch.setattr(retrieval, "SMALL_ROWS", 4)
    collected.clear()
    parts = retrieval.nearest_of_many(vectors, queries, 3)
    assert sum(collected) >= 11 and max(collected) <= 4
    assert parts.toPandas().sort_values(["query_id", "rank"]).values.tolist() == whole and len(whole) == 33
