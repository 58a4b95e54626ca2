"""Items of the benchmark are collected in blocks: the driver never holds more than one."""

import pytest

from lakesift.llm import decontamination


@pytest.fixture
def collected(spark, monkeypatch):
    """The numbers of rows that come to the driver at once."""
    kind, sizes = type(spark.range(0)), []
    collect, listed = kind.collect, kind.toLocalIterator
    monkeypatch.setattr(kind, "collect", lambda self: sizes.append(len(out := collect(self))) or out)
    monkeypatch.setattr(kind, "toLocalIterator", lambda self, *a: iter(sizes.append(len(out := list(listed(self, *a)))) or out))
    return sizes


def test_items_in_blocks(spark, collected):
    docs = spark.createDataFrame([(i, f"before w{i} x{i} y{i} z{i} after") for i in range(9)] + [(None, "w1 x1 y1 z1")], "doc_id long, text string")
    items = spark.createDataFrame([(i, f"w{i} x{i} y{i} z{i}") for i in range(8)], "item_id long, text string").repartition(3)
    collected.clear()
    found = decontamination.contaminated(docs, items, block=3)
    assert sum(collected) >= 8 and max(collected) <= 3
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["item_id"], r["distance"], r["start_word"]) for r in found.toLocalIterator()) == [(-1, 1, 0, 0)] + [(i, i, 0, 1) for i in range(8)]
