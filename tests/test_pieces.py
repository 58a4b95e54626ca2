import pyarrow as pa
from pyspark.sql.types import LongType, StructField, StructType

from lakesift.blocks import pieces
from lakesift.operators import chunking, fulltext


class Table:
    """Stands in for a table: gives the function that its tasks would run."""

    schema = StructType([StructField("chunk_id", LongType())])

    def select(self, *_):
        return self

    def mapInArrow(self, run, _):
        return run


def test_pieces_are_all_rows_in_order():
    batch = pa.RecordBatch.from_arrays([pa.array(range(1000)), pa.array(["word " * 200] * 1000)], ["chunk_id", "text"])
    found = list(pieces(batch, 100_000))
    assert len(found) > 5 and pa.Table.from_batches(found).equals(pa.Table.from_batches([batch]))
    assert list(pieces(batch.slice(0, 0))) == [] and [p.num_rows for p in pieces(batch.slice(0, 2), 1)] == [1, 1]


def test_large_batches_are_worked_on_in_pieces():
    keys, n = pa.array(range(600)), 600
    words = pa.RecordBatch.from_arrays([keys, pa.array([["a", "b", "a", f"w{i}"] * 150 for i in range(n)])], ["chunk_id", "tokens"])
    found = list(fulltext.postings(Table())(iter([words])))
    assert len(found) > 1 and max(b.num_rows for b in found) < n * 3
    rows = {(r["term"], r["chunk_id"]): r for b in found for r in b.to_pylist()}
    assert len(rows) == n * 3 and rows["b", 599]["positions"] == list(range(1, 600, 4)) and rows["w7", 7]["dl"] == 600
    texts = pa.RecordBatch.from_arrays([keys, pa.array(["Some words. And more.\n" * 150] * n)], ["chunk_id", "text"])
    breaks = list(chunking.break_rows(Table(), "chunk_id", "text")(iter([texts])))
    assert len(breaks) > 1 and sum(b.num_rows for b in breaks) == n * len(chunking.breaks("Some words. And more.\n" * 150))
