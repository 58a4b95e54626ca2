"""Best-fit packing of tokenised documents, planned on the histogram of piece lengths."""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakesift.llm import vocabulary
from lakesift.llm.common import materialise, small_batches, text_of

CAPACITY = 4096
END_ID = 1


def _pieces(path: str, capacity: int, end_id: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, seen = vocabulary.encoder(path), TaskContext.get().partitionId(), {}
        for batch in batches:
            for sub in vocabulary.slices(batch, "content"):
                ids, offsets = enc.batch(sub.column("content"))
                doc, rows, pieces = sub.column("doc_id").to_pylist(), [], []
                for i in range(sub.num_rows):
                    own = np.append(ids[offsets[i]:offsets[i + 1]], np.uint32(end_id)).astype("<u4")
                    for k, start in enumerate(range(0, len(own), capacity)):
                        piece = own[start:start + capacity]
                        rank = seen.get(len(piece), 0)
                        seen[len(piece)] = rank + 1
                        rows.append((doc[i], k, start, len(piece), zlib.crc32(piece.tobytes()), part, rank))
                        pieces.append(piece)
                out = [pa.array(list(x), t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()), strict=True)]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "local_rank"]
                if with_ids:
                    names.append("input_ids")
                    out.append(pa.array([x.astype(np.int32) for x in pieces], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(out, names)

    return run


def tokenised_pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """A row for each piece of each document: its ids, then ``end_id``, cut every ``capacity``.

    ``part`` and ``local_rank`` number equal lengths within a task; they go with the written table.
    """
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, local_rank long" + ", input_ids array<int>" * with_ids
    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("content")).mapInArrow(_pieces(tokenizer or vocabulary.default_path(), capacity, end_id, with_ids), schema)


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts: (length, first rank, end rank, first sequence, per sequence, offset).

    Ranks ``first..end`` of a length fill consecutive sequences from ``first sequence`` on, ``per
    sequence`` of them side by side from ``offset``. Sequences with equal room are kept as ranges,
    so work and plan follow the number of different lengths (at most ``capacity``), not of pieces.
    """
    room: dict[int, list[tuple[int, int]]] = {}  # room left -> ranges (first, count) of sequences
    order: list[int] = []  # the rooms that occur, ascending
    out, opened = [], 0

    def put(left: int, first: int, count: int) -> None:
        if not count or not left:
            return
        if left not in room:
            room[left] = []
            insort(order, left)
        room[left].append((first, count))

    for length in sorted(histogram, reverse=True):
        rank, end = 0, histogram[length]
        while rank < end:
            at = bisect_left(order, length)
            if at < len(order):
                left = order[at]
                first, count = room[left].pop()
                if not room[left]:
                    del room[left]
                    order.pop(at)
            else:
                left, first = capacity, opened
                count = -(-(end - rank) // (capacity // length))
                opened += count
            each = left // length
            full = min(count, (end - rank) // each)
            if full:
                out.append((length, rank, rank + full * each, first, each, capacity - left))
                rank += full * each
                put(left - each * length, first, full)
                first, count = first + full, count - full
            if count and rank < end:  # fewer than one sequence takes
                rest = end - rank
                out.append((length, rank, end, first, rest, capacity - left))
                rank = end
                put(left - rest * length, first, 1)
                first, count = first + 1, count - 1
            put(left, first, count)
    return out


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset [, input_ids] of each piece of ``docs``.

    The histogram of lengths (at most ``capacity`` rows) is planned on the driver; each piece finds
    its slot by its rank within its length. Ranks come from counts by (length, task) and the rank
    within the task, so no length, however common, meets in one task. The plan that is broadcast
    has a size that depends on the number of lengths only.

    Null or empty text: one piece holding ``end_id``. Repeated rows and ties: each row is packed;
    equal lengths take slots in the order of their tasks. Empty table: empty result. Only doc_id
    and text are read, other columns can have any name.
    """
    spark = docs.sparkSession
    pieces = materialise(tokenised_pieces(docs, tokenizer, capacity, end_id, with_ids), "pieces")
    by_task = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    placed = spark.createDataFrame(plan(histogram, capacity) or [], "at_length long, rank_from long, rank_to long, sequence_from long, per_sequence long, offset_from long")
    bases = by_task.selectExpr("length as base_length", "part as base_part", "sum(n) over (partition by length order by part) - n as base")
    ranked = pieces.join(bases, (F.col("length") == F.col("base_length")) & (F.col("part") == F.col("base_part"))).withColumn("rank", F.col("base") + F.col("local_rank"))
    slotted = ranked.join(F.broadcast(placed), (F.col("length") == F.col("at_length")) & (F.col("rank") >= F.col("rank_from")) & (F.col("rank") < F.col("rank_to")))
    at = F.col("rank") - F.col("rank_from")
    return slotted.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("sequence_from") + F.floor(at / F.col("per_sequence"))).cast("long").alias("sequence_id"),
        (F.col("offset_from") + (at % F.col("per_sequence")) * F.col("length")).cast("long").alias("offset"),
        *(["input_ids"] if with_ids else []),
    )


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, n_tokens and input_ids of each sequence, from ``pack(..., with_ids=True)``."""
    return packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "input_ids"))).alias("own")).select(
        "sequence_id", F.flatten("own.input_ids").alias("input_ids"), F.aggregate("own.input_ids", F.lit(0), lambda n, x: n + F.size(x)).alias("n_tokens")
    )
