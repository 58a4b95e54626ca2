"""An inverted file of vectors: lists around fitted centres, residuals as product codes, exact distances for what the codes find.

Centres and code words are fitted on a bounded sample; every vector is held, under the list of its nearest centre and with
the code of what is left of it. A search looks at the lists nearest to a query and measures all of their vectors
exactly. Lists are contiguous in the files, so a search opens the row groups of its lists only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lakesift.blocks import by_blocks, materialise, work_dir
from lakesift.operators.retrieval import MARGIN, PAIRS

#: Vectors on which centres and code words are fitted, at most; fixed rounds of fitting; code words of a part.
SAMPLE_ROWS, ROUNDS, WORDS = 65_536, 12, 256
#: Share of the nearest vectors that is to lie in the lists looked at, the vectors of the sample that try it, and their neighbours.
TARGET, TRIED, NEIGHBOURS = 0.98, 400, 10
#: Lists at most, whatever the number of vectors: centres go to every task.
MOST_LISTS = 4096
#: Queries that are sent to the tasks at once; cells of distances that a task holds at once; lists that a filter names.
BLOCK_QUERIES, HELD, NAMED_LISTS = 4000, 1 << 21, 512
#: Was a bound of candidates by code. A search measures all vectors of its lists, so nothing depends on it; callers may still set it.
BY_CODE = 10_000


@dataclass(frozen=True)
class Quantiser:
    """centres (lists, width), words (parts, WORDS, width of a part), and the lists that hold TARGET of a query's nearest vectors."""

    centres: np.ndarray
    words: np.ndarray
    probes: int = 1

    def lists(self, vectors: np.ndarray) -> np.ndarray:
        return np.concatenate([_squares(v, self.centres).argmin(1) for v in _few(vectors, len(self.centres))])

    def codes(self, vectors: np.ndarray, lists: np.ndarray) -> np.ndarray:
        """(vectors, parts) of bytes: the nearest word of each part of the residual."""
        rest = self._padded(vectors - self.centres[lists])
        step = self.words.shape[2]
        out = np.empty((len(vectors), len(self.words)), dtype=np.uint8)
        for p, own in enumerate(self.words):
            part = rest[:, p * step:(p + 1) * step]
            out[:, p] = np.concatenate([_squares(v, own).argmin(1) for v in _few(part, len(own))])
        return out

    def tables(self, query: np.ndarray, at: int) -> np.ndarray:
        """(parts, WORDS): squared distances of a query's residual in a list to the words of each part."""
        rest = self._padded((query - self.centres[at])[None])[0].reshape(len(self.words), 1, -1)
        return ((self.words - rest) ** 2).sum(-1)

    def _padded(self, vectors: np.ndarray) -> np.ndarray:
        return np.pad(vectors, ((0, 0), (0, self.words.shape[0] * self.words.shape[2] - vectors.shape[1])))


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a ** 2).sum(1)[:, None] - 2 * a @ b.T + (b ** 2).sum(1)[None, :]


def _few(vectors: np.ndarray, columns: int) -> Iterator[np.ndarray]:
    step = max(1, HELD // max(columns, 1))
    for a in range(0, max(len(vectors), 1), step):
        yield vectors[a:a + step]


def _means(vectors: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k centres of vectors by Lloyd's rounds; an empty one is put on the vector that is farthest from its own."""
    rng = np.random.default_rng(seed)
    centres = vectors[rng.choice(len(vectors), k, replace=False)].copy()
    for _ in range(ROUNDS):
        near = [(d.argmin(1), d.min(1)) for d in (_squares(v, centres) for v in _few(vectors, k))]
        own, far = np.concatenate([x for x, _ in near]), np.concatenate([x for _, x in near])
        counts = np.bincount(own, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, vectors)
        some = counts > 0
        centres[some] = sums[some] / counts[some, None]
        empty = np.flatnonzero(~some)
        centres[empty] = vectors[np.argsort(-far)[:len(empty)]]
    return centres


def _probes(data: np.ndarray, centres: np.ndarray, own: np.ndarray) -> int:
    """Lists from the nearest on in which TARGET of the nearest sample vectors of some sample vectors lie.

    A sample is thinner than all vectors, so its neighbours are farther, and lie in no fewer lists.
    """
    places = []
    for few in _few(data[:TRIED], len(data)):
        near = _squares(few, data)
        near[np.arange(len(few)), near.argmin(1)] = np.inf  # itself
        found = np.argsort(near, axis=1)[:, :NEIGHBOURS]
        place = np.argsort(np.argsort(_squares(few, centres), axis=1, kind="stable"), axis=1)
        places.append(place[np.arange(len(few))[:, None], own[found]].ravel())
    return int(np.quantile(np.concatenate(places), TARGET, method="higher")) + 1


def fit(vectors: DataFrame, key: str = "chunk_id", lists: int | None = None, parts: int = 16, sample_rows: int = SAMPLE_ROWS) -> Quantiser:
    """A quantiser of ``vectors`` (key, embedding), fitted on the ``sample_rows`` vectors whose keys have the smallest hashes.

    The sample is what the driver holds; equal samples give equal quantisers. By default there are about as many lists as the root of
    the number of vectors, MOST_LISTS at most.
    """
    own = vectors.where("embedding is not null")
    sample = own.select("embedding").orderBy(F.xxhash64(F.col(key)), F.xxhash64("embedding")).limit(sample_rows).toArrow().column(0).combine_chunks()
    if not len(sample):
        raise ValueError("there are no vectors to fit an index on")
    data = np.stack(sample.to_numpy(zero_copy_only=False)).astype(np.float64)
    wanted = lists or round(own.count() ** 0.5)
    centres = _means(data, max(1, min(wanted, MOST_LISTS, len(data))), 1)
    parts = min(parts, data.shape[1])
    width = -(-data.shape[1] // parts)
    near = Quantiser(centres, np.empty((0, 0, 0))).lists(data)
    rest = data - centres[near]
    rest = np.pad(rest, ((0, 0), (0, parts * width - data.shape[1])))
    words = np.stack([_means(rest[:, p * width:(p + 1) * width], min(WORDS, len(data)), 2 + p) for p in range(parts)])
    return Quantiser(centres, words, _probes(data, centres, near))


class VectorIndex:
    """The files of an index below one folder: its quantiser, and key, list and code of every vector."""

    def __init__(self, spark: SparkSession, path: str, key: str = "chunk_id"):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key

    @classmethod
    def build(cls, vectors: DataFrame, path: str | None = None, key: str = "chunk_id", **fitting) -> VectorIndex:
        """Fit a quantiser on ``vectors`` (key, embedding) and hold all of them. Rows without a vector are left aside."""
        spark = vectors.sparkSession
        own = cls(spark, path or work_dir(spark, "vector-index"), key)
        made = fit(vectors, key, **fitting)
        rows = [("centre", i, 0, x.tolist()) for i, x in enumerate(made.centres)] + [("word", p, i, x.tolist()) for p, words in enumerate(made.words) for i, x in enumerate(words)] + [("probes", made.probes, 0, [])]
        spark.createDataFrame(rows, "kind string, at int, word int, vector array<double>").coalesce(1).write.parquet(f"{own.path}/quantiser")
        own.add(vectors)
        return own

    @property
    def exists(self) -> bool:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/codes")
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where)

    def quantiser(self) -> Quantiser:
        rows = self.spark.read.parquet(f"{self.path}/quantiser").collect()
        centres = np.array([r["vector"] for r in sorted((r for r in rows if r["kind"] == "centre"), key=lambda r: r["at"])])
        words = sorted((r for r in rows if r["kind"] == "word"), key=lambda r: (r["at"], r["word"]))
        parts = words[-1]["at"] + 1
        return Quantiser(centres, np.array([r["vector"] for r in words]).reshape(parts, len(words) // parts, -1), next(r["at"] for r in rows if r["kind"] == "probes"))

    def codes(self) -> DataFrame:
        """list, key and code of all vectors held."""
        return self.spark.read.parquet(f"{self.path}/codes")

    def add(self, vectors: DataFrame) -> None:
        """Hold more vectors, under the quantiser as it is. The same vectors again are held twice: see ``extend``."""
        key, kind, held = self.key, vectors.schema[self.key].dataType.simpleString(), self.spark.sparkContext.broadcast(self.quantiser())

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            made = held.value
            for batch in batches:
                if batch.num_rows:
                    data = np.stack(batch.column(1).to_numpy(zero_copy_only=False)).astype(np.float64)
                    lists = made.lists(data)
                    codes = made.codes(data, lists)
                    yield pa.RecordBatch.from_arrays([pa.array(lists.astype(np.int32)), batch.column(0), pa.array([c.tobytes() for c in codes], pa.binary())], ["list", key, "code"])

        rows = vectors.where("embedding is not null").select(key, "embedding").mapInArrow(run, f"list int, {key} {kind}, code binary")
        # a large list spreads over several files by the hash of its keys
        rows.repartitionByRange("list", F.xxhash64(key)).sortWithinPartitions("list").write.mode("append").parquet(f"{self.path}/codes")

    def extend(self, vectors: DataFrame) -> int:
        """Hold the vectors whose keys aren't held yet; how many there were."""
        new = materialise(vectors.where("embedding is not null").select(self.key, "embedding").join(self.codes().select(self.key), self.key, "left_anti"), "new-vectors")
        n = new.count()
        if n:
            self.add(new)
        return n

    def nearest(self, vectors: DataFrame, queries: DataFrame, k: int, probes: int | None = None, refine: int = 20, query_key: str = "query_id") -> DataFrame:
        """query_key, key, distance, rank: nearly always the k nearest of ``vectors`` (key, embedding) to each row of ``queries`` (query_key, query_vector).

        All vectors in the ``probes`` lists nearest to a query (by default as many as TARGET of the neighbours took when the index was fitted) are measured exactly on ``vectors``; with as many
        probes as lists the result is exact. Codes choose none of them, so ``refine`` makes no difference any more. Vectors of ``vectors`` that the index doesn't hold aren't
        found, those it holds beyond are left out. Queries go to the tasks in blocks; a task compares a list with all queries that look at it as one product of
        matrices, measures its candidates itself and keeps the k nearest of each query, so that queries times k for each task move, however many are measured.
        """
        key, made = self.key, self.quantiser()
        looked, of_query, of_key = probes or made.probes, to_arrow_type(queries.schema[query_key].dataType), to_arrow_type(vectors.schema[key].dataType)
        kind = f"{query_key} {queries.schema[query_key].dataType.simpleString()}, {key} {vectors.schema[key].dataType.simpleString()}, distance double"
        # vectors meet their lists once for all blocks of queries, and lie by them
        joined = self.codes().select("list", key).join(vectors.where("embedding is not null").select(key, "embedding"), key)
        codes = materialise(joined.repartitionByRange("list", F.xxhash64(key)).sortWithinPartitions("list"), "by-list")
        named: list[int] = []

        def prepare(own):
            ids, data = [q for q, _ in own], np.array([v for _, v in own], dtype=np.float64)
            if data.shape[1] != made.centres.shape[1]:
                raise ValueError(f"queries of width {data.shape[1]}, vectors of width {made.centres.shape[1]}")
            near = np.concatenate([np.argsort(_squares(v, made.centres), axis=1, kind="stable")[:, :looked] for v in _few(data, len(made.centres))]).astype(np.int32)
            named[:] = np.unique(near).tolist()
            return ids, data, near

        def scan(held):
            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                ids, data, near = held.value
                order = np.argsort(near, axis=None, kind="stable")
                lists_asked, asking = near.ravel()[order], order // near.shape[1]
                squares, limit = (data ** 2).sum(1), np.full(len(ids), np.inf)
                found: list[tuple[np.ndarray, ...]] = []
                size = 0

                def best() -> tuple[np.ndarray, ...]:
                    """Number, key and distance of the k nearest of each query, in order."""
                    q, some, distance = (np.concatenate(x) for x in zip(*found, strict=True))
                    at = np.lexsort((some, distance, q))
                    at = at[np.arange(len(at)) - np.searchsorted(q[at], q[at]) < k]
                    return q[at], some[at], distance[at]

                for batch in batches:
                    if not batch.num_rows:
                        continue
                    lists = np.asarray(batch.column("list"))
                    full = np.stack(batch.column("embedding").to_numpy(zero_copy_only=False)).astype(np.float64)
                    keys = batch.column(key).to_numpy(zero_copy_only=False)
                    in_order = np.argsort(lists, kind="stable")
                    present, first = np.unique(lists[in_order], return_index=True)
                    for at, a, b in zip(present, first, [*first[1:], len(lists)], strict=True):
                        wanted = asking[slice(*np.searchsorted(lists_asked, [at, at + 1]))]
                        here = in_order[a:b]
                        for c in range(0, len(wanted), step := max(1, HELD // len(here))):
                            part = wanted[c:c + step]
                            near_by = _squares(full[here], data[part])
                            # no row that ties with the last one kept is lost to rounding
                            margin = MARGIN * (data.shape[1] + 8) * ((full[here] ** 2).sum(1).max() + squares[part])
                            i, j = np.nonzero(near_by <= limit[part] + margin)
                            q, x, distance = part[j], here[i], np.empty(len(i))
                            for d in range(0, len(i), PAIRS):
                                distance[d:d + PAIRS] = np.sqrt(((full[x[d:d + PAIRS]] - data[q[d:d + PAIRS]]) ** 2).sum(1))
                            found.append((q, keys[x], distance))
                            size += len(i)
                            if size >= HELD:
                                found = [best()]
                                q, _, distance = found[0]
                                last = np.flatnonzero(np.arange(len(q)) - np.searchsorted(q, q) == k - 1)
                                limit[q[last]] = distance[last] ** 2
                                size = 0
                if found:
                    q, some, distance = best()
                    yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in q], of_query), pa.array(some, of_key), pa.array(distance)], [query_key, key, "distance"])

            few = codes.where(F.col("list").isin(named)) if len(named) <= NAMED_LISTS else codes
            return few.select("list", key, "embedding").mapInArrow(run, kind)

        asked = queries.select(query_key, "query_vector").where("query_vector is not null")
        found = by_blocks(asked, BLOCK_QUERIES, "probes", prepare, scan, kind)
        rank = F.row_number().over(Window.partitionBy(query_key).orderBy("distance", key))
        return found.withColumn("rank", rank).where(F.col("rank") <= k)
