"""Vector search, rank fusion, query shapes, reranking and context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakesift.blocks import by_blocks
from lakesift.functions.text import tokens

# The first words of questions that are answered before they are searched.
QUESTION_WORDS = ("how", "what", "why", "when", "where", "who", "explain", "describe", "define", "summarise", "summarize")
#: A side that is sent to every task may have this many rows; beyond it the join shuffles.
SMALL_ROWS = 10_000
#: Rounding of an expanded squared distance, for each dimension and as a share of the squared norms; and pairs compared exactly at once.
MARGIN, PAIRS = 8 * 2.0**-52, 200_000


def l2(a: Column, b: Column) -> Column:
    """Euclidean distance of two arrays of numbers, in double precision; of unlike lengths, or with a null among them, it is an error."""
    squares = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    total = F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x))
    fits = F.size(a) == F.size(b)
    unlike = F.raise_error(F.concat(F.lit("vectors of unlike widths: "), F.size(a).cast("string"), F.lit(" and "), F.size(b).cast("string")))
    return F.when(a.isNull() | b.isNull() | fits, total).otherwise(unlike.cast("double"))


def nearest(vectors: DataFrame, query: list[float], k: int, key: str = "chunk_id") -> DataFrame:
    """The k nearest rows of ``vectors`` (key, embedding) to one query vector: each task keeps k. Rows without a vector are left aside; a vector of another width is an error."""
    distance = l2(F.col("embedding"), F.array(*[F.lit(float(x)) for x in query]))
    return vectors.where("embedding is not null").withColumn("distance", distance).drop("embedding").orderBy("distance", key).limit(k)


def nearest_of_many(vectors: DataFrame, queries: DataFrame, k: int, key: str = "chunk_id", query_key: str = "query_id") -> DataFrame:
    """query_key, key, distance, rank: the k nearest rows to each row of ``queries`` (query_key, query_vector).

    Queries go to the tasks in blocks of at most SMALL_ROWS, of which the driver holds one at a time. A task keeps its k best of each query before
    anything moves, so what is shuffled is queries times k for each task, whatever the vectors. Equal
    distances are settled by the key, however many rows share one.
    """
    import numpy as np
    import pandas as pd

    kind = f"{query_key} {queries.schema[query_key].dataType.simpleString()}, {key} {vectors.schema[key].dataType.simpleString()}, distance double"
    def prepare(own):
        return [q for q, _ in own], np.array([v for _, v in own], dtype=np.float64)

    def scan(held):
        def run(batches):
            (ids, matrix), best = held.value, None
            for pdf in batches:
                data = np.stack(pdf["embedding"].to_numpy()).astype(np.float64)
                for a in range(0, len(data), 1024):
                    part, new = data[a:a + 1024], [] if best is None else [best]
                    own_squares, query_squares = (part ** 2).sum(1), (matrix ** 2).sum(1)
                    near = own_squares[:, None] - 2 * part @ matrix.T + query_squares[None, :]
                    place = min(k, len(part)) - 1
                    # the k-th by rounded distances and what rounding may move: no row that ties with it is lost
                    limit = np.partition(near, place, axis=0)[place] + MARGIN * (matrix.shape[1] + 8) * (own_squares.max() + query_squares)
                    q, row = np.nonzero(~(near > limit).T)
                    keys = pdf[key].to_numpy()[a:a + 1024]
                    edges = np.searchsorted(q, np.arange(len(ids) + 1))
                    first = 0
                    while first < len(ids):
                        last = max(first + 1, int(np.searchsorted(edges, edges[first] + PAIRS, "right")) - 1)
                        x, y = q[edges[first]:edges[last]], row[edges[first]:edges[last]]
                        exact = np.sqrt(((part[y] - matrix[x]) ** 2).sum(-1))
                        new.append(pd.DataFrame({"q": x, key: keys[y], "distance": exact}).sort_values(["q", "distance", key]).groupby("q").head(k))
                        first = last
                    best = pd.concat(new).sort_values(["q", "distance", key]).groupby("q").head(k)
            if best is not None and len(best):
                yield pd.DataFrame({query_key: [ids[i] for i in best["q"]], key: best[key].to_numpy(), "distance": best["distance"].to_numpy()})

        return vectors.select(key, "embedding").mapInPandas(run, kind)

    found = by_blocks(queries.select(query_key, "query_vector"), SMALL_ROWS, "queries", prepare, scan, kind)
    rank = F.row_number().over(Window.partitionBy(query_key).orderBy("distance", key))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def fuse(by_text: DataFrame, by_vector: DataFrame, key: str = "chunk_id", k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of two ranked lists (key, bm25_rank) and (key, vector_rank): key, ranks, rrf_score, best first."""
    both = by_text.join(by_vector, key, "full_outer")
    parts = [F.coalesce(1.0 / (k + F.col(c)), F.lit(0.0)) for c in ("bm25_rank", "vector_rank")]
    return both.withColumn("rrf_score", parts[0] + parts[1]).orderBy(F.desc("rrf_score"), F.asc_nulls_last("bm25_rank"), F.asc_nulls_last("vector_rank"))


def fuse_of_many(by_text: DataFrame, by_vector: DataFrame, n: int, key: str = "chunk_id", query_key: str = "query_id", k: int = 60) -> DataFrame:
    """Reciprocal rank fusion by query of (query_key, key, bm25_rank) and (query_key, key, vector_rank): the n best of each query with hybrid_rank."""
    both = by_text.join(by_vector, [query_key, key], "full_outer")
    parts = [F.coalesce(1.0 / (k + F.col(c)), F.lit(0.0)) for c in ("bm25_rank", "vector_rank")]
    order = [F.desc("rrf_score"), F.asc_nulls_last("bm25_rank"), F.asc_nulls_last("vector_rank")]
    fused = both.withColumn("rrf_score", parts[0] + parts[1])
    return fused.withColumn("hybrid_rank", F.row_number().over(Window.partitionBy(query_key).orderBy(*order))).where(F.col("hybrid_rank") <= n)


def rerank_of_many(candidates: DataFrame, count: int, query_key: str = "query_id") -> DataFrame:
    """The ``count`` best candidates of each query by rerank_score, ties in their order before, numbered by place; score is count - place + 1."""
    place = F.row_number().over(Window.partitionBy(query_key).orderBy(F.desc("rerank_score"), "hybrid_rank"))
    return candidates.withColumn("place", place).where(F.col("place") <= count).withColumn("score", (F.lit(count) - F.col("place") + 1).cast("double"))


def query_kind(text: Column) -> Column:
    """hyde for a question, rephrase for keywords."""
    q = F.trim(text)
    first = F.lower(F.element_at(F.split(q, r"\s+"), 1))
    return F.when(F.endswith(q, F.lit("?")) | first.isin(*QUESTION_WORDS), "hyde").otherwise("rephrase")


def overlap_score(query: Column, text: Column) -> Column:
    """Share of the query's different tokens that the text holds: a reranker without a model."""
    own = F.array_distinct(tokens(query))
    return F.when(F.size(own) == 0, 0.0).otherwise(F.size(F.array_intersect(own, tokens(text))) / F.size(own))


def rerank(candidates: DataFrame, score: Column, count: int, before: str = "hybrid_rank") -> DataFrame:
    """The ``count`` best candidates by ``score``, ties in their order before; score becomes count - position."""
    place = F.row_number().over(Window.orderBy(F.desc("rerank_score"), before))
    return candidates.withColumn("rerank_score", score).withColumn("rerank_rank", place).where(F.col("rerank_rank") <= count).withColumn("score", (F.lit(count) - F.col("rerank_rank") + 1).cast("double"))


def with_context(results: DataFrame, places: DataFrame, contents: DataFrame, group: str = "content_hash", seq: str = "seq") -> DataFrame:
    """``results`` with the texts of the chunk before, the chunk, and the one after, joined by blank lines.

    ``places``: group, seq, pos, len of chunks; ``contents``: hash, doc. Places meet by group and number: each asks for three numbers, so
    a group's size doesn't matter. All three texts are then cut from the result's own content, and none of them moves.
    """
    wanted = results.select(F.col(group).alias("__of"), F.col(seq).alias("__at")).distinct().withColumn("__seq", F.explode(F.array(F.col("__at") - 1, F.col("__at"), F.col("__at") + 1)))
    near = places.select(F.col(group).alias("__group"), F.col(seq).alias("__near"), "pos", "len")
    joined = wanted.join(near, (F.col("__of") == F.col("__group")) & (F.col("__seq") == F.col("__near")))
    parts = joined.groupBy("__of", "__at").agg(F.sort_array(F.collect_list(F.struct("__near", "pos", "len"))).alias("__parts"))
    found = results.join(parts, (F.col(group) == F.col("__of")) & (F.col(seq) == F.col("__at"))).join(contents.select(F.col("hash").alias("__hash"), F.col("doc").alias("__doc")), F.col(group) == F.col("__hash"))
    texts = F.transform("__parts", lambda x: F.substring(F.col("__doc"), x["pos"] + 1, x["len"]))
    return found.select(*results.columns, F.array_join(texts, "\n\n").alias("context"))


def windowed_context(chunks: DataFrame, group: str, seq: str, text: str) -> DataFrame:
    """Context of every chunk at once, by a window over its group."""
    w = Window.partitionBy(group).orderBy(seq).rowsBetween(-1, 1)
    return chunks.withColumn("context", F.array_join(F.collect_list(text).over(w), "\n\n"))
