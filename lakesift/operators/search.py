"""The search pipeline: text, vectors, fusion, reranking, context, and the caches around it."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict, dataclass
from datetime import UTC, datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakesift.blocks import materialise
from lakesift.operators import fulltext, lifecycle, prompts, retrieval, statistics
from lakesift.operators.prompts import ANSWER, REPHRASE, key_of
from lakesift.operators.vector_index import VectorIndex
from lakesift.providers import Embedder, OverlapScorer, PairScorer, Writer, embed_rows, loaded, score_pairs, score_rows
from lakesift.schema import CACHE, Settings
from lakesift.store import Store

#: A reranker: a model of (query, text) pairs, or a function that makes one in each worker, or False for none.
Reranker = PairScorer | Callable[[], PairScorer] | bool


def cached(store: Store, key: str, kind: str, now: str) -> str | None:
    rows = lifecycle.cache_valid(store.table("cache"), F.lit(now).cast("timestamp")).where((F.col("hash") == key) & (F.col("type") == kind)).select("result").limit(1).collect()
    return rows[0]["result"] if rows else None


def remember(store: Store, key: str, kind: str, value: str, now: str, hours: int | None = None) -> None:
    start = datetime.fromisoformat(now)
    row = [(key, kind, value, start, start + timedelta(hours=hours) if hours else None)]
    new = store.spark.createDataFrame(row, CACHE)
    store.append({"cache": new}, {"cache": lifecycle.longest_expired(store.table("cache"), F.lit(now).cast("timestamp")).unionAll(new.select("hash"))})


def ask(store: Store, model: Writer, prompt: str, now: str) -> str:
    """A model's reply, kept for ever."""
    key = key_of([model.name, prompt])
    reply = cached(store, key, "llm", now)
    if reply is None:
        reply = model.reply(prompt)
        remember(store, key, "llm", reply, now)
    return reply


def variants(query: str, reply: str) -> str:
    """The query and up to four lines of a reply as alternatives."""
    lines = [x.strip() for x in reply.splitlines() if x.strip()][:4]
    return " OR ".join(f'"{x.replace(chr(34), chr(34) * 2)}"*' for x in [query, *lines])


@dataclass(frozen=True)
class Only:
    """What a search is about: documents changed at or after a time, with values at paths of their front matter, and chunks in a language of code."""

    since: str | None = None
    language: str | None = None
    fields: tuple[tuple[str, str], ...] = ()

    def documents(self, rows: DataFrame) -> DataFrame:
        """The documents it names. A path is dotted, as in ``author.name``; values are compared as text, and a list has the values in it."""
        if self.since is not None:
            rows = rows.where(F.col("modified_at") >= F.lit(self.since).cast("timestamp"))
        for path, value in self.fields:
            at = "$" + "".join(f"['{p}']" for p in path.split("."))
            read = F.try_parse_json("metadata")
            rows = rows.where(F.coalesce(F.try_variant_get(read, at, "string") == value, F.lit(False)) | F.coalesce(F.array_contains(F.try_variant_get(read, at, "array<string>"), value), F.lit(False)))
        return rows

    def chunks(self, rows: DataFrame) -> DataFrame:
        return rows if self.language is None else rows.where(F.lower("language") == self.language.lower())


def left_out(store: Store) -> list[str]:
    """Collections that a search which names none leaves out."""
    return [r["name"] for r in store.table("store_collections").where("not include_by_default").select("name").collect()]


def chunks_of(store: Store, collection: str | None = None, without: list[str] | None = None, only: Only = Only()) -> DataFrame:
    """Each live chunk once, with the document of the smallest id that holds its text, among those of a collection, or of all but some, and those that ``only`` names."""
    documents = only.documents(store.table("documents").where("active"))
    if collection is not None:
        documents = documents.where(F.col("collection") == collection)
    elif without:
        documents = documents.where(~F.col("collection").isin(*without))
    shown = documents.groupBy("hash").agg(F.min(F.struct("id", "title", "collection", "path")).alias("d"))
    return only.chunks(store.table("chunks")).join(shown, F.col("content_hash") == F.col("hash")).select("chunk_id", "content_hash", "seq", "pos", "len", "section_path", "chunk_type", F.col("d.id").alias("doc_id"), F.col("d.title").alias("title"), F.col("d.collection").alias("collection"))


def text_search(store: Store, query: str, count: int, settings: Settings, collection: str | None = None, only: Only = Only()) -> DataFrame:
    """The best ``count`` chunks by BM25 with score from 0 to 1. Statistics cover all live chunks, and are those that the store keeps."""
    wanted = fulltext.query(query, stemmed=True)
    without = left_out(store) if collection is None else []
    if collection is None and not without and only == Only() and statistics.stored(store):
        hits = statistics.best(store, wanted, count * 5)
    else:
        index = statistics.live_postings(store)
        total = statistics.corpus(store) if statistics.stored(store) else store.table("tokens").select("chunk_id", "dl").join(chunks_of(store).select("chunk_id"), "chunk_id", "left_semi")
        scored = fulltext.bm25_indexed(index, total, wanted)
        hits = fulltext.top(scored.join(chunks_of(store, collection, without, only).select("chunk_id"), "chunk_id", "left_semi"), count * 5, "raw_score", "chunk_id")
    fetched = fulltext.min_max(hits)
    return fetched.orderBy("raw_score", "chunk_id").limit(count)


def models(store: Store) -> list[str]:
    """Names of the models whose vectors the store holds."""
    return sorted(r["model"] for r in store.table("vectors").select("model").distinct().collect())


def vectors_of(store: Store, model: str) -> DataFrame:
    """chunk_id and embedding of one model's vectors; those of other models can't be compared with its queries."""
    held = models(store)
    if held and model not in held:
        raise ValueError(f"the index has vectors of {', '.join(held)}, not of {model}: search with that model, or index anew")
    return store.table("vectors").where(F.col("model") == model).select("chunk_id", "embedding")


def vector_index(store: Store, model: str) -> VectorIndex:
    """The store's index of one model's vectors, which lies beside its tables; made if there is none, and brought up to date."""
    own = VectorIndex(store.spark, f"{store.path}/vector-index/{model.replace('/', '_')}")
    if not own.exists:
        return VectorIndex.build(vectors_of(store, model), own.path)
    own.extend(vectors_of(store, model))
    return own


def near_of_many(store: Store, live: DataFrame, queries: DataFrame, model: str, n: int, settings: Settings) -> DataFrame:
    """query_id, chunk_id, distance, rank of the n nearest live vectors to each query: by the store's index where the settings name a number
    of lists to look at, else exact."""
    vectors = vectors_of(store, model).join(live.select("chunk_id"), "chunk_id", "left_semi")
    if settings.search.probes and vectors.head(1):
        return vector_index(store, model).nearest(vectors, queries, n, max(settings.search.probes, 0) or None)
    return retrieval.nearest_of_many(vectors, queries, n)


def hybrid(store: Store, query: str, vector: list[float], count: int, settings: Settings, collection: str | None = None, model: str | None = None, only: Only = Only()) -> DataFrame:
    """chunk_id, bm25_rank, vector_rank, rrf_score of the fused best of both sources; ``vector`` is of ``model``, by default the settings' one."""
    n = count * settings.search.candidates
    words = fulltext.ranks(text_search(store, query, n, settings, collection, only), "bm25_rank", "raw_score", "chunk_id").select("chunk_id", "bm25_rank")
    live = chunks_of(store, collection, left_out(store) if collection is None else [], only).select("chunk_id")
    model = model or settings.embedding.model
    if settings.search.probes:
        asked = store.spark.createDataFrame([(0, [float(x) for x in vector])], "query_id int, query_vector array<double>")
        near = near_of_many(store, live, asked, model, n, settings).select("chunk_id", "distance")
    else:
        near = retrieval.nearest(vectors_of(store, model).join(live, "chunk_id", "left_semi"), vector, n)
    return retrieval.fuse(words, fulltext.ranks(near, "vector_rank", "distance", "chunk_id").select("chunk_id", "vector_rank"), k=settings.search.rrf_k).limit(count)


def search(store: Store, query: str, embedder: Embedder | Callable[[], Embedder], now: str, settings: Settings | None = None, model: Writer | None = None, reranker: Reranker = OverlapScorer,
           count: int | None = None, collection: str | None = None, context: bool = True, log: Callable[[str, object], None] | None = None, only: Only = Only()) -> list[dict]:
    """The best chunks for a query, at most ``count``, as rows with scores, ranks, excerpt and context.

    A clear winner by text ends the search early, without context. Otherwise a model, where there
    is one, widens keywords or answers questions; both sources are fused, reranked and shown with
    their neighbours. Such results are kept for a day under a key that has the store's version.
    """
    settings = settings or Settings()
    count, say = count or settings.search.default_count, log or (lambda *_: None)
    version = [x for x in sorted(store.parts().items()) if x[0] != "cache"]
    without = left_out(store) if collection is None else []
    scorer, own = loaded(reranker).name if reranker else None, loaded(embedder)
    vectors_of(store, own.name)  # before anything is asked: an index of another model is an error
    key = key_of([version, own.name, query, collection, count, context, model.name if model is not None else None, scorer, asdict(settings), asdict(only)])
    kept = cached(store, key, "search", now)
    if kept is not None:
        say("cache", "hit")
        return json.loads(kept)
    first = text_search(store, query, count, settings, collection, only).persist()
    try:
        scores = sorted((r["score"] for r in first.select("score").collect()), reverse=True)
        s = settings.search
        say("text", len(scores))
        if scores and scores[0] >= s.bm25_threshold and (len(scores) == 1 or scores[0] - scores[1] >= s.bm25_gap):
            say("early", True)
            return shown(store, first.select("chunk_id", "score"), collection, context=False, without=without, only=only)
    finally:
        first.unpersist()
    words, asked = query, query
    if model is not None:
        kind = "hyde" if query.strip().endswith("?") or query.split()[:1] and query.split()[0].lower() in retrieval.QUESTION_WORDS else "rephrase"
        reply = ask(store, model, (ANSWER if kind == "hyde" else REPHRASE).format(query=query), now)
        words, asked = (query, reply or query) if kind == "hyde" else (variants(query, reply), query)
        say(kind, reply)
    fused = hybrid(store, words, [float(x) for x in own.vectors([asked])[0]], count * s.candidates, settings, collection, own.name, only)
    best = fulltext.ranks(fused, "hybrid_rank", F.desc("rrf_score"), F.asc_nulls_last("bm25_rank"), F.asc_nulls_last("vector_rank"))
    if not reranker:
        results = best.where(F.col("hybrid_rank") <= count).withColumn("score", F.col("rrf_score"))
    else:
        few = best.where(F.col("hybrid_rank") <= s.rerank * count)
        scored = score_rows(with_text(store, few, chunks_of(store, collection, without, only)), query, reranker)
        results = retrieval.rerank(few.join(scored, "chunk_id"), F.col("rerank_score"), count)
    rows = shown(store, results.select("chunk_id", "score", "bm25_rank", "vector_rank"), collection, context, without, only)
    if rows:
        remember(store, key, "search", json.dumps(rows), now, s.cache_ttl_hours)
    return rows


def search_many(store: Store, queries: DataFrame, embedder: Embedder | Callable[[], Embedder], settings: Settings | None = None, reranker: Reranker = OverlapScorer, count: int | None = None,
                collection: str | None = None, context: bool = True, only: Only = Only(), model: Writer | Callable[[], Writer] | None = None, now: str | None = None) -> DataFrame:
    """query_id, place, chunk_id, doc_id, title, collection, section_path, chunk_type, score, bm25_rank, vector_rank, excerpt and
    context of the ``count`` best chunks of each row of ``queries`` (query_id, query): the stages of ``search`` as one plan over all queries.

    A query is taken for any of its words, not as a phrase. Queries whose best text stands far before the second end there, without
    context; the others are fused with the nearest vectors, reranked, and shown with their neighbours. Query texts are embedded and
    scored in the tasks; the driver holds nothing of queries or results but a block of query vectors at a time. A null or empty
    query has its nearest vectors only. ids of queries are different and not null. A ``model`` is asked about the queries that didn't end
    early, in the tasks, once for equal ones and never for what the cache has (``prompts.replies``), whose times are seen from ``now``.
    """
    settings = settings or Settings()
    s, count, name = settings.search, count or settings.search.default_count, loaded(embedder).name
    own = materialise(queries.select("query_id", F.coalesce(F.col("query").cast("string"), F.lit("")).alias("query")), "queries")
    n = count * s.candidates * s.candidates
    without = left_out(store) if collection is None else []
    shown_of = materialise(chunks_of(store, collection, without, only), "shown")
    texts = statistics.live_texts(store)
    if collection is not None or without or only != Only():
        texts = texts.join(shown_of.select("chunk_id"), "chunk_id", "left_semi")

    def hits(asked_for: DataFrame, kept: str) -> DataFrame:
        words = fulltext.words_of_queries(asked_for, stemmed=True)
        held = store.table("statistics").join(words.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("n_docs").alias("n_docs")).where("n_docs > 0")
        return materialise(fulltext.bm25_of_texts(texts, statistics.corpus(store), held, words, n), kept)

    by_text = hits(own, "by-text")
    few = fulltext.min_max_of_many(by_text.where(F.col("rank") <= count * 5)).where(F.col("rank") <= count)
    first = materialise(few, "first")
    early = fulltext.early_of_many(first, s.bm25_threshold, s.bm25_gap)
    asked_for = own.join(early, "query_id", "left_anti")
    if model is not None:
        wide = prompts.widened(store, asked_for, model, now or datetime.now(UTC).strftime("%Y-%m-%d %H:%M:%S"))
        by_text, asked_for = hits(wide.select("query_id", F.col("words").alias("query")), "by-words"), wide.select("query_id", F.col("asked").alias("query"))
    asked = embed_rows(asked_for, embedder, key="query_id", text="query", batch=settings.embedding.batch).select("query_id", F.col("embedding").alias("query_vector"))
    near = near_of_many(store, shown_of, asked, name, n, settings)
    late = by_text.join(early, "query_id", "left_anti").select("query_id", "chunk_id", F.col("rank").alias("bm25_rank"))
    fused = retrieval.fuse_of_many(late, near.select("query_id", "chunk_id", F.col("rank").alias("vector_rank")), count * s.candidates, k=s.rrf_k)
    if reranker:
        best = materialise(fused.where(F.col("hybrid_rank") <= s.rerank * count), "fused")
        pairs = with_text(store, best, shown_of).join(own, "query_id")
        ranked = retrieval.rerank_of_many(best.join(score_pairs(pairs, reranker, ["query_id", "chunk_id"]), ["query_id", "chunk_id"]), count)
    else:
        ranked = fused.where(F.col("hybrid_rank") <= count).withColumns({"place": F.col("hybrid_rank"), "score": F.col("rrf_score")})
    columns = ("query_id", "place", "chunk_id", "score", "bm25_rank", "vector_rank", "is_early")
    clear = first.join(early, "query_id").select("query_id", F.col("rank").alias("place"), "chunk_id", "score", F.lit(None).cast("int").alias("bm25_rank"), F.lit(None).cast("int").alias("vector_rank"), F.lit(True).alias("is_early"))
    results = materialise(ranked.withColumn("is_early", F.lit(False)).select(*columns).unionByName(clear), "results")
    rows = with_text(store, results, shown_of).withColumnRenamed("text", "excerpt")
    if context:
        rows = retrieval.with_context(rows, store.table("chunks"), store.table("content")).withColumn("context", F.when(~F.col("is_early"), F.col("context")))
    return rows.drop("content_hash", "seq", "pos", "len", "is_early")


def with_text(store: Store, rows: DataFrame, chunks: DataFrame) -> DataFrame:
    """A few rows with their chunks and texts; texts come last and only for them."""
    own = rows.join(chunks, "chunk_id")
    return own.join(store.table("content").select("hash", "doc"), F.col("hash") == F.col("content_hash")).withColumn("text", F.substring("doc", F.col("pos") + 1, F.col("len"))).drop("doc", "hash")


def shown(store: Store, results: DataFrame, collection: str | None, context: bool, without: list[str] | None = None, only: Only = Only()) -> list[dict]:
    rows = with_text(store, results, chunks_of(store, collection, without, only)).withColumnRenamed("text", "excerpt")
    if context:
        rows = retrieval.with_context(rows, store.table("chunks"), store.table("content"))
    return [r.asDict() for r in rows.orderBy(F.desc("score"), "chunk_id").drop("content_hash", "pos", "len").collect()]
