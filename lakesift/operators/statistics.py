"""Statistics of the index that are kept as it changes: counts of live chunks by term and level of weight, as deltas.

A text is counted while an active document has it and it is indexed. A change of documents names the texts that it may
have brought to life or ended; what they add or take away is written with the change, in the same version. Chunks whose
text has ended are kept by name, so that a search leaves them out without a look at documents.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakesift.blocks import materialise
from lakesift.operators import fulltext
from lakesift.store import Store

#: Terms that one prefix may stand for in the stored counts; beyond it the postings themselves are asked.
MOST_TERMS = 2000


def term_counts(words: DataFrame, sign: int = 1, index: DataFrame | None = None) -> DataFrame:
    """term, level, n_docs, n of chunks (chunk_id, dl, tokens), and the empty term's row: their number, and that of their tokens.

    ``index`` are the postings of the same chunks with their levels, where they are there already.
    """
    index = fulltext.with_levels(fulltext.postings(words)) if index is None else index
    by_term = index.groupBy("term", "level").agg((F.count("*") * sign).alias("n_docs"), (F.sum(F.size("positions")) * sign).alias("n"))
    return by_term.unionByName(totals(words, sign))


def totals(words: DataFrame, sign: int = 1) -> DataFrame:
    one = words.agg((F.count("*") * sign).alias("n_docs"), (F.coalesce(F.sum("dl"), F.lit(0)) * sign).alias("n"))
    return one.where("n_docs != 0").select(F.lit("").alias("term"), F.lit(-1).alias("level"), "n_docs", "n")


def _sorted(counts: DataFrame) -> DataFrame:
    return counts.repartitionByRange("term").sortWithinPartitions("term", "level")


def of_change(store: Store, hashes: DataFrame, active: DataFrame) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    """(rows, gone) to append with a change of documents: ``hashes`` are the texts of the documents that change, ``active``
    (hash) those of all that are active after it. Empty where no indexed text rises or falls."""
    if not store.parts()["indexed"]:
        return {}, {}
    own = hashes.select(F.col("hash").alias("content_hash")).distinct()
    indexed = own.join(store.table("indexed").select("content_hash"), "content_hash", "left_semi")
    live = indexed.join(active.select(F.col("hash").alias("content_hash")), "content_hash", "left_semi").withColumn("live", F.lit(True))
    before = store.table("counted").withColumn("counted", F.lit(True))
    state = indexed.join(live, "content_hash", "left").join(before, "content_hash", "left").fillna(False, ["live", "counted"])
    moved = materialise(state.where("live != counted").select("content_hash", "live"), "moved")
    if not moved.head(1):
        return {}, {}
    chunks = store.table("chunks").select("chunk_id", "content_hash").join(moved, "content_hash")
    words = store.table("tokens").join(chunks, "chunk_id")
    rise, fall = (words.where(F.col("live") == x).select("chunk_id", "dl", "tokens") for x in (True, False))
    rows = {"statistics": _sorted(term_counts(rise).unionByName(term_counts(fall, -1))), "counted": moved.where("live").select("content_hash"), "dead": chunks.where("not live").select("chunk_id")}
    return rows, {"counted": moved.where("not live").select("content_hash"), "dead": chunks.where("live").select("chunk_id")}


def stored(store: Store) -> bool:
    """Whether the store keeps statistics; one that was filled before they were kept has none until it is indexed anew."""
    return bool(store.parts()["statistics"])


def live_postings(store: Store) -> DataFrame:
    """The postings of live chunks. What is dead is a short list of chunks, often none."""
    index = store.table("postings")
    return index.join(store.table("dead"), "chunk_id", "left_anti") if store.parts()["dead"] else index


def live_texts(store: Store) -> DataFrame:
    """chunk_id, tokens of live chunks."""
    own = store.table("tokens").select("chunk_id", "tokens")
    return own.join(store.table("dead"), "chunk_id", "left_anti") if store.parts()["dead"] else own


def corpus(store: Store) -> DataFrame:
    """One row: n_rows and avgdl of all live chunks, from the stored counts."""
    own = store.table("statistics").where("term = ''").agg(F.coalesce(F.sum("n_docs"), F.lit(0)).alias("n_rows"), F.sum("n").alias("n"))
    return own.select("n_rows", F.try_divide(F.col("n").cast("double"), F.col("n_rows")).alias("avgdl"))


def counts_of(store: Store, words: list[fulltext.Phrase]) -> dict[str, fulltext.TermCounts] | None:
    """Counts of the terms that words stand for, a prefix for all that begin so; None where a prefix stands for too many."""
    exact = [w.words[0] for w in words if not w.prefix]
    wanted = F.col("term").isin("", *exact)
    for w in words:
        wanted = wanted | (F.startswith("term", F.lit(w.words[0])) if w.prefix else F.lit(False))
    rows = store.table("statistics").where(wanted).groupBy("term", "level").agg(F.sum("n_docs").alias("n_docs"), F.sum("n").alias("n")).where("n_docs > 0").limit(MOST_TERMS * 20 + 1).collect()
    if len(rows) > MOST_TERMS * 20:
        return None
    whole = next((r for r in rows if not r["term"]), None)
    levels: dict[str, dict[int, int]] = {}
    for r in rows:
        if r["term"]:
            levels.setdefault(r["term"], {})[r["level"]] = r["n_docs"]
    return {t: fulltext.TermCounts(own, whole["n_docs"], whole["n"] / whole["n_docs"]) for t, own in levels.items()} if whole else {}


def best(store: Store, wanted: fulltext.Phrase | fulltext.Op, k: int) -> DataFrame:
    """chunk_id and raw_score of the k best live chunks of a query, as by ``fulltext.bm25`` over all live chunks.

    A query for any of some words reads the stored counts of its terms, then only the levels of their postings that can hold one
    of the k best. Any other query reads the postings of its terms. Neither reads lengths, documents or chunks.
    """
    index, words = live_postings(store), fulltext.alternatives(wanted)
    counts = counts_of(store, list(words)) if words else None
    if counts is not None:
        named = {w: [t for t in counts if (t.startswith(w.words[0]) if w.prefix else t == w.words[0])] for w in words}
        if all(len(terms) <= 1 for terms in named.values()):  # a prefix of several terms has the rows of all of them: counts of each don't add up
            times: dict[str, int] = {}
            for w, terms in named.items():
                for t in terms:
                    times[t] = times.get(t, 0) + words[w]
            if not times:
                return index.where("false").select("chunk_id", F.lit(0.0).alias("raw_score"))
            return fulltext.top(fulltext.best_of_levels(index, {t: counts[t] for t in times}, times, k), k, "raw_score", "chunk_id")
    return fulltext.top(fulltext.bm25_indexed(index, corpus(store), wanted), k, "raw_score", "chunk_id")


def unstemmed(store: Store, wanted: fulltext.Phrase | fulltext.Near | fulltext.Op) -> DataFrame:
    """chunk_id and raw_score of all live chunks that hold a query's words as they stand, where the index holds stems.

    ``wanted`` is a query of tokens. The index names the chunks that hold a phrase by its stems; only their texts are read, and
    their tokens counted. Lengths and the number of chunks are those that are stored.
    """
    index, phrases = live_postings(store), {p for x in wanted.phrases() for p in (x.parts if isinstance(x, fulltext.Near) else [x])}
    named = reduce(DataFrame.unionAll, [fulltext.phrase_places(index, fulltext.by_stems(p)).select("chunk_id") for p in phrases])
    places = store.table("chunks").join(named.distinct(), "chunk_id", "left_semi").select("chunk_id", "content_hash", "pos", "len")
    texts = places.join(store.table("content").select("hash", "doc"), F.col("content_hash") == F.col("hash")).select("chunk_id", F.substring("doc", F.col("pos") + 1, F.col("len")).alias("text"))
    return fulltext.bm25(fulltext.with_tokens(texts).drop("text"), wanted, corpus(store))
