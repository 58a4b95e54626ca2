"""How the sources of a language differ in their words: shares of terms by source, between pairs and against the language.

Equal texts of a language are one row with their number by source, so each is tokenised once; its terms' document
frequencies and counts are then weighted by those numbers. Pairs of sources are compared on the terms that one of them has:
all others differ by the same amount, the difference of the two shares of a count of 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakesift.llm import bits
from lakesift.llm.common import materialise, small_batches, text_of
from lakesift.llm.vocabulary import slices

LEAST_DOCUMENTS, TOP_TERMS, PRIOR, SCALE = 30, 50, 5, 1_000_000_000
#: Sources that are compared with as many others in one group of rows, and the terms in it.
TILE, TILE_TERMS = 256, 4096
#: Rows of (text, term, source), and cells of (term, source), that numpy holds at once.
HELD = 1 << 20

#: Letters of ASCII in lower case and all bytes of other characters; everything else separates terms.
_TERM_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0 for b in range(256))


def terms_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Text, term and count of each different term of each text, and the terms by number."""
    texts = pc.fill_null(texts.cast(pa.string()), "")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    source = texts.buffers()[2]
    raw = np.frombuffer(source.slice(int(offsets[0]), int(offsets[-1] - offsets[0])).to_pybytes().translate(_TERM_BYTES) if source is not None else b"", dtype=np.uint8)
    offsets = offsets - offsets[0]
    inside = raw != 0
    # a term begins where a text does or a separator was before
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    first = offsets[:-1][offsets[:-1] < len(raw)]
    begins[first] = inside[first]
    starts = np.flatnonzero(begins)
    kept = np.cumsum(inside) - inside  # places among the bytes that are kept
    bounds = np.concatenate([kept[starts], [int(inside.sum())]]).astype(np.int32)
    words = pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(raw[inside]))])
    coded = words.dictionary_encode()
    text = np.searchsorted(offsets, starts, "right") - 1
    n = max(len(coded.dictionary), 1)
    pairs, counts = np.unique(text * n + np.asarray(coded.indices).astype(np.int64), return_counts=True)
    return pairs // n, pairs % n, counts.astype(np.int64), coded.dictionary


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text", 8 << 20):
            text, term, count, names = terms_of(part.column("text"))
            shares = part.column("shares")
            sizes = np.asarray(pc.list_value_length(shares)).astype(np.int64)
            begin, flat = np.cumsum(sizes) - sizes, shares.flatten()
            lang = part.column("lang").dictionary_encode()
            own = flat.field("source").dictionary_encode()
            sources = len(own.dictionary)
            group = np.repeat(np.asarray(lang.indices).astype(np.int64), sizes) * sources + np.asarray(own.indices)
            weight = np.asarray(flat.field("n"))
            upto = np.cumsum(sizes[text])
            a = 0
            while a < len(text):  # each term of a text counts for all sources of the text
                b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + HELD)))
                k = sizes[text[a:b]]
                row = np.repeat(np.arange(a, b), k)
                share = begin[text[row]] + np.arange(len(row)) - np.repeat(np.cumsum(k) - k, k)
                key = group[share] * len(names) + term[row]
                order = np.argsort(key, kind="stable")
                key, n, c = key[order], weight[share][order], (weight[share] * count[row])[order]
                edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
                which = key[edge] // len(names)
                yield pa.RecordBatch.from_arrays(
                    [lang.dictionary.take(pa.array(which // sources)), own.dictionary.take(pa.array(which % sources)), names.take(pa.array(key[edge] % len(names))), pa.array(np.add.reduceat(n, edge)), pa.array(np.add.reduceat(c, edge))],
                    ["lang", "source", "term", "n_docs", "n"],
                )
                a = b


def _plain(docs: DataFrame) -> DataFrame:
    return docs.select(text_of("lang").alias("lang"), text_of("source").alias("source"), text_of("text").alias("text"))


def _count_alone(copied: bits.Filter):
    """Counts of the texts that occur once, where they are read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = batch.filter(pa.array(~copied.holds(np.asarray(batch.column("hash")).view(np.uint64))))
            one = pa.StructArray.from_arrays([some.column("source"), pa.array(np.ones(some.num_rows, dtype=np.int64))], ["source", "n"])
            shares = pa.ListArray.from_arrays(pa.array(np.arange(some.num_rows + 1, dtype=np.int32)), one)
            yield from _count(iter([pa.RecordBatch.from_arrays([some.column("lang"), some.column("text"), shares], ["lang", "text", "shares"])]))

    return run


def _repeated(copied: bits.Filter):
    """The rows whose texts occur more than once, and few others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(copied.holds(np.asarray(batch.column("hash")).view(np.uint64)))).select(["lang", "source", "text"])

    return run


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n_docs and n (occurrences): each different text of a language is tokenised once.

    Hashes tell which texts can occur more than once; only those move, and are collapsed by language and digest. All others are
    tokenised where they are read. The bit map of hashes has a size that doesn't grow with the documents.
    """
    own = small_batches(_plain(docs)).select("*", F.xxhash64("lang", "text").alias("hash"))
    copied = bits.build(own.groupBy("hash").agg(F.count("*").alias("copies")).where("copies > 1"), "hash")
    schema = "lang string, source string, term string, n_docs long, n long"
    alone = own.mapInArrow(_count_alone(copied), schema)
    again = own.mapInArrow(_repeated(copied), "lang string, source string, text string").select("*", F.unhex(F.sha2("text", 256)).alias("digest"))
    texts = again.groupBy("lang", "digest").agg(F.first("text").alias("text"))
    # copies are added up by source before they meet, so a text has one entry for each source
    shares = again.groupBy("lang", "digest", "source").agg(F.count("*").alias("n")).groupBy("lang", "digest").agg(F.collect_list(F.struct("source", "n")).alias("shares"))
    weighted = texts.join(shares, ["lang", "digest"]).select("lang", "text", "shares")
    counted = alone.unionAll(weighted.mapInArrow(_count, schema))
    return counted.groupBy("lang", "source", "term").agg(F.sum("n_docs").alias("n_docs"), F.sum("n").alias("n"))


def kept_terms(counts: DataFrame, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """lang, source, term, n and lang_n of the terms that enough documents of their language hold."""
    of_term = Window.partitionBy("lang", "term")  # a row for each source at most
    both = counts.withColumns({"lang_docs": F.sum("n_docs").over(of_term), "lang_n": F.sum("n").over(of_term)})
    return both.where(F.col("lang_docs") >= least).select("lang", "source", "term", "n", "lang_n")


def share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (n + PRIOR) / (total + PRIOR * terms)), exact."""
    wide = "decimal(29,0)"
    upper = (n + PRIOR).cast("decimal(19,0)") * F.lit(SCALE).cast("decimal(10,0)")
    return F.when(terms > 0, 1 + F.call_function("div", upper.cast(wide), (total + terms * PRIOR).cast(wide)))


def group_sizes(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """lang, source, place (from 0 in its language), total, terms, lang_total and sources of every group that occurs."""
    groups = _plain(docs).select("lang", "source").distinct()
    by_group = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    by_lang = kept.groupBy("lang", "term").agg(F.first("lang_n").alias("lang_n")).groupBy("lang").agg(F.count("*").alias("terms"), F.sum("lang_n").alias("lang_total"))
    sized = groups.join(by_group, ["lang", "source"], "left").join(by_lang, "lang", "left").fillna(0, ["total", "terms", "lang_total"])
    place = (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).cast("long")
    return sized.withColumns({"place": place, "sources": F.count("*").over(Window.partitionBy("lang")), "none": share(F.lit(0), F.col("total"), F.col("terms"))})


def corrections(term: np.ndarray, place: np.ndarray, value: np.ndarray, none: np.ndarray) -> np.ndarray:
    """What the terms that a source has add to the differences of pairs, beyond that of ``none`` for all terms.

    term, place and value are of what occurs, by term; ``none`` is the share of a count of 0 by place. Work and
    memory follow the number of values times the sources of a tile, ``HELD`` cells at a time.
    """
    n, out = len(none), np.zeros((len(none), len(none)), dtype=np.int64)
    base = np.abs(none[:, None] - none[None, :])
    edges = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]])) if len(term) else np.empty(0, dtype=np.int64)
    number = np.cumsum(np.concatenate([[0], term[1:] != term[:-1]])) if len(term) else np.empty(0, dtype=np.int64)
    ends, a = np.concatenate([edges[1:], [len(term)]]), 0
    while a < len(edges):
        b = max(a + 1, int(np.searchsorted(ends, edges[a] + max(HELD // n, 1), "right")))
        rows = slice(edges[a], ends[b - 1])
        own, at, p = number[rows] - a, place[rows], value[rows]
        all_values, has = np.tile(none, (b - a, 1)), np.zeros((b - a, n), dtype=bool)
        all_values[own, at], has[own, at] = p, True
        more = np.abs(p[:, None] - all_values[own]) - base[at]
        # where both sources have the term, the pair counts once: from the smaller place
        more[has[own] & (np.arange(n)[None, :] <= at[:, None])] = 0
        order = np.argsort(at, kind="stable")
        first = np.flatnonzero(np.concatenate([[True], at[order][1:] != at[order][:-1]]))
        out[at[order][first]] += np.add.reduceat(more[order], first, axis=0)
        a = b
    return out + out.T


def _tile(size: int):
    def run(key: tuple, rows: pa.Table, sources: pa.Table) -> pa.Table:
        lang, left, right, bucket = (x.as_py() for x in key)
        order = np.argsort(np.asarray(sources.column("place")))
        places, none = np.asarray(sources.column("place"))[order], np.asarray(pc.fill_null(sources.column("none"), 0))[order]
        terms = sources.column("terms")[0].as_py()
        number = np.asarray(pa.chunked_array(rows.column("term").chunks or [[]], pa.string()).combine_chunks().dictionary_encode().indices).astype(np.int64)
        at = np.searchsorted(places, np.asarray(rows.column("place")))
        order = np.lexsort((at, number))
        found = corrections(number[order], at[order], np.asarray(rows.column("value"))[order], none)
        if not bucket:
            found = found + terms * np.abs(none[:, None] - none[None, :])
        i, j = np.triu_indices(len(places), 1)
        if left != right:  # pairs within a tile have a tile of their own
            across = (places[i] // size) != (places[j] // size)
            i, j = i[across], j[across]
        return pa.table({"lang": pa.array([lang] * len(i), pa.string()), "a": places[i], "b": places[j], "part_value": found[i, j]})

    return run


def pair_values(kept: DataFrame, groups: DataFrame, tile: int = TILE, tile_terms: int = TILE_TERMS) -> DataFrame:
    """lang, a, b (places, a < b) and value of each pair of sources of a language.

    Sources are compared tile by tile, some terms at a time: a group of rows has at most 2 * ``tile``
    sources and about ``tile_terms`` terms, however many there are. Each gives the sums of its pairs, so rows by pair never outnumber the
    pairs times the groups.
    """
    buckets = F.greatest(F.ceil(F.col("terms") / tile_terms), F.lit(1)).cast("long")
    tiles = F.ceil(F.col("sources") / tile).cast("long")
    own_tile = F.floor(F.col("place") / tile).cast("long")
    met = F.explode(F.sequence(F.lit(0).cast("long"), tiles - 1))
    low, high = F.least(own_tile, F.col("other")), F.greatest(own_tile, F.col("other"))
    sized = groups.select("lang", "source", "place", "total", "terms", "none", "sources")
    rows = kept.join(sized, ["lang", "source"]).withColumn("other", met).select("lang", low.alias("low"), high.alias("high"), F.pmod(F.xxhash64("term"), buckets).alias("bucket"), "term", "place", share(F.col("n"), F.col("total"), F.col("terms")).alias("value"))
    sides = sized.withColumn("other", met).withColumn("bucket", F.explode(F.sequence(F.lit(0).cast("long"), buckets - 1))).select("lang", low.alias("low"), high.alias("high"), "bucket", "place", "none", "terms")
    keys = ("lang", "low", "high", "bucket")
    rows, sides = rows.toDF(*rows.columns), sides.toDF(*sides.columns)  # columns of their own on each side
    parts = rows.groupBy(*keys).cogroup(sides.groupBy(*keys)).applyInArrow(_tile(tile), "lang string, a long, b long, part_value long")
    return parts.groupBy("lang", "a", "b").agg(F.sum("part_value").alias("value"))


def audit(docs: DataFrame, least: int = LEAST_DOCUMENTS, top: int = TOP_TERMS) -> DataFrame:
    """lang, source, part, item, value, rank: for each source how far each other source of its language is (part
    ``pair``), and which terms it has more often than the language (part ``term``, the first ``top``).

    Null lang, source or text: the empty one. Repeated rows and texts count as often as they are there. A group without
    terms, or in a language that keeps none, has its pairs, and no row of part ``term``. Ties: the smaller item in UTF-8 first.
    Very long texts are read whole. Empty table: empty result. Other columns, whatever their names, are not read.
    """
    kept = materialise(kept_terms(term_counts(docs), least), "kept-terms")
    groups = materialise(group_sizes(docs, kept), "groups")
    names = groups.select("lang", "place", "source")
    found = pair_values(kept, groups)
    one, other = names.withColumnsRenamed({"place": "a", "source": "source_a"}), names.withColumnsRenamed({"place": "b", "source": "source_b"})
    named = found.join(one, ["lang", "a"]).join(other, ["lang", "b"])
    both = F.explode(F.array(F.struct(F.col("source_a").alias("source"), F.col("source_b").alias("item")), F.struct(F.col("source_b").alias("source"), F.col("source_a").alias("item"))))
    pairs = named.select("lang", both.alias("x"), "value").select("lang", "x.source", F.lit("pair").alias("part"), "x.item", "value")
    p, q = share(F.col("n"), F.col("total"), F.col("terms")), share(F.col("lang_n"), F.col("lang_total"), F.col("terms"))
    terms = kept.join(groups.select("lang", "source", "total", "terms", "lang_total"), ["lang", "source"]).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (p - q).alias("value")).where("value > 0")
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    return pairs.withColumn("rank", rank).unionByName(terms.withColumn("rank", rank).where(F.col("rank") <= top))
