"""Chosen-path similarity join of word shingle sets under Jaccard similarity."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from math import ceil, log, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakesift.llm import bits
from lakesift.llm.common import forget, fresh, gram_hashes, materialise, mix, range_hash, small_batches, text_of
from lakesift.llm.components import components
from lakesift.llm.substrings import batch_words
from lakesift.llm.vocabulary import slices

SHINGLE = 5
SIMILARITY = 0.8
#: Tokens of a set's embedding: the least hash under each of so many functions; sets share a token with probability J.
TOKENS = 64
#: Share of the links at the threshold that are to be found: runs are repeated until it is reached (``runs_for``).
TARGET = 0.995
#: Levels of splitting in each run for all sets, and for sets whose buckets are still large.
LEVELS, DEEPEST = 2, 4
#: Two sets of a bucket are compared in full unless their share of equal tokens lies so many standard deviations below the threshold.
DEVIATIONS = 5
#: Rows that one task compares with each other, by sketch and in full; larger groups are split into pairs of parts.
SKETCH_PART, PART = 1024, 256


def least_equal(similarity: float = SIMILARITY) -> int:
    """Equal tokens from which two sets of a bucket are compared in full: a pair at the threshold has as many but once in millions."""
    return max(1, ceil(TOKENS * (similarity - DEVIATIONS * sqrt(similarity * (1 - similarity) / TOKENS))))


def _multipliers() -> np.ndarray:
    return np.random.Generator(np.random.PCG64(5)).integers(0, 2**63, TOKENS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(words: np.ndarray, offsets: np.ndarray, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of all texts in a row and their offsets. A text of fewer than n words is one shingle; without words, none."""
    counts = np.diff(offsets)
    sizes = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    at = np.repeat(offsets[:-1] - bounds[:-1], sizes) + np.arange(bounds[-1])
    grams = gram_hashes(words, n)
    out = grams[np.minimum(at, max(0, len(grams) - 1))] if len(grams) else np.zeros(len(at), dtype=np.uint64)
    short = np.flatnonzero((counts > 0) & (counts < n))
    if len(short):
        out[bounds[short]] = range_hash(words, offsets[:-1][short], offsets[1:][short])
    return out, bounds


def embed(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """(sets, TOKENS) least hashes; sets must not be empty."""
    out = np.empty((len(bounds) - 1, TOKENS), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k, m in enumerate(_multipliers()):
            x = hashes * m
            out[:, k] = np.minimum.reduceat(x ^ (x >> np.uint64(32)), bounds[:-1])
    return out


def meeting(levels: int, similarity: float = SIMILARITY) -> float:
    """Probability that two sets at the threshold share a bucket of a run: at 0.8 it is 0.63, 0.47, 0.37, 0.31 after 1 to 4 levels."""
    miss = 0.0
    for _ in range(levels):
        miss = (1 - (1 - miss) / (similarity * TOKENS)) ** (similarity * TOKENS)
    return 1 - miss


def runs_for(levels: int, similarity: float = SIMILARITY) -> int:
    """Runs after which two sets at the threshold have met with probability TARGET."""
    return ceil(log(1 - TARGET) / log(1 - meeting(levels, similarity)))


def _named(tokens: np.ndarray) -> np.ndarray:
    return mix(tokens ^ mix(np.arange(TOKENS, dtype=np.uint64), 11))


def _split(named: np.ndarray, row: np.ndarray, node: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, child) of the children that rows at nodes go on to.

    At a node, each token of a set is chosen by a hash of node and token with probability
    1 / (similarity * TOKENS), and the set goes on to the child of each chosen token. Sets choose
    the same where they share a token, so about one child is shared at the threshold, and ever fewer below it.
    """
    draw = mix(named[row] ^ node[:, None], 7)
    at, which = np.nonzero(draw <= np.uint64(int(2**64 / (similarity * TOKENS)) - 1))
    return row[at], mix(draw[at, which], 9)


def chosen_paths(tokens: np.ndarray, similarity: float = SIMILARITY, runs: Iterable[int] | None = None, levels: int = LEVELS) -> tuple[np.ndarray, np.ndarray]:
    """(row, path): the buckets that each set goes to after ``levels`` splits, in every run; in the order of rows."""
    named, rows, paths = _named(tokens), [], []
    for run in range(runs_for(levels, similarity)) if runs is None else runs:
        row, node = np.arange(len(tokens)), np.full(len(tokens), mix(np.array([run], dtype=np.uint64), 3)[0])
        for _ in range(levels):
            row, node = _split(named, row, node, similarity)
        rows.append(row)
        paths.append(node)
    keep = np.unique(np.stack([np.concatenate(rows).astype(np.uint64), np.concatenate(paths)]), axis=1)
    return keep[0].astype(np.int64), keep[1]


def _tokens_of(sketches: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(sketches.to_pylist()), dtype=np.uint16).reshape(-1, TOKENS)


def _further(similarity: float):
    """The children of sets at buckets that are too large."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node = np.asarray(batch.column("bucket")).view(np.uint64)
            row, child = _split(_named(_tokens_of(batch.column("sketch")).astype(np.uint64)), np.arange(batch.num_rows), node, similarity)
            yield pa.RecordBatch.from_arrays([batch.column("set_id").take(pa.array(row)), pa.array(child.view(np.int64))], ["set_id", "bucket"])

    return run


def _more_runs(similarity: float, runs: range, levels: int):
    """Buckets of further runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                row, path = chosen_paths(_tokens_of(batch.column("sketch")).astype(np.uint64), similarity, runs, levels)
                yield pa.RecordBatch.from_arrays([batch.column("set_id").take(pa.array(row)), pa.array(path.view(np.int64))], ["set_id", "bucket"])

    return run


def _sketch(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "content"):
                hashes, bounds = shingles(*batch_words(part.column("content")))
                full = np.flatnonzero(np.diff(bounds))
                paths, sketches = [[]] * part.num_rows, [None] * part.num_rows
                if len(full):
                    tokens = embed(hashes, np.concatenate([bounds[full], bounds[-1:]]))
                    row, path = chosen_paths(tokens, similarity)
                    edges = np.searchsorted(row, np.arange(len(full) + 1))
                    small = tokens.astype(np.uint16)
                    for k, i in enumerate(full):
                        paths[i] = path[edges[k]:edges[k + 1]].view(np.int64)
                        sketches[i] = small[k].tobytes()
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("hash", "check", "doc_id")), pa.array(paths, pa.list_(pa.int64())), pa.array(sketches, pa.binary())], ["hash", "check", "doc_id", "paths", "sketch"])

    return run


def _sets(members: bits.Filter):
    """The sorted shingle hashes of the texts that the filter lets through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.asarray(batch.column("hash")).view(np.uint64)
            some = batch.filter(pa.array(members.holds(ids)))
            for part in slices(some, "content"):
                hashes, bounds = shingles(*batch_words(part.column("content")))
                own = [np.unique(hashes[a:b]).view(np.int64) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("hash"), part.column("check"), pa.array(own, pa.list_(pa.int64()))], ["hash", "check", "shingles"])

    return run


def _groups(batches: Iterator[pa.RecordBatch], by: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    """Batches that hold whole groups of equal neighbouring keys; a group has the rows of two parts at most."""
    rest = None
    for batch in batches:
        if rest is not None:
            batch = pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
        keys = [np.asarray(batch.column(c)) for c in by]
        fresh = np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in keys]))
        cut = int(fresh[-1]) + 1 if len(fresh) else 0
        if cut:
            yield batch.slice(0, cut)
        rest = batch.slice(cut)
    if rest is not None and rest.num_rows:
        yield rest


def _first_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest row that each row reaches over the pairs."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label == before).all():
            return label


def _links_of_buckets(least: int):
    """Edges (u, v) that span what is likely to be similar in each bucket: at most one for a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _groups(batches, ("bucket", "part_a", "part_b")):
            keys = [np.asarray(batch.column(c)) for c in ("bucket", "part_a", "part_b")]
            ids, own = np.asarray(batch.column("set_id")), np.asarray(batch.column("own_part"))
            sketch = _tokens_of(batch.column("sketch"))
            across = keys[1] != keys[2]
            left, right = [np.empty(0, dtype=np.int64)], [np.empty(0, dtype=np.int64)]
            for d in range(1, len(ids)):
                same = np.logical_and.reduce([k[d:] == k[:-d] for k in keys])
                if not same.any():
                    break
                i = np.flatnonzero(same & (~across[d:] | (own[d:] != own[:-d])))
                i = i[(sketch[i] == sketch[i + d]).sum(axis=1) >= least]
                left.append(i)
                right.append(i + d)
            a, b = np.concatenate(left), np.concatenate(right)
            label = _first_labels(len(ids), a, b)
            moved = np.flatnonzero(label != np.arange(len(ids)))
            if len(moved):
                edges = np.unique(np.stack([ids[moved], ids[label[moved]]]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(edges[0]), pa.array(edges[1])], ["u", "v"])

    return run


def _overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of a few hundred sets, by products of 0/1 matrices of bounded width."""
    sizes = np.array([len(s) for s in sets])
    out = np.zeros((len(sets), len(sets)), dtype=np.float64)
    values, column = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), sizes)
    often = np.bincount(column, minlength=len(values)) > 1
    place = np.cumsum(often) - 1
    shared = often[column]
    row, column = row[shared], place[column[shared]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for a in range(0, int(often.sum()), 8192):
        lo, hi = np.searchsorted(column, [a, a + 8192])
        m = np.zeros((len(sets), 8192), dtype=np.float32)
        m[row[lo:hi], column[lo:hi] - a] = 1
        out += m @ m.T
    return out


def _exact(similarity: float):
    """set_id, links, label of each set with links in a pair of parts of a cluster, by exact similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _groups(batches, ("cluster", "part_a", "part_b")):
            keys = [np.asarray(batch.column(c)) for c in ("cluster", "part_a", "part_b")]
            edges = np.concatenate([[0], np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in keys])) + 1, [batch.num_rows]])
            ids, part = np.asarray(batch.column("set_id")), np.asarray(batch.column("own_part"))
            column, found = batch.column("shingles"), []
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if b - a < 2:
                    continue
                sets = [np.asarray(column[i].values) for i in range(a, b)]
                both = _overlaps(sets)
                sizes = np.array([len(s) for s in sets], dtype=float)
                union = sizes[:, None] + sizes[None, :] - both
                good = both >= similarity * union - 1e-9
                np.fill_diagonal(good, False)
                if keys[1][a] != keys[2][a]:
                    good &= part[a:b][:, None] != part[a:b][None, :]
                x, y = np.nonzero(np.triu(good))
                label = _first_labels(b - a, x, y)
                counts = good.sum(axis=1)
                has = np.flatnonzero(counts)
                found.append(np.stack([ids[a:b][has], counts[has], ids[a:b][label[has]]]))
            if found:
                rows = np.concatenate(found, axis=1).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(r) for r in rows], ["set_id", "links", "label"])

    return run


def _in_parts(rows: DataFrame, size: str, part: int) -> DataFrame:
    """Each row once for every pair of parts it takes part in: a group of n rows has n / part parts."""
    parts = F.ceil(F.col(size) / part).cast("int")
    own = F.pmod(F.xxhash64("set_id"), parts).cast("int")
    split = rows.withColumn("own_part", own).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    return split.withColumn("part_a", F.least("own_part", "other")).withColumn("part_b", F.greatest("own_part", "other")).drop("other", size)


def _small_buckets(texts: DataFrame, similarity: float) -> DataFrame:
    """set_id, bucket, n of every bucket with two sets or more.

    Buckets of more than SKETCH_PART sets are split again, up to DEEPEST levels, and their sets take part in as many further
    runs as the deeper level needs for the same recall. What is still large then holds sets that are like each other, or that share a very
    frequent passage; it is compared part against part.
    """
    placed = texts.select("set_id", F.explode("paths").alias("bucket"))
    for levels in range(LEVELS + 1, DEEPEST + 1):
        large = materialise(placed.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > SKETCH_PART).select("bucket"), "large")
        if not large.head(1):
            break
        # what lies in large buckets is looked up once, for the split and for the further runs
        inside = materialise(placed.join(large, "bucket").join(texts.select("set_id", "sketch"), "set_id").select("set_id", "bucket", "sketch"), "inside")
        deeper = inside.mapInArrow(_further(similarity), "set_id long, bucket long")
        runs = range(runs_for(levels - 1, similarity), runs_for(levels, similarity))
        again = inside.groupBy("set_id").agg(F.first("sketch").alias("sketch")).mapInArrow(_more_runs(similarity, runs, levels), "set_id long, bucket long")
        placed = materialise(placed.join(large, "bucket", "left_anti").select("set_id", "bucket").unionAll(deeper).unionAll(again).distinct(), "placed")
        forget(inside, large)
    return placed.join(placed.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), "bucket")


def _keyed(docs: DataFrame) -> list:
    """Two hashes that name a text by both: 128 bits."""
    return [F.xxhash64(text_of()).alias("hash"), F.xxhash64(F.lit("text"), text_of()).alias("check")]


def similar_sets(docs: DataFrame, similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """(texts, links): set_id, hash, check, first_doc, copies of each different text; set_id, component, links, class of those with links.

    1. Each text is sketched where it is read; equal texts become one row with a number.
    2. Runs of recursive splitting give buckets; those with one set go.
    3. Buckets are compared by sketch, part against part, and give at most one edge for a row and part.
    4. Connected rows form clusters; in each all pairs are compared exactly, part against part, and
       counted where they are found, so pairs are never listed.
    """
    spark = docs.sparkSession
    keyed = small_batches(docs).select(*_keyed(docs), F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("content"))
    sketched = keyed.mapInArrow(_sketch(similarity), "hash long, check long, doc_id long, paths array<long>, sketch binary")
    merged = sketched.groupBy("hash", "check").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("copies"), F.first("paths").alias("paths"), F.first("sketch").alias("sketch"))
    texts = materialise(merged.withColumn("set_id", F.monotonically_increasing_id()), "texts")

    members = _in_parts(_small_buckets(texts, similarity), "n", SKETCH_PART).join(texts.select("set_id", "sketch"), "set_id")
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # in the order of ids, so that buckets which share members give the same edges: to the smallest id
    dealt = members.repartition(width, "bucket", "part_a", "part_b").sortWithinPartitions("bucket", "part_a", "part_b", "set_id")
    likely = materialise(dealt.mapInArrow(_links_of_buckets(least_equal(similarity)), "u long, v long").distinct(), "likely")

    named = texts.select("set_id", "hash", "check")
    clusters = components(likely).select(F.col("node").alias("set_id"), F.col("component").alias("cluster")).join(named, "set_id")
    clustered = clusters.join(clusters.groupBy("cluster").agg(F.count("*").alias("n")), "cluster")
    own = keyed.select("hash", "check", "content").mapInArrow(_sets(bits.build(clusters, "hash")), "hash long, check long, shingles array<long>").groupBy("hash", "check").agg(F.first("shingles").alias("shingles"))
    pairs = _in_parts(clustered.join(own, ["hash", "check"]).drop("hash", "check"), "n", PART).repartition(width, "cluster", "part_a", "part_b").sortWithinPartitions("cluster", "part_a", "part_b", "set_id")
    exact = materialise(pairs.mapInArrow(_exact(similarity), "set_id long, links long, label long"), "exact")
    classes = components(exact.where("set_id != label"), "set_id", "label")
    counted = exact.groupBy("set_id").agg(F.sum("links").alias("links"))
    first = texts.select("set_id", "first_doc").join(classes, F.col("set_id") == F.col("node")).groupBy("component").agg(F.min("first_doc").alias("class"))
    found = classes.join(first, "component").select(F.col("node").alias("set_id"), "component", "class").join(counted, "set_id", "left")
    links = materialise(found, "links")
    forget(likely, exact, classes)
    return texts.select("set_id", "hash", "check", "first_doc", "copies"), links


def jaccard_join(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with class_id, n_links, copy_id and n_copies.

    Two texts are linked if the sets of their runs of five words (``[^\\x20\\x09-\\x0D]+``) have a
    Jaccard similarity of at least ``similarity``. class_id: the smallest doc_id that links and
    copies connect to the row; n_links: other texts that are linked to the row's text; copy_id and
    n_copies: the smallest doc_id with exactly this text, and the rows that have it.

    Texts of fewer than five words: one shingle, so linked to equal words only. Null text: as empty; a text without words has
    no links, only copies. Repeated rows: copies. Null doc_id: a row as any other; its class has
    the smallest id that there is, or null. Empty table: empty result. Columns with the new names are replaced; others can
    have any name. Texts are told apart by 128 bits of hashes.
    """
    texts, links = similar_sets(docs, similarity)
    new = ("class_id", "n_links", "copy_id", "n_copies")
    kept = [c for c in docs.columns if c not in new]
    key, check, of, also = (fresh(c, docs.columns) for c in ("__key", "__check", "__hash", "__also"))
    known = texts.join(links, "set_id", "left").select(F.col("hash").alias(of), F.col("check").alias(also), F.coalesce("class", "first_doc").alias("class_id"), F.coalesce("links", F.lit(0)).alias("n_links"), F.col("first_doc").alias("copy_id"), F.col("copies").alias("n_copies"))
    rows = docs.select(*kept, *[c.alias(n) for c, n in zip(_keyed(docs), (key, check), strict=True)])
    return rows.join(known, (F.col(key) == F.col(of)) & (F.col(check) == F.col(also))).select(*kept, *new)


def one_of_each(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with one row of each class of linked or equal texts: of the text with the smallest doc_id, the row that has it.

    Rows are as in jaccard_join. A null doc_id comes after all others. Rows that repeat a doc_id with
    unlike texts are apart. Texts move once, to the class that their own hash names.
    """
    texts, links = similar_sets(docs, similarity)
    order = F.struct(F.col("first_doc").isNull(), "first_doc", "hash", "check")
    own = texts.join(links.select("set_id", "component"), "set_id", "left").groupBy(F.when(F.col("component").isNull(), F.struct("hash", "check")), "component").agg(F.min_by(F.struct("hash", "check", "first_doc"), order).alias("s"))
    key, check, of, also, first = (fresh(c, docs.columns) for c in ("__key", "__check", "__hash", "__also", "__first"))
    kept = own.select(F.col("s.hash").alias(of), F.col("s.check").alias(also), F.col("s.first_doc").alias(first))
    rows = docs.select("*", *[c.alias(n) for c, n in zip(_keyed(docs), (key, check), strict=True)]).join(kept, (F.col(key) == F.col(of)) & (F.col(check) == F.col(also)))
    return rows.where(F.col("doc_id").eqNullSafe(F.col(first))).dropDuplicates([key, check]).select(*docs.columns)
