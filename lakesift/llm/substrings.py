"""Removal of word sequences that occur more than once, found by windows of doubling length."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakesift.llm import bits
from lakesift.llm.common import forget, gram_hashes, joined_hashes, materialise, small_batches, text_of, word_hashes, word_spans
from lakesift.llm.vocabulary import slices

WINDOW = 35
FIRST_LEVEL = 9


def levels(window: int = WINDOW, first: int = FIRST_LEVEL) -> list[int]:
    """Lengths that double (less a word where needed) from at most ``first`` up to ``window``: [9, 18, 35]."""
    out = [window]
    while out[0] > first:
        out.insert(0, -(-out[0] // 2))
    return out


def batch_words(texts: pa.Array, seeds: tuple[int, ...] = (0,)) -> tuple[np.ndarray, ...]:
    """Word hashes of all texts of a batch in a row, for each seed, and at last the offsets of each text in them."""
    raw = [(x or "").encode() for x in texts.to_pylist()]
    joined = np.frombuffer(b"\n".join(raw) + b"\n", dtype=np.uint8)
    begins = np.cumsum([0] + [len(x) + 1 for x in raw])
    starts, ends = word_spans(joined)
    return *(word_hashes(joined, starts, ends, k) if len(starts) else np.empty(0, dtype=np.uint64) for k in seeds), np.searchsorted(starts, begins)


def level_hashes(words: np.ndarray, lengths: list[int]) -> Iterator[np.ndarray]:
    """Hashes of all runs of each length: the first length's, then each from two of the length before."""
    parts, size = gram_hashes(words, lengths[0]), lengths[0]
    yield parts
    for n in lengths[1:]:
        step, size = n - size, n
        parts = joined_hashes(parts[:-step], parts[step:]) if len(parts) > step else parts[:0]
        yield parts


def window_keys(parts: np.ndarray, length: int, window: int) -> np.ndarray:
    """For each window of ``window`` words the least hash of its ``length``-word parts.

    Equal windows have equal keys, and a key stays the same over neighbouring windows.
    """
    width, least, have = window - length + 1, parts, 1
    while have < width:
        step = min(have, width - have)
        least = np.minimum(least[:-step], least[step:]) if len(least) > step else least[:0]
        have += step
    return least


def _valid(offsets: np.ndarray, window: int) -> np.ndarray:
    """Starts of the windows that lie within one document, in order."""
    counts = np.maximum(0, np.diff(offsets) - window + 1)
    total = int(counts.sum())
    return np.repeat(offsets[:-1] - (np.cumsum(counts) - counts), counts) + np.arange(total)


def _let_through(words: np.ndarray, offsets: np.ndarray, lengths: list[int], window: int, filters: list[bits.Filter]) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the windows that every filter holds, and the parts' hashes at the last of ``lengths``."""
    at, parts = _valid(offsets, window), np.empty(0, dtype=np.uint64)
    for k, parts in enumerate(level_hashes(words, lengths)):
        if not len(at):
            break
        if k < len(filters):
            at = at[filters[k].holds(window_keys(parts, lengths[k], window)[at])]
    return at, parts


def _second(words: np.ndarray, lengths: list[int]) -> np.ndarray:
    """32 further bits of the hash of every window, from other hashes of the words."""
    return (list(level_hashes(words, lengths))[-1] >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _level_keys(lengths: list[int], window: int, filters: list[bits.Filter]):
    """Keys of the last length with the number of windows, or of runs of windows, that have them, of windows the filters let through.

    At the full length a key is a window's own hash of 96 bits, ``more`` its last 32; below it ``more`` is 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "content"):
                full = lengths[-1] == window
                words, *others, offsets = batch_words(part.column("content"), (0, 1) if full else (0,))
                at, parts = _let_through(words, offsets, lengths, window, filters)
                if not len(at):
                    continue
                if full:
                    yield pa.RecordBatch.from_arrays([pa.array(parts[at].view(np.int64)), pa.array(_second(others[0], lengths)[at]), pa.array(np.ones(len(at), dtype=np.int64))], ["key", "more", "n"])
                    continue
                key = window_keys(parts, lengths[-1], window)[at]
                fresh = np.concatenate([[True], (key[1:] != key[:-1]) | (np.diff(at) != 1)])
                first = np.flatnonzero(fresh)
                last = np.concatenate([first[1:], [len(at)]]) - 1
                # a run that holds its key's part at two places has windows that may repeat each other
                width = window - lengths[-1] + 1
                begin, stop = at[first], at[last] + width
                span = stop - begin
                inner = np.repeat(begin - (np.cumsum(span) - span), span) + np.arange(int(span.sum()))
                hits = np.add.reduceat((parts[inner] == np.repeat(key[first], span)).astype(np.int64), np.cumsum(span) - span)
                names, where = np.unique(key[first], return_inverse=True)
                counts = np.bincount(where, weights=np.minimum(hits, 2)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), pa.array(np.zeros(len(names), dtype=np.int32)), pa.array(counts)], ["key", "more", "n"])

    return run


def _runs(lengths: list[int], window: int, filters: list[bits.Filter], with_hashes: bool):
    """Runs of neighbouring windows that the filters of all lengths let through.

    ``stretch`` and ``check`` are two hashes of all words of a run, from two hashes of each word. Without hashes: row, first
    place and number of windows of each run. With them: each stretch once for a batch, how often it came, and its windows' hashes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "content"):
                words, others, offsets = batch_words(part.column("content"), (0, 1))
                at, hashes = _let_through(words, offsets, lengths, window, filters)
                if not len(at):
                    continue
                doc = np.searchsorted(offsets, at, side="right") - 1
                first = np.flatnonzero(np.concatenate([[True], (np.diff(at) != 1) | (np.diff(doc) != 0)]))
                n = np.diff(np.concatenate([first, [len(at)]]))
                begin = at[first]
                named = np.array([[xxhash.xxh3_64_intdigest(x[a:b], 7) for a, b in zip(begin, begin + n - 1 + window, strict=True)] for x in (words, others)], dtype=np.uint64)
                if not with_hashes:
                    keys = [part.column(c).take(pa.array(doc[first])) for c in ("row_key", "row_more")]
                    yield pa.RecordBatch.from_arrays([*(pa.array(x.view(np.int64)) for x in named), *keys, pa.array((begin - offsets[doc[first]]).astype(np.int32)), pa.array(n.astype(np.int32))], ["stretch", "check", "row_key", "row_more", "place", "n"])
                    continue
                names, where, times = np.unique(named, axis=1, return_index=True, return_counts=True)
                sizes = n[where]
                ends = np.cumsum(sizes)
                inner = at[np.repeat(first[where] - (ends - sizes), sizes) + np.arange(ends[-1])]
                bounds = pa.array(np.concatenate([[0], ends]).astype(np.int32))
                lists = [pa.ListArray.from_arrays(bounds, pa.array(x)) for x in (hashes[inner].view(np.int64), _second(others, lengths)[inner])]
                yield pa.RecordBatch.from_arrays([*(pa.array(np.ascontiguousarray(x).view(np.int64)) for x in names), pa.array(times.astype(np.int64)), *lists], ["stretch", "check", "times", "hashes", "mores"])

    return run


def _remove(window: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, n_words, n_removed = [], [], []
            for text, own in zip(batch.column("content").to_pylist(), batch.column("runs"), strict=True):
                words = (text or "").encode().split()  # bytes split at ASCII white space alone
                removed = 0
                if own.is_valid and len(words):
                    at = _starts(own.values)
                    edge = np.zeros(len(words) + 1, dtype=np.int64)
                    edge[:] += np.bincount(at, minlength=len(words) + 1)[:len(words) + 1]
                    edge -= np.bincount(np.minimum(at + window, len(words)), minlength=len(words) + 1)[:len(words) + 1]
                    covered = np.cumsum(edge)[:-1] > 0
                    removed = int(covered.sum())
                    n = len(words)
                    words = [w for w, c in zip(words, covered.tolist(), strict=True) if not c]
                    n_words.append(n)
                else:
                    n_words.append(len(words))
                n_removed.append(removed)
                kept.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], [*names, "n_words", "n_removed", "kept_text"])

    return run


def _touched(filter_: bits.Filter):
    """The rows that the filter lets through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(filter_.holds(np.asarray(batch.column("row_key")).view(np.uint64))))

    return run


def _untouched(filter_: bits.Filter | None):
    """The other rows, as they are without a repeated window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch if filter_ is None else batch.filter(pa.array(~filter_.holds(np.asarray(batch.column("row_key")).view(np.uint64))))
            words = [x.encode().split() for x in own.column("content").to_pylist()]
            yield pa.RecordBatch.from_arrays([own.column("doc_id"), pa.array([len(w) for w in words], pa.int64()), pa.array([0] * len(words), pa.int64()), pa.array([b" ".join(w).decode() for w in words], pa.string())], ["doc_id", "n_words", "n_removed", "kept_text"])

    return run


def _starts(runs: pa.StructArray) -> np.ndarray:
    """Starts of windows, from runs of them of which all or some count."""
    out = []
    for place, n, some in zip(runs.field("place").to_pylist(), runs.field("n").to_pylist(), runs.field("some").to_pylist(), strict=True):
        out.append(place + (np.arange(n) if some is None else np.asarray(some)))
    return np.concatenate(out) if out else np.empty(0, dtype=np.int64)


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, content, and two hashes that name the row by both: 128 bits."""
    own = [F.col("doc_id"), text_of()]
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(*own).alias("row_key"), F.xxhash64(F.lit("row"), *reversed(own)).alias("row_more"), text_of().alias("content"))


def repeated_windows(docs: DataFrame, window: int = WINDOW, first: int = FIRST_LEVEL, between: list[DataFrame] | None = None) -> DataFrame | None:
    """row_key, row_more and the runs of windows of each row whose words also start elsewhere: place (in words), n, and which
    of them (null: all); None where no window repeats.

    Windows that repeat at one length alone are looked at again at twice the length, until the full length or until no
    candidate survives. Below the full length a window is represented by the least hash among its parts, so one row stands
    for a run of neighbouring windows. Between levels a bit map of the keys that repeat, of at most 8 MB,
    goes to the tasks: it can let too much through, never too little.

    What survives the full length too are runs of windows, each of which repeats (or that the bit map let through). A run
    that comes twice as a whole is settled by one row. The windows of the others are looked up one by one among the keys
    that repeat at the full length, which are exact. Counts are added up in the tasks that read the texts
    before anything moves, and a passage that many rows share is one run to all of them, so it is no burden to one task.
    ``between`` takes the tables that the result reads.
    """
    rows, lengths, filters = small_batches(_keyed(docs)), levels(window, first), []
    for k, n in enumerate(lengths, 1):
        keys = rows.select("content").mapInArrow(_level_keys(lengths[:k], window, list(filters)), "key long, more int, n long")
        twice = materialise(keys.groupBy("key", "more").agg(F.sum("n").alias("n")).where("n > 1").select("key", "more"), f"level-{n}")
        if not twice.head(1):
            return None
        filters.append(bits.build(twice, "key"))
        if k < len(lengths):
            forget(twice)
    each = rows.select("content").mapInArrow(_runs(lengths, window, filters, True), "stretch long, check long, times long, hashes array<long>, mores array<int>")
    whole = ["stretch", "check"]
    between = [] if between is None else between
    stretches = materialise(each.groupBy(*whole).agg(F.sum("times").alias("times"), F.first("hashes").alias("hashes"), F.first("mores").alias("mores")), "stretches")
    between += [twice, stretches]
    single = stretches.where("times = 1").select(*whole, F.posexplode(F.arrays_zip(F.col("hashes").alias("key"), F.col("mores").alias("more"))).alias("k", "w")).select(*whole, "k", "w.*")
    partly = single.join(twice, ["key", "more"], "left_semi").groupBy(*whole).agg(F.collect_list("k").alias("some"))
    settled = stretches.select(*whole, "times").join(partly, whole, "left").where("times > 1 or some is not null").drop("times")
    runs = rows.select("row_key", "row_more", "content").mapInArrow(_runs(lengths, window, filters, False), "stretch long, check long, row_key long, row_more long, place int, n int")
    # rows that repeat have the same runs: a set keeps each once
    return runs.join(settled, whole).groupBy("row_key", "row_more").agg(F.collect_set(F.struct("place", "n", "some")).alias("runs"))


def remove_repeats(docs: DataFrame, window: int = WINDOW, first: int = FIRST_LEVEL) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text: each text without the words that a repeated window covers.

    Words are ``[^\\x20\\x09-\\x0D]+``. Windows are judged on the input. Null or empty text: no words.
    Repeated rows: all their windows repeat. Texts of fewer than ``window`` words lose nothing.
    Empty table: empty result. Only doc_id and text are read. Rows are told apart by 128 bits of hashes
    of doc_id and text; windows by 96 bits, and runs of windows by 128, of hashes of their words.
    """
    rows, out = small_batches(_keyed(docs)), "doc_id long, n_words long, n_removed long, kept_text string"
    between: list[DataFrame] = []
    found = repeated_windows(docs, window, first, between)
    if found is None:
        return rows.mapInArrow(_untouched(None), out)
    runs = materialise(found.withColumnsRenamed({"row_key": "__of", "row_more": "__more"}), "runs")
    forget(*between)
    touched = bits.build(runs.select("__of"), "__of")
    # texts that lose nothing are done where they are read; only the others meet their runs
    free = rows.mapInArrow(_untouched(touched), out)
    some = rows.mapInArrow(_touched(touched), "doc_id long, row_key long, row_more long, content string")
    meet = (F.col("row_key") == F.col("__of")) & (F.col("row_more") == F.col("__more"))
    return free.unionAll(some.join(runs, meet, "left").select("doc_id", "content", "runs").mapInArrow(_remove(window, ["doc_id"]), out))
