"""Benchmark decontamination: CGK embedding, bit-sampling LSH and exact edit distance over words."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakesift.blocks import by_blocks
from lakesift.llm.common import joined_hashes, mix, small_batches, text_of, word_hashes, word_spans
from lakesift.llm.vocabulary import slices

#: A window is a copy of an item of n words if their word edit distance is at most n * MAX_EDITS.
MAX_EDITS = 0.2
#: Independent random walks, steps of each, and (samples, places) that are drawn from each walk: a sample has PLACES of the
#: steps, the first among them. Chosen for a recall of 0.99 at the largest distance (tests/llm/test_decontamination.py).
WALKS, STEPS, SAMPLES, PLACES = 3, 8, 2, 4
#: Places of the text that a sample has to look at.
DIFFERENT = 3
#: Items of fewer words may differ in one word at most, and are found without walks.
SHORT = 10
#: Items that one pass over the documents compares; more items take more passes.
BLOCK = 5_000
#: Numbers (words of windows, or cells of a band) that are worked on at once.
CELLS = 4_000_000
#: Everything in ASCII but letters and digits separates words.
SEPARATORS = bytes(c for c in range(128) if not chr(c).isalnum())
PAD = np.uint64(0)
NO_KEY = np.uint64(2**64 - 1)
ODD = np.uint64(0xD6E8FEB86659FD93)


def normal_words(text: str) -> np.ndarray:
    """Word hashes of a text in lower case."""
    raw = np.frombuffer(text.encode(), dtype=np.uint8)
    starts, ends = word_spans(raw, SEPARATORS)
    return word_hashes(raw, starts, ends) if len(starts) else np.empty(0, dtype=np.uint64)


def walks(words: np.ndarray, walk: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each of STEPS steps of the walk from each word, what is emitted and where the pointer is: the CGK embedding of the text there.

    A pointer walks over the words: each step emits the word under it (its hash for this walk) and moves on, or stays, by a random bit of step and
    word. Texts at a small edit distance fall into step again after each edit, so that their embeddings differ in few places:
    edit distance becomes Hamming distance. The walk from a word is the same in a document and in an item, and it doesn't
    depend on what follows the window, so one embedding of a document serves windows of all item sizes. Past the end: PAD.
    """
    own = mix(np.concatenate([words, np.full(STEPS, PAD)]), 1 + walk)
    at, emitted, places = np.arange(len(words), dtype=np.int32), [], []
    for j in range(STEPS):
        emitted.append(own[at])
        places.append(at)
        at = at + ((emitted[j] >> np.uint64(j)) & np.uint64(1)).astype(np.int32)
    return emitted, places


def sample_places(walk: int) -> np.ndarray:
    """(SAMPLES, PLACES) steps of a walk: the first, and others by lot."""
    draw = np.random.Generator(np.random.PCG64([41, walk]))
    return np.stack([np.concatenate([[0], np.sort(1 + draw.choice(STEPS - 1, size=PLACES - 1, replace=False))]) for _ in range(SAMPLES)])


def sample_keys(words: np.ndarray, short: bool) -> Iterator[np.ndarray]:
    """For each walk and sample a key of the text that begins at each word: equal keys are a collision in that sample.

    A sample that looks at fewer than DIFFERENT places of the text is NO_KEY: a word or two are too common to tell anything.
    ``short`` gives the keys of items of fewer than SHORT words instead, of which at most one may be edited: each word, and each
    pair of neighbours. An item of two words or more keeps a pair whatever is edited, so nothing is lost.
    """
    if short:
        yield words
        yield joined_hashes(words, np.append(words[1:], PAD))
        return
    for walk in range(WALKS):
        emitted, at = walks(words, walk)
        for places in sample_places(walk):
            key, different = emitted[0], np.ones(len(words), dtype=np.int8)
            with np.errstate(over="ignore"):
                for i, j in zip(places[:-1], places[1:], strict=True):
                    key = key * ODD + emitted[j]
                    different += at[i] != at[j]
            yield np.where(different >= DIFFERENT, mix(key), NO_KEY)


def edit_distances(a: np.ndarray, b: np.ndarray, most: int | None = None, sizes: np.ndarray | None = None) -> np.ndarray:
    """Exact edit distance of each pair of rows of n words, where it is at most ``most``; else most + 1. Of the rows of ``a`` the
    first ``sizes`` words count.

    Only the cells at most ``most`` off the diagonal are computed: cell c of row i stands for column i + c - most.
    """
    m, n = a.shape
    k = n if most is None else min(most, n)
    far = n + 1
    span = np.arange(2 * k + 1)
    beyond = np.concatenate([np.zeros((m, k), dtype=b.dtype), b, np.zeros((m, k), dtype=b.dtype)], axis=1)
    row = np.broadcast_to(np.where(span >= k, span - k, far), (m, 2 * k + 1)).astype(np.int32)
    out = np.full(m, far, dtype=np.int32)
    for i in range(1, n + 1):
        column = span + i - k
        best = row + (a[:, i - 1:i] != beyond[:, i - 1:i + 2 * k])  # from (i - 1, column - 1)
        best[:, :-1] = np.minimum(best[:, :-1], row[:, 1:] + 1)
        best[:, (column < 1) | (column > n)] = far
        if i <= k:
            best[:, k - i] = i
        row = np.minimum(np.minimum.accumulate(best - span, axis=1) + span, far).astype(np.int32)
        if sizes is not None and i >= n - k:
            out = np.where(sizes == i, row[:, n - i + k], out)
    return np.minimum(row[:, k] if sizes is None else out, k + 1)


class Table(NamedTuple):
    """The items' keys of one sample in order, with item, place in it and a bit map of the keys."""

    keys: np.ndarray
    item: np.ndarray
    place: np.ndarray
    marks: np.ndarray


@dataclass(frozen=True)
class Items:
    """A block of items, with everything the scan looks up."""

    ids: np.ndarray
    words: list[np.ndarray]  # of each item
    tables: dict[bool, list[Table]]  # of each sample, for items that are short or not
    held: np.ndarray  # sorted hashes of (item, word)


def allowed(n: int, max_edits: float = MAX_EDITS) -> int:
    return int(n * max_edits)


def _of_item(words: np.ndarray, item: np.ndarray) -> np.ndarray:
    return joined_hashes(mix(item.astype(np.uint64), 5), words)


def prepare(items: list[tuple[int, str]]) -> Items:
    own = [(i, w) for i, w in ((item, normal_words(text)) for item, text in items) if len(w)]
    sizes = np.array([len(w) for _, w in own], dtype=np.int64)
    tables: dict[bool, list[Table]] = {}
    for short in (True, False):
        which = np.flatnonzero((sizes < SHORT) == short)
        tables[short] = []
        for s, each in enumerate(zip(*(sample_keys(own[k][1], short) for k in which), strict=True)):
            # a word alone stands for items of one word, a pair for longer ones
            kept = [(k, x) for k, x in zip(which, each, strict=True) if not short or (sizes[k] == 1) == (s == 0)]
            if kept:
                key, item = np.concatenate([x for _, x in kept]), np.repeat([k for k, _ in kept], [len(x) for _, x in kept])
                place = np.concatenate([np.arange(len(x)) for _, x in kept])
                key, item, place = (x[key != NO_KEY] for x in (key, item, place))
                order, marks = np.argsort(key, kind="stable"), np.zeros(1 << 20, dtype=bool)
                marks[key >> np.uint64(44)] = True
                tables[short].append(Table(key[order], item[order], place[order], marks))
            elif short:
                tables[short].append(Table(*(np.empty(0, dtype=t) for t in (np.uint64, np.int64, np.int64)), np.zeros(1 << 20, dtype=bool)))
    held = np.unique(np.concatenate([_of_item(w, np.full(len(w), k)) for k, (_, w) in enumerate(own)])) if own else np.empty(0, dtype=np.uint64)
    return Items(np.array([i for i, _ in own], dtype=np.int64), [w for _, w in own], tables, held)


def candidates(words: np.ndarray, offsets: np.ndarray, items: Items) -> np.ndarray:
    """Rows of document, item and first word of the window pointed to, of the collisions in any sample; the place may lie before the document."""
    found = [np.empty((3, 0), dtype=np.int64)]
    for short, tables in items.tables.items():
        for key, table in zip(sample_keys(words, short), tables, strict=True) if tables else ():
            at = np.flatnonzero(table.marks[key >> np.uint64(44)])
            low, high = np.searchsorted(table.keys, key[at], "left"), np.searchsorted(table.keys, key[at], "right")
            counts = high - low
            which = np.repeat(low - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))
            at = np.repeat(at, counts)
            found.append(np.stack([np.searchsorted(offsets, at, side="right") - 1, table.item[which], at - table.place[which]]))
    return np.unique(np.concatenate(found, axis=1), axis=1)


def matches(words: np.ndarray, offsets: np.ndarray, items: Items, max_edits: float = MAX_EDITS) -> np.ndarray:
    """(document, item, distance, start, n) of the best window of each document and item.

    A collision points to a window, and an edit moves it by a word at most: all windows up to the allowed number of edits
    around it are compared that hold as many of the item's words as a match needs.
    """
    pointed = candidates(words, offsets, items)
    sizes = np.array([len(w) for w in items.words], dtype=np.int64)
    found = [np.empty((0, 5), dtype=np.int64)]
    for n in map(int, np.unique(sizes[pointed[1]])):
        k, own = allowed(n, max_edits), pointed[:, sizes[pointed[1]] == n]
        step = max(1, CELLS // (n + 2 * k))
        for a in range(0, own.shape[1], step):
            windows = _likely(words, offsets, items, own[:, a:a + step], n, k)
            if windows.shape[1]:
                found.append(_compared(words, offsets, items, windows, n, k))
    rows = np.concatenate(found)
    rows = rows[np.lexsort((rows[:, 3], rows[:, 2], rows[:, 1], rows[:, 0]))]
    first = np.concatenate([[True], (rows[1:, :2] != rows[:-1, :2]).any(axis=1)]) if len(rows) else np.empty(0, dtype=bool)
    rows = rows[first]
    rows[:, 1] = items.ids[rows[:, 1]]
    return rows


def _likely(words, offsets, items: Items, pointed: np.ndarray, n: int, k: int) -> np.ndarray:
    """Rows of document, item, start and least possible distance: the windows around the places that may be within ``k`` edits.

    A window lacks at most as many of the item's words as it has edits. Windows lie within their document.
    """
    doc, item, start = pointed
    first, last = offsets[doc], np.maximum(offsets[doc], offsets[doc + 1] - n)
    near_enough = (start >= first - k) & (start <= last + k)  # further off, no window of the document fits with so few edits
    doc, item, start, first, last = (x[near_enough] for x in (doc, item, start, first, last))
    at = start[:, None] + np.arange(-k, n + k)
    inside = (at >= offsets[doc][:, None]) & (at < offsets[doc + 1][:, None])
    own = _of_item(words[np.where(inside, at, 0)], item[:, None])
    place = np.minimum(np.searchsorted(items.held, own), len(items.held) - 1)
    sums = np.zeros((len(doc), n + 2 * k + 1), dtype=np.int64)
    np.cumsum((items.held[place] == own) & inside, axis=1, out=sums[:, 1:])
    near = np.clip(start[:, None] + np.arange(-k, k + 1), first[:, None], last[:, None])
    column = near - start[:, None] + k
    holds = np.take_along_axis(sums, column + n, 1) - np.take_along_axis(sums, column, 1)
    row, which = np.nonzero(holds >= n - k)
    windows, kept = np.unique(np.stack([doc[row], item[row], near[row, which]]), axis=1, return_index=True)
    return np.concatenate([windows, np.maximum(0, n - holds[row, which])[None, kept]])


def _compared(words, offsets, items: Items, windows: np.ndarray, n: int, k: int) -> np.ndarray:
    """(document, item, distance, start, n) of windows within ``k`` edits, the nearest of each document and item among them.

    Few edits are looked for first, in a narrow band; documents and items without such a window are looked at again.
    """
    out, limit = [np.empty((0, 5), dtype=np.int64)], min(k, 3)
    while windows.shape[1]:
        now = windows[:, windows[3] <= limit]
        step = max(1, CELLS // (n + 2 * limit))
        for a in range(0, now.shape[1], step):
            doc, item, start, _ = now[:, a:a + step]
            at = start[:, None] + np.arange(n)
            own = np.where(at < offsets[doc + 1][:, None], words[np.minimum(at, len(words) - 1)], PAD)
            distance = edit_distances(own, np.stack([items.words[i] for i in item]), limit, np.minimum(n, offsets[doc + 1] - start))
            out.append(np.stack([doc, item, distance, start - offsets[doc], np.full(len(doc), n)], axis=1)[distance <= limit])
        if limit >= k:
            break
        done = np.concatenate(out)
        pair = lambda d, i: d * len(items.words) + i
        windows = windows[:, ~np.isin(pair(windows[0], windows[1]), pair(done[:, 0], done[:, 1]))]
        limit = min(k, 3 * limit)
    return np.concatenate(out)


def _scan(held: Broadcast, max_edits: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = held.value
        for batch in batches:
            for part in slices(batch, "content", 4 << 20):
                raw = [x.encode() for x in part.column("content").to_pylist()]
                joined = np.frombuffer(b"\n".join(raw) + b"\n", dtype=np.uint8)
                starts, ends = word_spans(joined, SEPARATORS)
                if not len(starts):
                    continue
                offsets = np.searchsorted(starts, np.cumsum([0] + [len(x) + 1 for x in raw]))
                rows = matches(word_hashes(joined, starts, ends), offsets, items, max_edits)
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(rows[:, 0])), *(pa.array(rows[:, k]) for k in range(1, 5))], ["doc_id", "item_id", "distance", "start_word", "n_words"])

    return run


def contaminated(docs: DataFrame, benchmark: DataFrame, max_edits: float = MAX_EDITS, block: int = BLOCK) -> DataFrame:
    """doc_id, item_id, distance, start_word, n_words: documents with a window close to an item.

    A window has as many words as the item (the whole document, where that is shorter); it is close
    if their exact edit distance over lower-case words is at most a fifth of the words. One row for
    each document and item: the smallest distance, then the first window. Items are a stated
    set, compared with all documents in blocks, one pass over the documents for each block;
    documents never move, and the driver holds one block at a time.

    Null or empty texts and items without words match nothing; rows with a null item_id aren't items. Repeated items: each is
    reported; repeated rows: each is compared. Empty tables: empty result. Other columns aren't read.
    """
    rows = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.lower(text_of()).alias("content"))
    items = benchmark.where("item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), F.lower(text_of()).alias("content")).orderBy("item_id")
    schema = "doc_id long, item_id long, distance long, start_word long, n_words long"
    return by_blocks(items, block, "items", prepare, lambda held: rows.mapInArrow(_scan(held, max_edits), schema), schema)
