"""What the operators of this subpackage share: batches of texts and numpy word hashing."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakesift.blocks import dealt, forget, materialise, work_dir  # noqa: F401

#: The separators of the word definition ``[^\x20\x09-\x0D]+``.
WORD_SEPARATORS = b"\x20\x09\x0a\x0b\x0c\x0d"
BATCH_ROWS = 1000


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, after its session was told to hand texts to Python ``BATCH_ROWS`` at a time, unless it hands over fewer.

    Whole texts are long: the session's default of 10,000 rows costs tens of megabytes for each task, several times over.
    A table of few and small files is dealt out to all cores.
    """
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(conf.get(key, "10000"))
    if now <= 0 or now > BATCH_ROWS:
        conf.set(key, str(BATCH_ROWS))
    return dealt(df)


def fresh(name: str, columns: list[str]) -> str:
    """``name``, or with underscores before it where a column is called so."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def text_of(column: str = "text"):
    """The text, a null as the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


# ------------------------------------------------------------------ hashing words in numpy
def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser, one to one: every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        x = x + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) % 2**64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


_FIRST = np.uint64(0xD6E8FEB86659FD93)


def joined_hashes(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A hash of each pair of neighbours: not linear, so nothing cancels out over longer runs."""
    with np.errstate(over="ignore"):
        return mix(left * _FIRST + right)


def range_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A hash of each ``values[start:end]`` that depends on the values and their number alone; for a few short ranges."""
    out = mix((ends - starts).astype(np.uint64), seed)
    for k in range(int((ends - starts).max(initial=0))):
        own = np.flatnonzero(starts + k < ends)
        out[own] = joined_hashes(out[own], values[starts[own] + k])
    return out


@lru_cache(maxsize=4)
def _separator_table(separators: bytes) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[list(separators)] = True
    return table


def word_spans(raw: np.ndarray, separators: bytes = WORD_SEPARATORS) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts and ends of the words of a UTF-8 text given as an array of bytes."""
    inside = np.zeros(len(raw) + 2, dtype=np.int8)
    inside[1:-1] = ~_separator_table(separators)[raw]
    edge = np.diff(inside)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


#: Words of more bytes are hashed one by one.
LONG_WORD = 128
_MASKS = np.array([(1 << (8 * n)) - 1 for n in range(9)], dtype=np.uint64)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each word's bytes, eight bytes at a time: words of up to eight bytes that differ, and have one length, never share one."""
    padded = np.concatenate([raw, np.zeros(8, dtype=np.uint8)])
    eight = np.ndarray(shape=(len(raw) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    sizes = ends - starts
    out = mix((eight[starts] & _MASKS[np.minimum(sizes, 8)]) ^ mix(sizes.astype(np.uint64), seed))
    for k in range(8, min(int(sizes.max(initial=0)), LONG_WORD), 8):
        own = np.flatnonzero((sizes > k) & (sizes <= LONG_WORD))
        out[own] = joined_hashes(out[own], eight[starts[own] + k] & _MASKS[np.minimum(sizes[own] - k, 8)])
    for i in np.flatnonzero(sizes > LONG_WORD):
        out[i] = xxhash.xxh3_64_intdigest(raw[starts[i]:ends[i]].tobytes(), seed + 1)
    return out


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of ``n`` words, in order, from runs of half the length; empty where there are fewer words."""
    if len(words) < n:
        return np.empty(0, dtype=np.uint64)
    out, k = words, 1
    while k < n:
        step = min(k, n - k)
        out, k = joined_hashes(out[:-step], out[step:]), k + step
    return out


def text_words(text: str | None, separators: bytes = WORD_SEPARATORS) -> np.ndarray:
    """Word hashes of one text; a null is an empty text."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), dtype=np.uint8)
    starts, ends = word_spans(raw, separators)
    return word_hashes(raw, starts, ends) if len(starts) else np.empty(0, dtype=np.uint64)
