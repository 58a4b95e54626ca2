"""Toxicity scores from a learned, weighted lexicon matched by Aho-Corasick over folded text."""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from math import log, log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from lakesift.llm.common import fresh, small_batches, text_of

# Letters that look like Latin ones, digits and signs that stand for letters, and
# characters without width, which are dropped.
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "о": "o", "р": "p", "ѕ": "s", "т": "t", "υ": "u", "ν": "v", "ѡ": "w", "х": "x", "у": "y",
    "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k", "ο": "o", "ρ": "p", "τ": "t", "χ": "x", "ı": "i", "ɑ": "a", "ɡ": "g",
}
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s"}
NO_WIDTH = "\u00ad\u200b\u200c\u200d\u2060\ufeff"
FULL_WIDTH = {chr(0xFF41 + i): chr(97 + i) for i in range(26)}

#: The bound of what is learned from: labelled rows that are read. Every entry and exception that they give is kept.
TRAIN_ROWS = 16_000
#: Documents that must hold an entry, and the least log ratio of its document rates.
MIN_DOCS = 3
MIN_WEIGHT = 1.5
#: Word beginnings of these lengths can be entries, besides whole words.
BEGINNINGS = (3, 4, 5, 6, 7, 8)


@dataclass(frozen=True)
class Model:
    """Weights of patterns (" begin" or " word "), phrases that are no finding, and the logistic weights."""

    lexicon: tuple[tuple[str, float], ...] = ()
    exceptions: tuple[str, ...] = ()
    logistic: tuple[float, ...] = field(default=(0.0, 0.0, 0.0, -30.0))


def folded(column: str = "text"):
    """Lower-case words between single spaces, look-alikes and substitutes as letters; all in the JVM."""
    table = HOMOGLYPHS | FULL_WIDTH | SUBSTITUTES
    plain = F.translate(F.lower(text_of(column)), "".join(table) + NO_WIDTH, "".join(table.values()))
    return F.regexp_replace(F.concat(F.lit(" "), plain, F.lit(" ")), r"[^\p{L}\p{M}]+", " ")


def is_held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


# ------------------------------------------------------------------------------- matching
@lru_cache(maxsize=2)
def _automaton(model: Model):
    import ahocorasick

    found = ahocorasick.Automaton()
    for pattern, weight in model.lexicon:
        found.add_word(pattern, (len(pattern), weight))
    for phrase in model.exceptions:
        found.add_word(phrase, (len(phrase), None))
    if len(found):
        found.make_automaton()
    return found if len(found) else None


def raw_score(model: Model, text: str) -> tuple[float, float, int]:
    """Sum over different words of the heaviest entry that begins there, the heaviest of all, and the number of words.

    A word that comes n times counts 1 + ln n times. An exception that begins at a word voids
    the word's entries, and those of words inside a phrase.
    """
    words = text.count(" ") - 1 if len(text) > 1 else 0
    found = _automaton(model)
    if found is None or words <= 0:
        return 0.0, 0.0, max(0, words)
    best: dict[int, float] = {}
    voided: list[tuple[int, int]] = []
    for end, (n, weight) in found.iter(text):
        begin = end - n + 1
        if weight is None:
            voided.append((begin, end))
        elif weight > best.get(begin, 0.0):
            best[begin] = weight
    if voided:
        starts = sorted(best)
        for a, b in voided:
            for begin in starts[bisect_left(starts, a):bisect_left(starts, b)]:
                best.pop(begin, None)
    counts = Counter((text[begin:text.find(" ", begin + 1)], weight) for begin, weight in best.items())
    return sum(w * (1 + log(n)) for (_, w), n in counts.items()), max(best.values(), default=0.0), words


def features(score: float, heaviest: float, words: int) -> tuple[float, ...]:
    """What the logistic weights apply to: the score, the score by length, the heaviest entry, and a constant."""
    return log1p(score), log1p(100.0 * score / max(words, 1)), heaviest, 1.0


def probability(model: Model, text: str) -> float:
    z = float(np.dot(model.logistic, features(*raw_score(model, text))))
    return float(1.0 / (1.0 + np.exp(-np.clip(z, -40, 40))))


# ------------------------------------------------------------------------------- learning
def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents by feature and label, combined within a task."""
    counts: tuple[Counter, Counter] = Counter(), Counter()

    def out():
        names = list(counts[0].keys() | counts[1].keys())
        return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array([c[x] for x in names], pa.int64()) for c in counts)], ["feature", "clean", "toxic"])

    for batch in batches:
        for text, toxic in zip(batch.column("folded").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
            words = set(text.split(" ")) - {""}
            counts[toxic].update({f" {w} " for w in words} | {f" {w[:k]}" for w in words for k in BEGINNINGS if len(w) >= k})
        if len(counts[0]) + len(counts[1]) > 400_000:
            yield out()
            counts = Counter(), Counter()
    yield out()


def train(docs: DataFrame, labels: DataFrame, exceptions: tuple[str, ...] = ()) -> Model:
    """Learn from the rows that aren't held out, ``TRAIN_ROWS`` of them at most, in order of a hash.

    Only doc_id and text of ``docs`` are read, and doc_id and toxic of ``labels``. One half gives the lexicon: word beginnings and words of at least ``MIN_DOCS`` toxic documents
    whose rate there is e**``MIN_WEIGHT`` times that in other documents. Words that begin so but
    are at home in clean documents become exceptions, besides the phrases given. The other half
    fits four logistic weights. Label values other than 0 and 1, and null ids, aren't used. Without toxic
    and clean rows the model finds nothing.
    """
    rows = labels.where("toxic in (0, 1) and doc_id is not null").where(~is_held_out()).select(F.col("doc_id").alias("label_id"), F.col("toxic").cast("int").alias("toxic"))
    order = F.xxhash64(F.col("label_id").cast("string"))
    # at most TRAIN_ROWS short rows: a proven size
    sample = rows.groupBy("label_id").agg(F.max("toxic").alias("toxic")).withColumn("half", F.pmod(order, F.lit(2))).orderBy(order).limit(TRAIN_ROWS)
    own = small_batches(docs).select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("label_id")).select(folded().alias("folded"), "toxic", "half").persist()
    try:
        totals = {r["toxic"]: r["n"] for r in own.where("half = 0").groupBy("toxic").agg(F.count("*").alias("n")).collect()}
        if not totals.get(0) or not totals.get(1):
            return Model(exceptions=tuple(f" {x.strip()} " for x in exceptions))
        counted = own.where("half = 0").select("folded", "toxic").mapInArrow(_document_counts, "feature string, clean long, toxic long").groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
        weight = F.log((F.col("toxic") + 0.5) / (totals[1] + 1)) - F.log((F.col("clean") + 0.5) / (totals[0] + 1))
        weighed = counted.withColumn("weight", weight).persist()
        chosen = weighed.where((F.col("toxic") >= MIN_DOCS) & (F.col("weight") >= MIN_WEIGHT)).orderBy(F.desc("toxic"), "feature").collect()
        lexicon = tuple((r["feature"], float(r["weight"])) for r in chosen)
        begins = {p for p, _ in lexicon if not p.endswith(" ")}
        clean = weighed.where((F.col("clean") >= MIN_DOCS) & (F.col("weight") < 0) & F.endswith("feature", F.lit(" ")) & F.exists(F.array(*[F.substring("feature", 1, k + 1) for k in BEGINNINGS]), lambda x: x.isin(*begins) if begins else F.lit(False)))
        void = tuple(r["feature"] for r in clean.orderBy(F.desc("clean"), "feature").collect())
        draft = Model(lexicon, tuple(dict.fromkeys([*void, *(f" {x.strip()} " for x in exceptions)])))
        weighed.unpersist()
        fitted = own.where("half = 1").select("folded", "toxic").mapInArrow(_features(draft), "x array<double>, toxic int").toPandas()
    finally:
        own.unpersist()
    return Model(draft.lexicon, draft.exceptions, _fit(np.array(fitted["x"].tolist(), dtype=float).reshape(-1, 4), fitted["toxic"].to_numpy(dtype=float)))


def _features(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [features(*raw_score(model, t)) for t in batch.column("folded").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), batch.column("toxic").cast(pa.int32())], ["x", "toxic"])

    return run


def _fit(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> tuple[float, ...]:
    """Logistic weights by Newton's method. Features with a negative weight are left out, the most negative first;
    the constant stays below zero, so that a text without a finding is never called toxic."""
    if not len(y):
        return 1.0, 1.0, 0.0, -5.0
    kept = [0, 1, 2, 3]
    while True:
        own, w = x[:, kept], np.zeros(len(kept))
        for _ in range(60):
            p = 1 / (1 + np.exp(-np.clip(own @ w, -30, 30)))
            step = np.linalg.solve((own * (p * (1 - p))[:, None]).T @ own + ridge * np.eye(len(kept)), own.T @ (p - y) + ridge * w)
            w = w - step
            if np.abs(step).max() < 1e-7:
                break
        low = int(np.argmin(w[:-1])) if len(kept) > 1 else -1
        if low < 0 or w[low] >= 0:
            break
        kept.pop(low)
    out = np.zeros(4)
    out[kept] = w
    return float(out[0]), float(out[1]), float(out[2]), min(float(out[3]), -0.05)


def _scores(model: Model, into: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [probability(model, t) for t in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(x, pa.float64())], [*batch.schema.names[:-1], into])

    return run


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), text: str = "text", into: str = "score") -> DataFrame:
    """The columns ``keep`` of ``docs`` and the score (0 to 1) of each whole text in ``into``; nothing else of a row counts.

    Null or empty text: the score of no finding. Equal texts: equal scores. Repeated rows stay. Empty table: empty
    result. Other columns of ``docs`` can have any name; one of ``keep`` that is named like ``into`` is replaced.
    """
    kept = [c for c in keep if c != into]
    last = fresh("folded", kept)
    rows = small_batches(docs).select(*kept, folded(text).alias(last))
    schema = StructType([*(f for f in rows.schema if f.name != last), StructField(into, DoubleType())])
    return rows.mapInArrow(_scores(model, into), schema)
