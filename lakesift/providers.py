"""Models that stages call: embedders, writers and pair scorers. Those given here need no network.

A stage takes a model, or a function without arguments that makes one. Functions are called once in each Python worker and their
models kept there, so that weights are read by the executors and never travel.
"""

from __future__ import annotations

import hashlib
import json
import re
from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lakesift.functions.text import NOT_TOKEN


class Embedder(ABC):
    """Texts to vectors of one width; ``name`` is kept with the vectors."""

    name: str
    width: int

    @abstractmethod
    def vectors(self, texts: list[str]) -> np.ndarray:
        """(texts, width)"""


class Writer(ABC):
    """Prompts to replies; ``name`` is part of the key under which replies are kept."""

    name: str

    @abstractmethod
    def reply(self, prompt: str, most_tokens: int = 512) -> str: ...


class PairScorer(ABC):
    """How well each of many texts answers one query: the higher, the better."""

    name: str

    @abstractmethod
    def scores(self, query: str, texts: list[str]) -> np.ndarray: ...


@lru_cache(maxsize=4)
def _made(make: Callable):
    return make()


def loaded(model):
    """The model, in a worker: made by its function the first time it is asked for there."""
    return model if isinstance(model, (Embedder, Writer, PairScorer)) else _made(model)


def words_of(text: str) -> list[str]:
    return [w for w in re.split(NOT_TOKEN, text.lower()) if w]


@lru_cache(maxsize=200_000)  # a worker's vocabulary
def _hashed(word: str) -> int:
    return int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")


class HashingEmbedder(Embedder):
    """Unit vectors of signed token hashes: deterministic, and texts that share tokens are near.

    Where the signs of a text's tokens cancel out in all places they count without signs; only a text without tokens has no length.
    """

    def __init__(self, width: int = 64):
        self.width, self.name = width, f"hashing-{width}"

    def vectors(self, texts: list[str]) -> np.ndarray:
        words = [words_of(t) for t in texts]
        hashes = np.fromiter((_hashed(w) for own in words for w in own), dtype=np.uint64)
        place = np.repeat(np.arange(len(texts)), [len(own) for own in words]) * self.width + (hashes >> np.uint64(1)).astype(np.int64) % self.width
        out = np.bincount(place, np.where(hashes & np.uint64(1), 1.0, -1.0), len(texts) * self.width).reshape(len(texts), self.width)
        gone = ~out.any(axis=1)
        if gone.any():
            out[gone] = np.bincount(place, minlength=len(texts) * self.width).reshape(len(texts), self.width)[gone]
        norms = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norms == 0, 1, norms)


class OverlapScorer(PairScorer):
    """Share of the query's different words that a text holds."""

    name = "overlap"

    def scores(self, query: str, texts: list[str]) -> np.ndarray:
        wanted = set(words_of(query))
        return np.array([len(wanted & set(words_of(t))) / max(1, len(wanted)) for t in texts])


class ServedModel(Embedder, Writer):
    """Vectors and replies from a model server on this machine, by its JSON interface.

    The texts of one call are one request. Replies are asked for without sampling.
    """

    def __init__(self, name: str, host: str, width: int = 0, timeout: float = 120.0):
        self.name, self.host, self.width, self.timeout = name, host.rstrip("/"), width, timeout

    def _ask(self, place: str, **body) -> dict:
        from urllib.request import Request, urlopen

        data = json.dumps({"model": self.name, **body}).encode()
        with urlopen(Request(f"{self.host}/api/{place}", data, {"Content-Type": "application/json"}), timeout=self.timeout) as answer:
            return json.load(answer)

    def vectors(self, texts: list[str]) -> np.ndarray:
        if not texts:
            return np.empty((0, self.width))
        found = np.array(self._ask("embed", input=texts)["embeddings"], dtype=np.float64)
        self.width = found.shape[1]
        return found

    def reply(self, prompt: str, most_tokens: int = 512) -> str:
        return self._ask("generate", prompt=prompt, stream=False, think=False, options={"num_predict": most_tokens, "temperature": 0})["response"].strip()


class CannedWriter(Writer):
    """Replies from a table, for tests; an unknown prompt gets an empty reply."""

    name = "canned"

    def __init__(self, replies: dict[str, str] | None = None):
        self.replies = replies or {}

    def reply(self, prompt: str, most_tokens: int = 512) -> str:
        return next((answer for part, answer in self.replies.items() if part in prompt), "")


def embed_rows(rows: DataFrame, model: Embedder | Callable[[], Embedder], key: str = "chunk_id", text: str = "text", batch: int = 64) -> DataFrame:
    """key, model, embedding of each row's text, ``batch`` texts a call. A null text is embedded as an empty one."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = loaded(model)
        for part in parts:
            for a in range(0, part.num_rows, batch):
                few = part.slice(a, batch)
                found = np.ascontiguousarray(own.vectors([t or "" for t in few.column(1).to_pylist()]), dtype=np.float32)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(few.num_rows + 1) * found.shape[1], pa.int32()), pa.array(found.ravel()))
                yield pa.RecordBatch.from_arrays([few.column(0), pa.array([own.name] * few.num_rows), lists], [key, "model", "embedding"])

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, text).mapInArrow(run, f"{key} {kind}, model string, embedding array<float>")


def score_rows(rows: DataFrame, query: str, model: PairScorer | Callable[[], PairScorer], key: str = "chunk_id", text: str = "text", batch: int = 64) -> DataFrame:
    """key, rerank_score: each row's text scored against ``query`` in the tasks."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = loaded(model)
        for part in parts:
            for a in range(0, part.num_rows, batch):
                few = part.slice(a, batch)
                found = own.scores(query, [t or "" for t in few.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([few.column(0), pa.array(np.asarray(found, dtype=np.float64))], [key, "rerank_score"])

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, text).mapInArrow(run, f"{key} {kind}, rerank_score double")


def score_pairs(rows: DataFrame, model: PairScorer | Callable[[], PairScorer], keys: list[str], query: str = "query", text: str = "text", batch: int = 64) -> DataFrame:
    """``keys``, rerank_score: each row's text scored against the row's own query in the tasks, a call for each query of a batch."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = loaded(model)
        for part in parts:
            queries, texts = (part.column(c).to_pylist() for c in (query, text))
            found, by_query = np.zeros(part.num_rows), {}
            for i, q in enumerate(queries):
                by_query.setdefault(q or "", []).append(i)
            for q, at in by_query.items():
                for a in range(0, len(at), batch):
                    few = at[a:a + batch]
                    found[few] = own.scores(q, [texts[i] or "" for i in few])
            yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keys), pa.array(found)], [*keys, "rerank_score"])

    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)
    return rows.select(*keys, query, text).mapInArrow(run, f"{kinds}, rerank_score double")
