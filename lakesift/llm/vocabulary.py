"""Token ids of texts by the public tokenizer libraries, with a cache of words.

A vocabulary whose pre-tokenizer never joins text across white space gives a text the
concatenated ids of its white-space separated words. For those, each distinct word of a batch
is encoded once and kept by the worker (up to ``CACHE_WORDS`` words; then the cache starts
anew, which costs time only). For every other vocabulary the library gets the whole text.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CACHE_WORDS = 300_000


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def version_of(path: str) -> str:
    """Digest of the vocabulary file: the tokenizer's version."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


class Encoder:
    """Ids and counts of batches of texts, nulls as empty, without added special tokens."""

    def __init__(self, path: str):
        self.path = path
        self.known: dict[str, int] = {}
        self.store = _Store()
        self.by_word = False
        if path.endswith(".model"):
            import sentencepiece

            self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        else:
            # a task has one core: threads of the library would only hold memory
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            with open(path, encoding="utf-8") as f:
                spec = json.load(f)
            self.model = Tokenizer.from_file(path)
            self.model.no_truncation()
            self.model.no_padding()
            self.by_word = drops_white_space(spec)
            vocab, suffix = self.model.get_vocab(), (spec.get("model") or {}).get("end_of_word_suffix")
            self.ends_word = np.zeros(max(vocab.values(), default=0) + 1, dtype=bool)
            if suffix:
                self.ends_word[[i for w, i in vocab.items() if w.endswith(suffix)]] = True
            self.special = "|".join(re.escape(x["content"]) for x in spec.get("added_tokens", []))

    def _encode(self, texts: list[str]) -> list[list[int]]:
        if self.path.endswith(".model"):
            return [list(x) for x in self.model.encode(texts, num_threads=1)]
        return [x.ids for x in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def words(self, words: list[str]) -> np.ndarray:
        """The number of each word in the worker's store of ids."""
        known = self.known
        if len(known) + len(words) > CACHE_WORDS:
            known.clear()
            self.store = _Store()
        found = [known.get(w, -1) for w in words]
        missing = [w for w, k in zip(words, found, strict=True) if k < 0]
        if missing:
            # words of letters alone are one pre-token each, so a hundred of them are encoded as one text and told
            # apart by the ids that end a word
            letters = [w for w in missing if w.isalpha()]
            flat = np.array([i for x in self._encode([" ".join(letters[k:k + 100]) for k in range(0, len(letters), 100)]) for i in x], dtype="<u4")
            ends = np.flatnonzero(self.ends_word[flat]) + 1
            if len(ends) == len(letters):
                known.update(zip(letters, self.store.put(flat, np.diff(np.concatenate([[0], ends]))), strict=True))
            rest = [w for w in missing if w not in known]
            known.update(zip(rest, self.store.add(self._encode(rest)), strict=True))
            found = [known[w] for w in words]
        return np.array(found, dtype=np.int64)

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all texts and the offsets of each text in them."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if not self.by_word:
            each = self._encode(texts.to_pylist())
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in each], dtype=np.int64)])
            return np.array([i for x in each for i in x], dtype="<u4"), offsets
        number, text_of = self._split(texts)
        ids, offsets = self.store.take(number)
        return ids, offsets[text_of]

    def counts(self, texts: pa.Array) -> np.ndarray:
        """Tokens of each text."""
        if not self.by_word:
            return np.diff(self.batch(texts)[1])
        number, text_of = self._split(pc.fill_null(texts.cast(pa.large_string()), ""))
        return np.diff(np.concatenate([[0], np.cumsum(self.store.sizes[number], dtype=np.int64)])[text_of])

    def _split(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The number of each word of the batch, and the words' offsets by text."""
        # ASCII letters in lower case, and marks apart from the letters before them, are no change to this
        # tokenizer; words that differ in them alone are then one word. Special strings stay as they are.
        plain = pc.ascii_lower(pc.replace_substring_regex(texts, pattern=r"([A-Za-z])([.,;:!?])", replacement=r"\1 \2"))  # in this order: ascii_lower misreads slices
        if self.special:
            special = pc.match_substring_regex(texts, pattern=self.special, ignore_case=True)
            plain = pc.if_else(special, texts, plain)
        split = pc.ascii_split_whitespace(plain)
        coded = split.flatten().dictionary_encode()
        offsets = np.asarray(split.offsets).astype(np.int64)
        return self.words(coded.dictionary.to_pylist())[np.asarray(coded.indices)], offsets - offsets[0]


class _Store:
    """Ids of many words in one array; grows by doubling."""

    def __init__(self):
        self.ids, self.used = np.empty(1 << 16, dtype="<u4"), 0
        self.begins, self.sizes, self.n = np.empty(1 << 14, dtype=np.int64), np.empty(1 << 14, dtype=np.int64), 0

    def put(self, flat: np.ndarray, sizes: np.ndarray) -> range:
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty_like(self.ids)])
        while self.n + len(sizes) > len(self.sizes):
            self.sizes, self.begins = np.concatenate([self.sizes, np.empty_like(self.sizes)]), np.concatenate([self.begins, np.empty_like(self.begins)])
        self.ids[self.used:self.used + len(flat)] = flat
        own = range(self.n, self.n + len(sizes))
        self.sizes[own.start:own.stop] = sizes
        self.begins[own.start:own.stop] = self.used + np.cumsum(sizes) - sizes
        self.used, self.n = self.used + len(flat), own.stop
        return own

    def add(self, ids: list[list[int]]) -> range:
        return self.put(np.fromiter((i for x in ids for i in x), dtype="<u4"), np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)))

    def take(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of the words with these numbers, and the offsets of each word in them."""
        sizes = self.sizes[numbers]
        offsets = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
        return self.ids[np.repeat(self.begins[numbers] - offsets[:-1], sizes) + np.arange(offsets[-1])], offsets


def drops_white_space(spec: dict) -> bool:
    """Whether the vocabulary lowers its texts and its pre-tokenizer keeps only matches of a pattern that excludes white space."""
    steps_before = (spec.get("normalizer") or {}).get("normalizers", [])
    if [x.get("type") for x in steps_before] != ["NFC", "Replace", "Lowercase"] or (steps_before[1].get("pattern"), steps_before[1].get("content")) != ({"Regex": r"\s+"}, " "):
        return False
    pre = spec.get("pre_tokenizer") or {}
    steps = pre.get("pretokenizers", [pre])
    first = steps[0] if steps else {}
    pattern = (first.get("pattern") or {}).get("Regex", "")
    added = [x["content"] for x in spec.get("added_tokens", [])]
    return (
        first.get("type") == "Split"
        and first.get("behavior") == "Removed"
        and bool(first.get("invert"))
        and pattern == r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
        and not any(c.isspace() for c in "".join(added))
        and not any(x.get("lstrip") or x.get("rstrip") or x.get("single_word") for x in spec.get("added_tokens", []))
        and spec.get("post_processor") is None
    )


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """The worker's encoder of a vocabulary; loaded once for each Python process."""
    return Encoder(path)


def slices(table: pa.RecordBatch, column: str, limit: int = 2 << 20):
    """Parts of a batch with about ``limit`` bytes of text each, so that numpy work areas stay small."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(table.column(column)), 0)).astype(np.int64)
    group = (np.cumsum(sizes) - sizes) // limit
    edges = np.concatenate([[0], np.flatnonzero(np.diff(group)) + 1, [len(sizes)]]) if len(sizes) else [0]
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        yield table.slice(int(a), int(b - a))
