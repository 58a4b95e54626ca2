"""Byte-level BPE: words as a trie in depth-first order, last tokens handed down its branches, and decoding.

BPE has two properties that let a word be encoded from left to right. The encoding of a prefix that ends where a token
does is the encoding's own beginning, so each prefix has one last token, and what comes before it is the encoding of the
shorter prefix. And a row of tokens is an encoding if each two neighbours are one. The last token of a prefix is thus the
token that ends there and stands next to the last token of what is before it.

The different words of a batch are sorted: that is their trie in depth-first order, in which a word shares the path of its
beginning with the word before. Only the path is kept, so memory follows the longest word, not the number of words.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakesift.llm.common import fresh, small_batches, text_of
from lakesift.llm.vocabulary import slices

#: A worker's memory of words, and of steps and pairs of tokens; full ones start anew, which costs time only.
KNOWN_WORDS, KNOWN_STEPS = 300_000, 600_000
#: Texts, or ids, of so many bytes are worked on at once.
PART_BYTES = 4 << 20
NEVER = 1 << 60


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in such vocabularies: printable ones for themselves, the others from U+0100 on in order."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class State(NamedTuple):
    """Where the end of a text stands among the tokens: itself, states after one more byte, and the tokens that end it with those that may precede them."""

    text: bytes
    steps: dict[int, State]
    ending: tuple[tuple[int, int, dict[int, bool]], ...]


class ByteBpe:
    """Tables of one vocabulary and what the worker knows of its words."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        steps = spec.get("pre_tokenizer") or {}
        model = spec["model"]
        odd = [k for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges") if model.get(k)]
        if steps.get("type") != "ByteLevel" or steps.get("add_prefix_space") or not steps.get("use_regex", True) or spec.get("normalizer") or odd:
            raise ValueError(f"not a plain byte-level BPE: {path}")
        self.cut = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
        letters = byte_letters()
        raw = {token: bytes(letters[c] for c in token) for token in model["vocab"]}
        self.id_of = {raw[token]: i for token, i in model["vocab"].items()}
        self.special = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        if any(x.get("lstrip") or x.get("rstrip") or x.get("single_word") for x in spec.get("added_tokens", [])):
            raise ValueError(f"special tokens that take more than their own text: {path}")
        self.specials = re.compile("(" + "|".join(re.escape(x) for x in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.merged: dict[tuple[int, int], int] = {}  # two tokens -> the rank of their merge
        self.parts: dict[int, tuple[int, int, int]] = {}  # a token -> the two it is made of, and the rank
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            left, right = model["vocab"][a], model["vocab"][b]
            self.merged[left, right] = rank
            self.parts.setdefault(model["vocab"][a + b], (left, right, rank))
        self.sizes = {i: len(x) for x, i in self.id_of.items()}
        self.beginnings = {token[:n] for token in self.id_of for n in range(len(token) + 1)}
        self.states: dict[bytes, State] = {}
        self.follows: dict[int, dict[int, bool]] = {}
        self.noted = 0
        self.edges: tuple[dict, dict] = {}, {}
        self.words: dict[bytes, bytes] = {}  # ids of 32 bits each

    def edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """The pieces at the left (0) or right (1) border of a token while it is made, each with the rank of the merge that takes it in."""
        known = self.edges[side].get(token)
        if known is None:
            known, piece, until = [], token, NEVER
            while True:
                known.append((piece, until))
                if piece not in self.parts:
                    break
                until, piece = self.parts[piece][2], self.parts[piece][side]
            self.edges[side][token] = known
        return known

    def stand(self, a: int, b: int) -> bool:
        """Whether two tokens stay apart: no merge across their border comes before the merges that use its pieces up.

        Of two merges of one rank the left one comes first.
        """
        for x, x_until in self.edge(a, 1):
            for y, y_until in self.edge(b, 0):
                rank = self.merged.get((x, y))
                if rank is not None and rank < x_until and rank <= y_until:
                    return False
        return True

    def state(self, text: bytes) -> State:
        """The state of a text's end: the longest beginning of a token among its ends, and the tokens among them, longest first."""
        while text not in self.beginnings:
            text = text[1:]
        found = self.states.get(text)
        if found is None:
            ids = [(n, self.id_of[text[-n:]]) for n in range(len(text), 0, -1) if text[-n:] in self.id_of]
            found = self.states[text] = State(text, {}, tuple((n, i, self.follows.setdefault(i, {})) for n, i in ids))
        return found

    def note(self) -> None:
        """Count what the worker keeps of steps and pairs, and forget all when it is much."""
        self.noted += 1
        if self.noted >= KNOWN_STEPS:
            self.states, self.follows, self.noted = {}, {}, 0

    def walk(self, words: Iterable[bytes]) -> Iterator[list[int]]:
        """The ids of each of ``words``, which are sorted: the states of a prefix are found once for all words that begin so."""
        last: list[int] = []  # the last token of each prefix on the path
        path = [self.state(b"")]  # and the automaton's state there
        before, sizes = b"", self.sizes
        for word in words:
            same, most = 0, min(len(before), len(word))
            while same < most and before[same] == word[same]:
                same += 1
            del last[same:], path[same + 1:]
            state, end = path[-1], same
            for byte in word[same:]:
                end += 1
                after = state.steps.get(byte)
                if after is None:
                    after = state.steps[byte] = self.state(state.text + bytes((byte,)))
                    self.note()
                state = after
                for n, token, follows in state.ending:
                    if n == end:
                        break
                    a = last[end - n - 1]
                    good = follows.get(a)
                    if good is None:
                        good = follows[a] = self.stand(a, token)
                        self.note()
                    if good:
                        break
                last.append(token)
                path.append(state)
            ids = []
            while end:
                token = last[end - 1]
                ids.append(token)
                end -= sizes[token]
            ids.reverse()
            before = word
            yield ids

    def words_of(self, unit: bytes) -> list[bytes | int]:
        """The words of a piece of text that no word crosses; a special token as its id."""
        if _SIMPLE.fullmatch(unit):
            return [unit]
        text, out = unit.decode("utf-8"), []
        for k, part in enumerate(self.specials.split(text) if self.specials else [text]):
            if k % 2:
                out.append(self.special[part])
            elif part:
                out += [part[a:b].encode() for _, (a, b) in self.cut(part)]
        return out

    def encode(self, texts: pa.Array) -> pa.ListArray:
        """Ids of each text; a null is an empty text."""
        units, bounds = units_of(texts)
        coded = units.dictionary_encode()
        if len(self.words) > KNOWN_WORDS:
            self.words.clear()
        known, pieces = self.words, coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        split = {u: self.words_of(u) for u in pieces if u not in known}
        missing = sorted({w for words in split.values() for w in words if isinstance(w, bytes) and w not in known})
        known.update(zip(missing, (array("i", ids).tobytes() for ids in self.walk(missing)), strict=True))
        ids = [b"".join([array("i", [w]).tobytes() if isinstance(w, int) else known[w] for w in split[u]]) if u in split else known[u] for u in pieces]
        sizes = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) // 4
        values, at = ranges(np.frombuffer(b"".join(ids), dtype=np.int32), np.cumsum(sizes) - sizes, sizes, np.asarray(coded.indices).astype(np.int64))
        return pa.ListArray.from_arrays(pa.array(at[bounds].astype(np.int32)), pa.array(values))


class Decoder:
    """The bytes of each id of one vocabulary."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        self.bytes_of = {i: bytes(letters[c] for c in token) for token, i in spec["model"]["vocab"].items()} | {x["id"]: x["content"].encode() for x in spec.get("added_tokens", [])}
        self.top = max(self.bytes_of) + 1
        parts = [self.bytes_of.get(i, b"") for i in range(self.top)]
        sizes = np.fromiter(map(len, parts), dtype=np.int64, count=self.top)
        self.table = np.frombuffer(b"".join(parts), dtype=np.uint8), np.cumsum(sizes) - sizes, sizes

    def decode(self, ids: pa.ListArray) -> pa.Array:
        """The text of each list of ids, special tokens as they are written; bytes that are no UTF-8 become U+FFFD, unknown ids give nothing."""
        lists = pc.fill_null(ids, [])
        number = np.asarray(pc.fill_null(lists.flatten(), -1)).astype(np.int64)
        if len(number) and (number.max() >= self.top or number.min() < 0):
            return pa.array([b"".join(self.bytes_of.get(i, b"") for i in x).decode("utf-8", "replace") for x in lists.to_pylist()], pa.string())
        values, at = ranges(*self.table, number)
        bounds = np.concatenate([[0], np.cumsum(np.asarray(pc.list_value_length(lists)).astype(np.int64))])
        raw = pa.Array.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer(at[bounds].astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])
        try:
            return raw.cast(pa.string())
        except pa.ArrowInvalid:
            return pa.array([x.decode("utf-8", "replace") for x in raw.to_pylist()], pa.string())


#: Letters up to U+02AF with or without a space before them, or one mark: a word in every version of Unicode.
_SIMPLE = re.compile(rb" ?(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]|[\xc4-\xc9][\x80-\xbf])+|[.,;:!?\n]")
_MARKS = np.zeros(256, dtype=bool)
_MARKS[list(b".,;:!?")] = True


def ranges(values: np.ndarray, begins: np.ndarray, sizes: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ranges of ``values`` with these numbers behind each other, and where each begins and the last ends."""
    own = sizes[number]
    at = np.concatenate([[0], np.cumsum(own)])
    step = np.ones(int(at[-1]), dtype=np.int64)
    full = np.flatnonzero(own)
    if len(full):
        first = begins[number[full]]
        step[at[:-1][full]] = first - np.concatenate([[0], (first + own[full] - 1)[:-1]])
        np.cumsum(step, out=step)
    return values[step], at


def units_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Pieces of texts that no word crosses, and the number of the first piece of each text, and of all.

    A piece ends before a space or line end that follows what is surely no white space, and after a single line end between
    two such characters. Elsewhere texts stay in one piece, which costs time only.
    """
    texts = pc.fill_null(texts.cast(pa.string()), "")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, dtype=np.int64)
    raw = np.frombuffer(texts.buffers()[2], dtype=np.uint8)[offsets[0]:offsets[-1]] if offsets[-1] > offsets[0] else np.empty(0, dtype=np.uint8)
    offsets = offsets - offsets[0]
    printable = (raw > 0x20) & (raw < 0x7F)
    two = (raw >= 0xC3) & (raw < 0xE0)  # begins a character of two bytes, none of which is white space
    ends_solid, starts_solid = printable.copy(), printable | two
    ends_solid[1:] |= two[:-1]
    line = raw == 0x0A
    cut = np.zeros(len(raw) + 1, dtype=bool)
    cut[1:-1] = ends_solid[:-1] & ((raw[1:] == 0x20) | line[1:])
    cut[2:-1] |= ends_solid[:-2] & line[1:-1] & starts_solid[2:]
    letter = ((raw | 0x20) >= 0x61) & ((raw | 0x20) <= 0x7A)
    letter[1:] |= (raw[:-1] >= 0xC3) & (raw[:-1] <= 0xC9) & ((raw[:-1] != 0xC3) | ((raw[1:] != 0x97) & (raw[1:] != 0xB7)))
    cut[1:-1] |= letter[:-1] & _MARKS[raw[1:]]
    cut[offsets] = True
    begins = np.flatnonzero(cut[:-1])
    bounds = np.searchsorted(begins, offsets)
    units = pa.Array.from_buffers(pa.binary(), len(begins), [None, pa.py_buffer(np.concatenate([begins, [len(raw)]]).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(raw))])
    return units, bounds


@lru_cache(maxsize=4)
def bpe(path: str) -> ByteBpe:
    """The worker's tables of a vocabulary; loaded once for each Python process."""
    return ByteBpe(path)


@lru_cache(maxsize=4)
def decoder(path: str) -> Decoder:
    """The worker's bytes of ids: a decoding task needs no merges."""
    return Decoder(path)


def _gathered(batches: Iterator[pa.RecordBatch], column: str, least: int) -> Iterator[pa.RecordBatch]:
    """Batches put together until they hold about ``least`` bytes of a column: larger ones repeat fewer words."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.column(column).nbytes
        if size >= least:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
    if sum(x.num_rows for x in held):
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _with_column(df: DataFrame, column, name: str, kind: str, least: int, parts, step) -> DataFrame:
    """``df`` with a column that ``step`` makes of ``column``, ``parts`` of some ``least`` bytes at a time."""
    work = fresh("__work", df.columns)
    kept = [c for c in df.columns if c != name]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _gathered(batches, work, least):
            for part in parts(batch, work, least):
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in kept], step(part.column(work))], [*kept, name])

    schema = df.select(*kept).withColumn(name, F.lit(None).cast(kind)).schema
    return df.select(*kept, column.alias(work)).mapInArrow(run, schema)


def _by_ids(batch: pa.RecordBatch, column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with ids of about ``limit`` bytes each."""
    sizes = np.asarray(pc.fill_null(pc.list_value_length(batch.column(column)), 0)).astype(np.int64) * 4
    group = (np.cumsum(sizes) - sizes) // limit
    edges = np.concatenate([[0], np.flatnonzero(np.diff(group)) + 1, [len(sizes)]]) if len(sizes) else [0]
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        yield batch.slice(int(a), int(b - a))


def encode(docs: DataFrame, tokenizer: str | None = None, text: str = "text", into: str = "ids") -> DataFrame:
    """``docs`` with the ids of its texts, as the library gives them without added special tokens, truncation or padding.

    Rows stay in the tasks that read them: nothing is shuffled, and a lost task repeats its own rows only. Strings of special
    tokens inside texts become those tokens. Null or empty text: no ids. Very long texts and words: whole; a word's cost
    follows its length. Equal texts and repeated rows: equal ids. Empty table: empty result. A column named like the new one is replaced.
    """
    path = tokenizer or default_path()
    return _with_column(small_batches(docs), text_of(text), into, "array<int>", PART_BYTES, slices, lambda x: bpe(path).encode(x))


def decode(encoded: DataFrame, tokenizer: str | None = None, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """``encoded`` with the texts of its ids, special tokens included.

    Null or no ids: the empty text. Bytes that are no UTF-8 become U+FFFD; ids that the vocabulary lacks, and nulls, give nothing. A
    column named like the new one is replaced.
    """
    path = tokenizer or default_path()
    return _with_column(encoded, F.col(ids).cast("array<int>"), into, "string", PART_BYTES, _by_ids, lambda x: decoder(path).decode(x))
