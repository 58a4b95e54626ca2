"""Overlapping chunks of Markdown.

A text is read once by a pattern that stops at every line end and sentence end. From what it stops at come the places where the
text may be cut, as two arrays of places and weights. Cutting is then a search in these arrays, and what a chunk
is (its headings, its kind) is looked up by its place.
"""

from __future__ import annotations

import ast
import re
from bisect import bisect_left
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakesift.blocks import pieces
from lakesift.operators.scripts import declarations

# Kinds of breaks and their weights, in the order that decides ties in ``compat``.
WEIGHTS = {"h1": 100, "h2": 90, "h3": 80, "h4": 70, "hr": 65, "codeblock": 65, "h5": 60, "h6": 50, "sentence": 30, "blank": 20, "list": 5, "numlist": 5, "newline": 1}
# Weights of a class, of a function or export, and of an import at the top level of fenced code.
CLASS, FUNCTION, IMPORT = 92, 88, 38
_STOP = re.compile(
    r"\n(?:(?P<head>(?=(#{1,6})(?!#)))|(?P<codeblock>(?=```))|(?P<hr>(?=((?:---|\*\*\*|___)\s*\n)))"
    r"|(?P<blank>(?<!\n\n)(?=\n))|(?P<list>(?=[-*]\s))|(?P<numlist>(?=\d+\.\s)))?"
    r"|(?P<sentence>[.!?])(?=\s+[A-Z])"
)
_FRONT = re.compile(r"\A---\n.*?\n---\n", re.DOTALL)
_HEADING = re.compile(r"^(#{1,6})[ \t]+(.+?)[ \t]*#*[ \t]*$", re.MULTILINE)
_FENCED = re.compile(r"^```(\w+)[^\n]*\n(.*?)^```", re.DOTALL | re.MULTILINE)
_FENCE_LINE = re.compile(r"^[^\S\n]*```(.*)$", re.MULTILINE)
CHUNK = "seq int, pos int, len int, section_path string, chunk_type string, language string"
#: Share of a break's weight that is lost at the far end of the window.
DECAY = 0.7


class Break(NamedTuple):
    at: int
    weight: int
    kind: int  # its place in WEIGHTS
    guarded: bool  # inside a fence, or below a row of a table


def breaks(text: str, compat: bool = False) -> list[Break]:
    """Every break of ``text`` in order. A fence that begins the text counts, except in ``compat``. A rule ends with its line end, which begins no other rule."""
    order, out, ruled = list(WEIGHTS), [], 0
    fenced, line = text.startswith("```") and not compat, 0
    for m in _STOP.finditer(text):
        name = m.lastgroup or "newline"
        if name == "head":
            name = f"h{len(m[2])}"
        elif name == "hr":
            name, ruled = ("hr", m.end(5)) if m.start() >= ruled else ("newline", ruled)
        row = name != "sentence" and text.startswith("|", line)
        out.append(Break(m.start(), WEIGHTS[name], order.index(name), fenced or row))
        if name != "sentence":
            line = m.end()
        fenced ^= name == "codeblock"
    return out


def break_rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, pos, kind, guarded of each break of each text."""
    names = np.array(list(WEIGHTS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (piece for whole in batches for piece in pieces(whole)):
            each = [breaks(t or "") for t in batch.column(1).to_pylist()]
            rows = [b for own in each for b in own]
            keys = batch.column(0).take(pa.array(np.repeat(np.arange(len(each)), [len(x) for x in each])))
            yield pa.RecordBatch.from_arrays([keys, pa.array([b.at for b in rows], pa.int32()), pa.array(names[[b.kind for b in rows]].tolist() if rows else [], pa.string()), pa.array([b.guarded for b in rows], pa.bool_())], [key, "pos", "kind", "guarded"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, pos int, kind string, guarded boolean")


def code_breaks(language: str, code: str) -> Iterator[tuple[int, int]]:
    """(place, weight) of the line ends before classes, functions and imports at the top level of ``code``; none before its first line.

    Python is parsed, scripts are read by ``declarations``; what can't be parsed, and other languages, have no such breaks.
    """
    lines = [0, *(m.end() for m in re.finditer("\n", code))]
    if language == "python":
        try:
            body = ast.parse(code).body
        except (SyntaxError, ValueError):
            return
        for node in body:
            first = min([node.lineno, *(d.lineno for d in getattr(node, "decorator_list", []))])
            weight = CLASS if isinstance(node, ast.ClassDef) else FUNCTION if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)) else IMPORT if isinstance(node, (ast.Import, ast.ImportFrom)) else 0
            if weight and first > 1:
                yield lines[first - 1] - 1, FUNCTION if getattr(node, "decorator_list", None) else weight
    elif language in ("javascript", "typescript"):
        weights = {"type": CLASS, "function": FUNCTION, "module": IMPORT}
        yield from ((at - 1, weights[kind]) for at, kind in declarations(code) if at)


class Cuts:
    """The places where a text may be cut, with their weights: in order, or kind by kind in ``compat``."""

    def __init__(self, text: str, compat: bool):
        own = breaks(text, compat)
        best = {b.at: b.weight for b in own if not b.guarded}
        if not compat:
            for m in _FENCED.finditer(text):
                for at, weight in code_breaks(m[1].lower(), m[2]):
                    best[m.start(2) + at] = max(weight, best.get(m.start(2) + at, 0))
            rows = sorted(best.items())
        else:
            self.every = np.array([b.at for b in sorted(own, key=lambda b: (b.kind, b.at))], dtype=np.int64)
            rows = [(int(at), best.get(int(at), 0)) for at in self.every]
        self.compat, self.at, self.weight = compat, np.array([at for at, _ in rows], dtype=np.int64), np.array([w for _, w in rows], dtype=np.float64)

    def best(self, start: int, after: int, ideal: int) -> int:
        """The break behind ``start`` and ``after`` and before ``ideal`` that is worth most, the first of equals; ``ideal`` where there is none.

        What a break is worth falls with the square of its distance from ``ideal``. In ``compat`` breaks count up to the first,
        kind by kind, that lies beyond the window.
        """
        if self.compat:
            beyond = np.flatnonzero(self.at >= ideal)
            own = slice(0, int(beyond[0]) if len(beyond) else len(self.at))
        else:
            own = slice(*np.searchsorted(self.at, [max(start, after) + 1, ideal]))
        at = self.at[own]
        off = (ideal - at) / (ideal - start)
        worth = np.where(at > start, self.weight[own] * (1 - off * off * DECAY), 0.0)
        k = int(worth.argmax()) if len(worth) else -1
        return int(at[k]) if k >= 0 and worth[k] > 0 else ideal


def spans(text: str, target: int, overlap: int, least: int, compat: bool) -> Iterator[tuple[int, int]]:
    """Begin and end of each chunk. One that is shorter than ``least`` is left out.

    A chunk begins ``overlap`` before the end of the one before, moved on to the next space or line end; or right at that end,
    where it would not lie behind the begin of the last chunk that was kept. The begin always moves on.
    """
    cuts, n, begin, end, kept = Cuts(text, compat), len(text), 0, 0, 0
    while begin < n:
        last = begin + target >= n
        end = n if last else cuts.best(begin, end, begin + target)
        if end - begin >= least:
            yield begin, end
            kept = begin
        if last:
            return
        back = end
        if end - overlap > kept:
            space = re.compile("[ \n]").search(text, end - overlap, end)
            back = space.start() if space else end
        begin = back if back > begin else end


class Headings:
    """The headings of a text, each with the path of those above it."""

    def __init__(self, text: str):
        self.at, self.own, self.above = [], [], []
        path: list[tuple[int, str]] = []
        for m in _HEADING.finditer(text):
            level = len(m[1])
            path = [x for x in path if x[0] < level]
            self.at.append(m.start())
            self.above.append(tuple(title for _, title in path))
            path.append((level, m[2].strip()))
            self.own.append(path[-1])

    def path(self, up_to: int) -> str:
        """Headings that begin before a place, outermost first; the last may reach beyond it and is cut there."""
        k = bisect_left(self.at, up_to) - 1
        if k < 0:
            return ""
        level, title = self.own[k]
        return " > ".join([*self.above[k], title[:max(0, up_to - self.at[k] - level - 1)].strip() or title])


def kind_of(text: str, begin: int = 0, end: int | None = None) -> tuple[str, str | None]:
    """prose, code or mixed, with the language of the first opening fence that names one: what lies between fence lines in turn.

    A name that ``end`` cuts is read to the end of its line; one that begins behind ``end`` isn't seen.
    """
    parts = _FENCE_LINE.split(text[begin:end])
    outside, inside, opening = (any(x.strip() for x in parts[0::4]), any(x.strip() for x in parts[2::4]), [x.strip() for x in parts[1::4]])
    if end is not None and len(parts) % 4 == 3 and opening[-1] and not parts[-1]:
        opening[-1] = (parts[-2] + text[end:].partition("\n")[0]).strip()
    if not inside:
        return "prose", None
    return "mixed" if outside else "code", next((x for x in opening if x), None)


def chunk(text: str, target: int = 2100, overlap: int = 225, least: int = 100, compat: bool = False) -> list[tuple]:
    """(pos, len, section_path, chunk_type, language) of each chunk; places are in ``text`` itself.

    ``compat`` keeps four older habits: breaks are looked through kind by kind up to the first beyond the
    window, a heading that ended a chunk may end the next one too, places count from after the front
    matter, and a fence that begins the text isn't seen.
    """
    front = _FRONT.match(text)
    body = text[front.end():] if front else text
    shift, heads = 0 if compat else len(text) - len(body), Headings(body)
    return [(a + shift, b - a, heads.path(a), *kind_of(body, a, b)) for a, b in spans(body, target, overlap, least, compat)]


def chunk_documents(docs: DataFrame, key: str = "content_hash", text: str = "doc", target: int = 2100, overlap: int = 225, least: int = 100, compat: bool = False, cut: bool = False) -> DataFrame:
    """key, seq, pos, len, section_path, chunk_type, language of each chunk of each text, with ``cut`` its own text too; a null text has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 200):
                part = batch.slice(a, 200)
                whole = part.column(1).to_pylist()
                each = [chunk(t or "", target, overlap, least, compat) for t in whole]
                counts = [len(x) for x in each]
                rows = [c for x in each for c in x]
                columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
                keys = part.column(0).take(pa.array(np.repeat(np.arange(part.num_rows), counts)))
                seq = pa.array([i for n in counts for i in range(n)], pa.int32())
                own = [pa.array([t[a:a + n] for t, x in zip(whole, each, strict=True) for a, n, *_ in x], pa.string())] if cut else []
                yield pa.RecordBatch.from_arrays([keys, seq, *(pa.array(list(x), t) for x, t in zip(columns, (pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string()), strict=True)), *own], [key, "seq", "pos", "len", "section_path", "chunk_type", "language", *(["text"] if cut else [])])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, {CHUNK}" + (", text string" if cut else "")).withColumn("section_path", F.nullif("section_path", F.lit("")))
