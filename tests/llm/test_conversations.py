"""Repair against plain Python: all edits of small conversations, and a table of blocks of a few rows."""

import hashlib
import random
import re
import zlib
from functools import lru_cache

import numpy as np
import pytest

from lakesift.llm import conversations, queries

SF = "/root/testdata/sf0.001"
NAMES = {"u": "user", "a": "assistant"}


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        code = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
        if code:
            out += [(conv, turn, "user" if code == 4 else role, text)] * (2 if code == 3 else 1)
    return out


def plain(rows):
    """The rows of one conversation after damage: gaps, blank, duplicate, truncated, illegal, cost, audit, digest."""
    rows = sorted(((t is not None, t or 0, r, x) for _, t, r, x in rows))
    turns = {t for there, t, _, _ in rows if there}
    seen, fault = set(), []
    for _, _, role, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]", text)
        fault.append("blank" if not words else "duplicate" if (role, text) in seen else "truncated" if words[-1] not in ".!?" else None)
        seen.add((role, text))
    shown = [(r, x) for _, _, r, x in rows]
    follow = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}

    @lru_cache(maxsize=None)
    def best(i, state, inserted=0):
        """Cost, audit and lines from row i on."""
        ways = [(0, "", ())] if i == len(rows) and state in ("", "a") else []
        for name in "ua":
            if (state, name) in follow and inserted < 3:
                c, a, lines = best(i, name, inserted + 1)
                ways.append((c + 2, "I" + a, (f"{NAMES[name]}:", *lines)))
        if i < len(rows):
            c, a, lines = best(i + 1, state)
            ways.append((c + 3, "D" + a, lines))
            if fault[i] not in ("blank", "duplicate"):
                more = fault[i] == "truncated"
                role, text = shown[i]
                if (state, role[:1]) in follow:
                    c, a, lines = best(i + 1, role[:1])
                    ways.append((c + more, "K" + a, (f"{role}:{text}", *lines)))
                for name in "ua":
                    if (state, name) in follow:
                        c, a, lines = best(i + 1, name)
                        ways.append((c + 2 + more, "R" + a, (f"{NAMES[name]}:{text}", *lines)))
        return min(ways) if ways else (1 << 40, "", ())

    cost, audit, lines = best(0, "")
    initials = [r[:1] for r, _ in shown]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    counts = [fault.count(x) for x in ("blank", "duplicate", "truncated")]
    return (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def expected(rows, turns):
    return {conv: plain([x for x in turns if x[0] == conv]) for conv in {x[0] for x in rows}}


def found(df):
    got = {r["conv_id"]: tuple(r[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")) for r in df.collect()}
    assert len(got) == df.count()
    return got


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    texts = ["Yes.", "No!", "and then", "", " \t\n", "Why? ", "ok", None, "x.\x0b", "y. ", "日本。", "a\nb.\n"]
    roles = ["user", "assistant", "system", None, "", "tool", "User", "usher"]
    out = []
    for conv in range(150):
        for turn in range(rng.randint(1, 9)):
            usual = ["system", "user", "assistant"][0 if turn == 0 and rng.random() < 0.3 else 1 + turn % 2]
            out.append((conv, rng.choice([None, turn, turn, turn, turn * 3, -turn]), usual if rng.random() < 0.7 else rng.choice(roles), rng.choice(texts) if rng.random() < 0.5 else f"Words {rng.randint(0, 5)}."))
    return [*out, (None, 1, "user", "Hi."), (None, 2, "assistant", "Hi."), (None, None, None, None), (1000, 0, "assistant", "long " * 25_000 + "."), (1001, 5, "user", "Same."), *[(1001, 6, "user", "Same.")] * 30]


SCHEMA = "conv_id long, turn long, role string, text string"


def test_damage_and_repair(spark, rows):
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA + ", place string, block int")
    got = found(conversations.audit(table, conversations.damaged(table)))
    assert got == expected(rows, damaged(rows))
    assert any(v[6] == "" for v in got.values()) or all(any(d[0] == c for d in damaged(rows)) for c in got)


def test_repair_without_damage(spark, rows):
    plain_rows = [(a, b, " " if c is None else c, " " if d is None else d) for a, b, c, d in rows]
    assert found(conversations.audit(spark.createDataFrame(rows, SCHEMA))) == expected(rows, plain_rows)


def test_blocks_of_few_rows(spark, rows, monkeypatch):
    """Conversations over many blocks, one of them long: blocks are numbered in the plan, so the tasks need no patch."""
    monkeypatch.setattr(conversations, "BLOCK_BITS", 2)
    rng = random.Random(9)
    long = [(77_777, k, rng.choice(["user", "assistant", "assistant", "system"]), rng.choice(["Yes.", f"t{k}.", f"t{k}", ""])) for k in range(240)]
    own = [*rows, *long]
    assert found(conversations.audit(spark.createDataFrame(own, SCHEMA))) == expected(own, [(a, b, " " if c is None else c, " " if d is None else d) for a, b, c, d in own])


def test_edits_give_the_repaired_rows(spark):
    rows = [(1, 0, "assistant", "Hello."), (1, 1, "assistant", "Open"), (1, 2, "user", "Why?")]
    edits, _ = conversations.repair(spark.createDataFrame(rows, SCHEMA))
    got = [(r["edit"], r["role"], r["text"]) for r in edits.orderBy("place", "step").collect()]
    # two inserts, or an insert and a new role, or two deletions and an insert: costs 2 + 0 + 2 + 1 + 0 + 2
    assert "".join(x[0] for x in got) == plain(rows)[6]
    assert re.fullmatch("(s?(ua)+)?", "".join(r[0] for e, r, _ in got if e != "D"))


def test_least_ways_are_the_least_strings():
    """Ranks against whole strings on any arcs: a line of nodes with arcs forward."""
    rng = random.Random(3)
    for _ in range(200):
        n = rng.randint(1, 9)
        arcs = [{label: rng.randint(v + 1, n - 1) for label in range(1, 5) if rng.random() < 0.5} if v < n - 1 else {} for v in range(n)]
        label, target = np.zeros((n, 4), dtype=np.int64), np.zeros((n, 4), dtype=np.int64)
        for v, own in enumerate(arcs):
            for k, to in own.items():
                label[v, k - 1], target[v, k - 1] = k, to
        strings = [()] * n
        for v in reversed(range(n)):
            strings[v] = min(((k, *strings[to]) for k, to in arcs[v].items()), default=())
        pointers, arc = conversations.least_ways(label, target, n)
        for v in range(n):
            own, at = [], v
            while arc[at] >= 0:
                own.append(int(arc[at]) + 1)
                at = pointers[0][at]
            assert tuple(own) == strings[v]


def test_query_on_given_tables(spark):
    rows = [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in spark.read.parquet(f"{SF}/conversations.parquet").collect()]
    assert found(queries.op12_conversation_repair(spark, SF)) == expected(rows, damaged(rows))


def test_empty(spark):
    table = spark.createDataFrame([], SCHEMA)
    assert conversations.audit(table, conversations.damaged(table)).collect() == []
    # a table whose rows are all dropped: conv_id 0, turns that the checksum drops
    dropped = [(0, t, "user", "x.") for t in range(200) if zlib.crc32(f"0:{t}".encode()) % 20 == 0]
    got = found(conversations.audit(*(lambda t: (t, conversations.damaged(t)))(spark.createDataFrame(dropped, SCHEMA))))
    assert got == {0: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
