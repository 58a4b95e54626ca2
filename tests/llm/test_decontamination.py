"""Recall of the samples at the largest distance, and long items in bounded memory."""

import random
import tracemalloc

import numpy as np
import pytest

from lakesift.llm import decontamination as d


def edited(r, base, k, words):
    text = list(base)
    for _ in range(k):
        at = r.randrange(len(text))
        text[at:at + 1] = r.choice([[r.choice(words)], [], [text[at], r.choice(words)]])
    return text


@pytest.mark.parametrize(("n", "least"), [(10, 0.97), (15, 0.98), (25, 0.99), (40, 0.99), (63, 0.99)])
def test_recall_at_the_largest_distance(n, least):
    r = random.Random(n)
    words = [f"w{i}" for i in range(4000)]
    items = [(i, " ".join(r.choice(words) for _ in range(n))) for i in range(50)]
    held = d.prepare(items)
    total = found = 0
    for i in range(400):
        before, base = [r.choice(words) for _ in range(30)], items[i % 50][1].split()
        text = before + edited(r, base, d.allowed(n), words) + before
        seq = d.normal_words(" ".join(text))
        windows = np.stack([seq[a:a + n] for a in range(len(seq) - n + 1)])
        best = d.edit_distances(windows, np.broadcast_to(held.words[i % 50], windows.shape)).min()
        if best <= d.allowed(n):
            total += 1
            found += any(x[1] == i % 50 for x in d.matches(seq, np.array([0, len(seq)]), held))
    assert total > 150 and found >= least * total


def test_common_words_give_no_false_match():
    r = random.Random(2)
    common = "the of and to in is a that".split()
    held = d.prepare([(i, " ".join(r.choice(common) for _ in range(30))) for i in range(20)])
    seq = d.normal_words(" ".join(r.choice(common) for _ in range(3000)))
    for doc, item, distance, start, n in d.matches(seq, np.array([0, len(seq)]), held):
        assert d.edit_distances(seq[None, start:start + n], held.words[item][None])[0] == distance <= 6


def test_a_long_cyclic_item_keeps_its_memory():
    words = " ".join(f"c{i % 50}" for i in range(1500))
    held = d.prepare([(1, words)])
    seq = d.normal_words(" ".join(f"c{i % 50}" for i in range(4000)))
    tracemalloc.start()
    found = d.matches(seq[:1600], np.array([0, 1600]), held)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found[0].tolist() == [0, 1, 0, 0, 1500] and peak < 1 << 30


def test_very_long_item():
    r = random.Random(5)
    base = [f"x{r.randrange(9000)}" for _ in range(10_000)]
    held = d.prepare([(1, " ".join(base))])
    text = ["before"] * 7 + base[:5000] + ["changed"] + base[5001:] + ["after"] * 9
    seq = d.normal_words(" ".join(text))
    tracemalloc.start()
    assert d.matches(seq, np.array([0, len(seq)]), held).tolist() == [[0, 1, 1, 7, 10_000]]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 1 << 30
    assert d.matches(seq[:7000], np.array([0, 7000]), held).tolist() == []


def test_short_items_and_the_ends_of_documents():
    held = d.prepare([(1, "one"), (2, "two words"), (3, "a b c d e f g h i"), (4, " ".join(f"k{i}" for i in range(12)))])
    texts = ["one", "x one", "two words", "words two", "a b c X e f g h i", "b c d e f g h i", " ".join(f"k{i}" for i in range(11)), "z " + " ".join(f"k{i}" for i in range(12)), ""]
    words = [d.normal_words(t) for t in texts]
    found = d.matches(np.concatenate(words), np.cumsum([0] + [len(w) for w in words]), held)
    assert sorted(map(tuple, found[:, :4].tolist())) == [(0, 1, 0, 0), (1, 1, 0, 1), (2, 2, 0, 0), (4, 3, 1, 0), (5, 3, 1, 0), (6, 4, 1, 0), (7, 4, 0, 1)]
