"""Links at other similarities than 0.8: pairs planted a little above the asked one."""

import random
from math import sqrt

import pytest

from lakesift.llm import jaccard
from lakesift.llm.components import components

PAIRS = 150


def planted(similarity: float, rng: random.Random) -> tuple[list[str], float]:
    """Pairs of texts that share a run of words: the least similarity that is not below ``similarity``, of 200 shingles each."""
    shared = next(k for k in range(1, 200) if k / (400 - k) >= similarity)
    word = lambda: f"w{rng.getrandbits(40):x}"
    texts = []
    for _ in range(PAIRS):
        same = [word() for _ in range(shared + 4)]
        texts += [" ".join(same + [word() for _ in range(200 - shared)]) for _ in range(2)]
    return texts, shared / (400 - shared)


@pytest.mark.parametrize("similarity", [0.4, 0.5, 0.6, 0.7, 0.8, 0.9])
def test_recall_at_the_threshold(spark, similarity):
    texts, true = planted(similarity, random.Random(int(similarity * 100)))
    assert similarity <= true < similarity + 0.01
    found = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in jaccard.jaccard_join(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), similarity).collect()}
    linked = sum(found[i][1] == 1 and found[i][0] == i - i % 2 for i in range(2 * PAIRS))
    assert linked >= 0.95 * 2 * PAIRS
    assert all(n <= 1 and c in (i, i - i % 2) for i, (c, n) in found.items())


def test_pairs_below_are_not_linked(spark):
    texts, true = planted(0.45, random.Random(1))
    found = jaccard.jaccard_join(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), true + 0.02).collect()
    assert all(r["n_links"] == 0 for r in found)


def test_bound_follows_the_threshold():
    for k in range(1, 100):
        s = k / 100
        least = jaccard.least_equal(s)
        assert least == 1 or (least - 1) / 64 < s - 5 * sqrt(s * (1 - s) / 64) <= least / 64
    assert jaccard.least_equal() == 36  # 0.55 of 64 tokens


def test_large_component_is_dealt_out(spark):
    """A chain, a star and a pair; the star's label is looked up in parts."""
    edges = [(i, i + 1) for i in range(40)] + [(1000, 1000 + k) for k in range(1, 300)] + [(5000, 4000)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{1000 + k: 1000 for k in range(300)}, 4000: 4000, 5000: 4000}
