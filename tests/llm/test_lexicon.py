"""The matcher against plain search, and every entry that is learned is kept."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st

from lakesift.llm import toxicity


def plain_score(model, text):
    """The same sum by looking at each word for itself."""
    words = text.split()
    places, at = [], 0
    for w in words:
        at = text.index(f" {w} ", at)
        places.append(at)
        at += 1
    best = {}
    for w, at in zip(words, places, strict=True):
        heavy = max((x for p, x in model.lexicon if text.startswith(p, at)), default=0.0)
        if heavy > 0:
            best[at] = (w, heavy)
    for p in model.exceptions:
        n = len(p.split())
        for k in range(len(words) - n + 1):
            if words[k:k + n] == p.split():
                for j in range(k, k + n):
                    best.pop(places[j], None)
    counts = {}
    for found in best.values():
        counts[found] = counts.get(found, 0) + 1
    import math

    return sum(x * (1 + math.log(n)) for (_, x), n in counts.items()), max((x for _, x in best.values()), default=0.0), len(words)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text("ab", min_size=1, max_size=4), max_size=14), st.dictionaries(st.text("ab", min_size=1, max_size=3), st.floats(0.5, 3), max_size=5), st.dictionaries(st.text("ab", min_size=1, max_size=3), st.floats(0.5, 3), max_size=3), st.lists(st.lists(st.text("ab", min_size=1, max_size=3), min_size=1, max_size=3), max_size=3))
def test_matcher(words, begins, whole, phrases):
    model = toxicity.Model(tuple([*((f" {p}", w) for p, w in begins.items()), *((f" {p} ", w) for p, w in whole.items())]), tuple(dict.fromkeys(f" {' '.join(x)} " for x in phrases)))
    model = toxicity.Model(tuple((p, w) for p, w in model.lexicon if p not in model.exceptions), model.exceptions)
    text = f" {' '.join(words)} " if words else " "
    found, expected = toxicity.raw_score(model, text), plain_score(model, text)
    assert abs(found[0] - expected[0]) < 1e-9 and found[1:] == expected[1:]


def test_folding(spark):
    def fold(text):
        table = toxicity.HOMOGLYPHS | toxicity.FULL_WIDTH | toxicity.SUBSTITUTES
        plain = "".join(table.get(c, c) for c in text.lower() if c not in toxicity.NO_WIDTH)
        return " ".join(["", *"".join(c if c.isalpha() else " " for c in plain).split(), ""]) if any(c.isalpha() for c in plain) else " "

    r = random.Random(4)
    letters = "abcXYZ019@$ .,-'\n" + "".join(toxicity.HOMOGLYPHS) + "".join(toxicity.FULL_WIDTH) + toxicity.NO_WIDTH + "éßñ"
    texts = ["", " ", "1", "a1b", *("".join(r.choice(letters) for _ in range(r.randrange(1, 60))) for _ in range(300))]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").select("doc_id", toxicity.folded().alias("f")).collect()
    assert {r["doc_id"]: r["f"] for r in rows} == {i: fold(t) for i, t in enumerate(texts)}


def test_scores_are_the_matchers(spark):
    model = toxicity.Model(((" bad", 2.0), (" worse ", 3.0)), (" badge ",), (1.0, 0.5, 0.2, -2.0))
    docs = spark.createDataFrame([(1, "a BAD badge is w0rse", "x", 0.3), (1, "a BAD badge is w0rse", "x", 0.3), (2, None, "y", None)], "doc_id long, text string, folded string, score double")
    rows = toxicity.score(docs, model, keep=("doc_id", "folded", "score", "text"), into="found").collect()
    assert [r.asDict() | {"found": 0} for r in rows] == [{"doc_id": d, "folded": f, "score": x, "text": t, "found": 0} for d, t, f, x in [(1, "a BAD badge is w0rse", "x", 0.3)] * 2 + [(2, None, "y", None)]]
    assert rows[0]["found"] == toxicity.probability(model, " a bad badge is worse ") and rows[2]["found"] == toxicity.probability(model, " ")
    assert toxicity.score(docs, model, keep=("doc_id", "score")).columns == ["doc_id", "score"]


def test_all_entries_are_kept(spark):
    r = random.Random(9)
    bad = ["".join(r.choice("bcdfghjklmnpqrst") for _ in range(9)) for _ in range(2500)]
    rows = [(i, " ".join(bad[(i * 50 + k) % 2500] for k in range(400)) if i % 2 else f"good{i} words here {i}", i % 2) for i in range(160)]
    docs = spark.createDataFrame([(i, t, 1, 2, 3) for i, t, _ in rows], "doc_id long, text string, toxic int, label_id long, half int")
    model = toxicity.train(docs, spark.createDataFrame([(i, t, "z") for i, _, t in rows], "doc_id long, toxic int, text string"))
    assert len(model.lexicon) > 4000
