"""The audit against plain Python: all pairs over all terms, one row at a time."""

import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lakesift.llm import divergence

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def plain(rows, least, top):
    docs, counts, groups = defaultdict(set), defaultdict(Counter), set()
    for i, (lang, source, text) in enumerate((a or "", b or "", c or "") for a, b, c in rows):
        groups.add((lang, source))
        for term in TERM.findall(text):
            docs[lang, term.translate(LOWER)].add(i)
            counts[lang, source][term.translate(LOWER)] += 1
    kept = defaultdict(list)
    for (lang, term), own in docs.items():
        if len(own) >= least:
            kept[lang].append(term)
    out = []
    share = lambda n, total, terms: 1 + 1_000_000_000 * (n + 5) // (total + 5 * terms)
    for lang, source in groups:
        terms = kept[lang]
        total = {s: sum(counts[lang, s][t] for t in terms) for g, s in groups if g == lang}
        p = {s: [share(counts[lang, s][t], total[s], len(terms)) for t in terms] for s in total}
        q = [share(sum(counts[lang, s][t] for s in total), sum(total.values()), len(terms)) for t in terms]
        pairs = sorted((-sum(abs(a - b) for a, b in zip(p[source], p[s], strict=True)), s.encode()) for s in total if s != source)
        more = sorted((-(a - b), t.encode()) for t, a, b in zip(terms, p[source], q, strict=True) if counts[lang, source][t] and a > b)[:top]
        out += [(lang, source, part, x.decode(), -v, k) for part, own in (("pair", pairs), ("term", more)) for k, (v, x) in enumerate(own, 1)]
    return sorted(out)


def found(df):
    return sorted((r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in df.collect())


@pytest.fixture(scope="module")
def rows():
    import random

    rng = random.Random(4)
    words = ["the", "The", "été", "Été", "x1y", "a_b", "日本", "\x00q", "straße", "É", "ß", "İ", "don't", "\x7fz", "zz", "w", "ſ"]
    made = [(rng.choice(["en", "fr", None]), rng.choice(["s1", "s2", "s3", "é", "z", ""]), " ".join(rng.choices(words, k=rng.randint(0, 12)))) for _ in range(160)]
    hot = [("en", "s1", "the zz été")] * 90 + [("en", "s2", "the zz été")] * 3
    return [*made, *hot, ("de", "one", None), ("de", "two", ""), ("de", "alone", "wort " * 25_000), ("es", "only", "uno"), (None, None, None)]


def test_audit_is_plain_python(spark, rows):
    docs = spark.createDataFrame([(*r, "x") for r in rows], "lang string, source string, text string, term string")
    for least, top in ((4, 3), (30, 50), (1, 2)):
        assert found(divergence.audit(docs, least, top)) == plain(rows, least, top)


def test_many_tiles_and_buckets(spark, rows):
    """More sources and terms than one group of rows takes."""
    docs = spark.createDataFrame(rows, "lang string, source string, text string")
    kept = divergence.kept_terms(divergence.term_counts(docs), 4)
    groups = divergence.group_sizes(docs, kept)
    place = {(r["lang"], r["place"]): r["source"] for r in groups.collect()}
    got = {(r["lang"], place[r["lang"], r["a"]], place[r["lang"], r["b"]]): r["value"] for r in divergence.pair_values(kept, groups, tile=2, tile_terms=3).collect()}
    expected = {(lang, a, b): v for lang, a, part, b, v, _ in plain(rows, 4, 3) if part == "pair" and a.encode() < b.encode()}
    assert got == expected


@given(st.lists(st.tuples(st.integers(0, 5), st.integers(0, 4), st.integers(0, 50)), max_size=25), st.lists(st.integers(0, 30), min_size=5, max_size=5), st.sampled_from([1, 12, 1 << 20]))
@settings(max_examples=80, deadline=None)
def test_corrections(cells, none, held):
    cells = sorted({(t, g): p for t, g, p in cells}.items())
    term, place = (np.array([k[i] for k, _ in cells], dtype=np.int64) for i in (0, 1))
    value, none = np.array([v for _, v in cells], dtype=np.int64), np.array(none, dtype=np.int64)
    full = {t: none.copy() for t in range(6)}
    for (t, g), p in cells:
        full[t][g] = p
    expected = sum(np.abs(v[:, None] - v[None, :]) - np.abs(none[:, None] - none[None, :]) for v in full.values())
    before, divergence.HELD = divergence.HELD, held
    try:
        got = divergence.corrections(term, place, value, none)
    finally:
        divergence.HELD = before
    assert (got == expected).all()


@given(st.lists(st.one_of(st.none(), st.text(max_size=30)), min_size=1, max_size=6))
@settings(max_examples=80, deadline=None)
def test_terms(texts):
    text, term, count, names = divergence.terms_of(pa.array([*texts, "end"], pa.string()).slice(0, len(texts)))
    got = {(int(i), names[int(t)].as_py()): int(n) for i, t, n in zip(text, term, count, strict=True)}
    assert got == {(i, w): n for i, x in enumerate(texts) for w, n in Counter(t.translate(LOWER) for t in TERM.findall(x or "")).items()}


def test_shares_are_exact_for_large_counts(spark):
    from pyspark.sql import functions as F

    n, total, terms = 8_999_999_999_999_999_999 // 2, 9_000_000_000_000_000_000, 3
    row = spark.createDataFrame([(n, total, terms)], "n long, total long, terms long").select(divergence.share(F.col("n"), F.col("total"), F.col("terms")).alias("p")).head()
    assert row["p"] == 1 + 1_000_000_000 * (n + 5) // (total + 5 * terms)


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, lang string, source string, text string")
    assert divergence.audit(docs).collect() == []
