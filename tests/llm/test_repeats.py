"""Removal of repeats where rows repeat, words are very long, and nothing survives."""

import random
import time

from lakesift.llm import substrings


def opposite_words(n=1024):
    """Two words of a and b, each the other's complement, that a polynomial modulo 2**64 can't tell apart."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_long_words_that_differ(spark):
    common = " ".join(f"w{i}" for i in range(34))
    x, y = opposite_words()
    found = substrings.remove_repeats(spark.createDataFrame([(1, f"{common} {x}"), (2, f"{common} {y}")], "doc_id long, text string")).collect()
    assert [r["n_removed"] for r in found] == [0, 0]
    # the same with words in the place of letters
    one, other = (" ".join(z) for z in opposite_words(2048))
    found = substrings.remove_repeats(spark.createDataFrame([(1, one), (2, other)], "doc_id long, text string"), window=2048).collect()
    assert [r["n_removed"] for r in found] == [0, 0]


def test_equal_rows_are_linear(spark):
    text = " ".join(f"w{i}" for i in range(60))
    seconds = []
    for n in (500, 500, 8000):
        start = time.time()
        found = substrings.remove_repeats(spark.createDataFrame([(1, text)] * n, "doc_id long, text string")).groupBy("n_words", "n_removed").count().collect()
        seconds.append(time.time() - start)
        assert [tuple(r) for r in found] == [(60, 60, n)]
    assert seconds[2] < 4 * seconds[1] + 4


def test_one_row_once_for_its_runs(spark):
    text = " ".join(f"w{i}" for i in range(60))
    runs = substrings.repeated_windows(spark.createDataFrame([(1, text)] * 50 + [(2, text)], "doc_id long, text string")).collect()
    assert [len(r["runs"]) for r in runs] == [1, 1]


def test_nothing_survives(spark):
    r = random.Random(3)
    docs = spark.createDataFrame([(i, " ".join(f"{i}-{r.random()}" for _ in range(50))) for i in range(5)] + [(9, None)], "doc_id long, text string")
    assert substrings.repeated_windows(docs) is None
    assert sorted((x["doc_id"], x["n_words"], x["n_removed"]) for x in substrings.remove_repeats(docs).collect()) == [*((i, 50, 0) for i in range(5)), (9, 0, 0)]


def test_levels():
    assert substrings.levels() == [9, 18, 35] and substrings.levels(7, 2) == [2, 4, 7] and substrings.levels(5, 5) == [5]
