"""Tokens whose signs cancel out."""

import duckdb
import numpy as np

from lakesift.plans import corpus_queries
from lakesift.providers import HashingEmbedder, _hashed
from tests.test_registry import rows


def opposite() -> tuple[str, str]:
    """Two words of one place with opposite signs."""
    seen: dict[int, str] = {}
    for word in (f"word{i}" for i in range(10_000)):
        h = _hashed(word)
        other = seen.setdefault(h % 128 ^ 1, "")
        if other:
            return other, word
        seen[h % 128] = word
    raise AssertionError


def test_a_text_with_tokens_has_a_unit_vector():
    a, b = opposite()
    model = HashingEmbedder()
    found = model.vectors([f"{a} {b}", f"{a} {a}", "", f"{a} {b} {b} {a}", "..."])
    assert np.round(np.linalg.norm(found, axis=1), 9).tolist() == [1, 1, 0, 1, 0]
    assert np.array_equal(found[0], found[3]) and not model.vectors([""]).any() and model.vectors([]).shape == (0, 64)


def test_store_index_is_its_sql(spark, tmp_path):
    a, b = opposite()
    texts = [f"{a} " * 20 + f"{b} " * 20, "one of the many words " * 10, ". " * 80]
    table = spark.createDataFrame([(k, t, "en", "src1", len(t)) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    table.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert rows(corpus_queries.QUERIES["store_index"](spark, str(tmp_path)).toPandas()) == rows(con.execute(corpus_queries.SQL["store_index"]).df())
