"""Many small writes: few parts, each row written seldom, and the rows of a plain replay."""

import random

import pytest
from pyspark.sql import functions as F

from lakesift import store as stores
from lakesift.store import Store

T = "2024-05-01 10:00:00"


def row(spark, keys, value):
    return spark.createDataFrame([(k, "llm", value) for k in keys], "hash string, type string, result string").withColumns({"created_at": F.lit(T).cast("timestamp"), "expires_at": F.lit(None).cast("timestamp")})


def test_parts_grow_as_a_logarithm(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stores, "PARTS", 3)
    store, rng, held, most, written = Store(spark, str(tmp_path / "s")), random.Random(1), {}, 0, []
    plain = Store._write
    monkeypatch.setattr(Store, "_write", lambda self, name, df, n, gone, level=0: written.append((level, gone)) or plain(self, name, df, n, gone, level))
    for i in range(27):
        key, dead = f"k{rng.randint(0, 14)}", f"k{rng.randint(0, 14)}"
        for k in (key, dead):
            held.pop(k, None)
        held[key] = f"v{i}"
        store.append({"cache": row(spark, [key], f"v{i}")}, {"cache": row(spark, [key, dead], "")})
        most = max(most, len(store.parts()["cache"]))
    assert {r["hash"]: r["result"] for r in store.table("cache").collect()} == held
    levels = max(p["level"] for p in store.parts()["cache"])
    assert 2 <= levels <= 4 and most <= 2 * 3 * (levels + 1)
    # each level takes as many writes as all writes below it, so they shrink from level to level
    by_level = [sum(at == level for at, _ in written) for level in range(levels + 1)]
    assert by_level[0] >= 53 and all(b <= a * 0.8 for a, b in zip(by_level, by_level[1:]))


def test_keys_outlive_their_run(spark, tmp_path, monkeypatch):
    """Keys that are gone in merged parts still hide rows of older parts, and no younger ones."""
    monkeypatch.setattr(stores, "PARTS", 3)
    store = Store(spark, str(tmp_path / "s"))
    store.append({"cache": row(spark, ["a", "b", "c"], "old")})
    store.compact("cache")
    store.compact("cache")
    for i in range(4):
        store.append({"cache": row(spark, ["b"], f"new{i}")}, {"cache": row(spark, ["a", "b"], "")})
        assert {(r["hash"], r["result"]) for r in store.table("cache").collect()} == {("b", f"new{i}"), ("c", "old")}
    assert any(p["gone"] for p in store.parts()["cache"]) and max(p["level"] for p in store.parts()["cache"]) >= 2
    store.compact("cache")
    assert [p["gone"] for p in store.parts()["cache"]] == [False] and store.table("cache").count() == 2


@pytest.mark.parametrize("name", ["content", "documents"])
def test_stores_without_levels(spark, tmp_path, name):
    """A manifest written before there were levels, or some tables, is read as it is."""
    store = Store(spark, str(tmp_path / "s"))
    parts = store.parts()
    own = plain_part(store, name)
    n = store._publish({k: v for k, v in (parts | {name: [own]}).items() if k not in ("statistics", "dead")}, store.version + 1)
    assert store.version == n and store.table(name).count() == 1 and store.parts()["dead"] == []
    assert store.merge(name) is None


def plain_part(store, name):
    path = f"{store.path}/tables/{name}/0-old"
    schema = store.table(name).schema
    store.spark.createDataFrame([tuple(None for _ in schema)], schema).write.parquet(path)
    return {"path": path, "gone": False}
