"""Buckets that are split again: their rows are looked up once a level, whatever is made of them."""

from lakesift.llm import jaccard


def test_large_buckets_are_looked_up_once(spark, monkeypatch):
    plans = {}

    def kept(df, name):
        plans.setdefault(name, []).append(df._jdf.queryExecution().optimizedPlan().toString())
        return written(df, name)

    written = jaccard.materialise
    monkeypatch.setattr(jaccard, "materialise", kept)
    monkeypatch.setattr(jaccard, "SKETCH_PART", 8)
    words = [f"w{i}" for i in range(120)]
    copies = [(k, " ".join([*words[:60], f"own{k}", *words[60:]])) for k in range(40)]
    others = [(100 + k, " ".join(f"x{k}y{i}" for i in range(30))) for k in range(20)]
    found = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in jaccard.jaccard_join(spark.createDataFrame(copies + others, "doc_id long, text string")).collect()}
    assert found == {k: (0, 39) for k, _ in copies} | {k: (k, 0) for k, _ in others}
    assert plans["placed"] and not any("Join Inner" in p for p in plans["placed"])
