"""A search of the vector index measures every vector in the lists that it looks at."""

import numpy as np
import pytest

from lakesift.operators import vector_index
from lakesift.operators.vector_index import VectorIndex


@pytest.mark.parametrize("at_once", [1 << 21, 50])
def test_all_vectors_of_the_lists_are_measured(spark, monkeypatch, at_once):
    rng = np.random.default_rng(7)
    data = np.concatenate([rng.normal(size=(600, 6)), np.ones((40, 6))]).astype(np.float32)  # with equal ones, which their keys settle
    vectors = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(data)], "chunk_id long, embedding array<float>")
    asked = [*range(0, 600, 20), 639]
    queries = spark.createDataFrame([(q, [float(x) for x in data[q]]) for q in asked], "query_id long, query_vector array<float>")
    own = VectorIndex.build(vectors, lists=8, parts=2)
    monkeypatch.setattr(vector_index, "HELD", at_once)
    of = {r["chunk_id"]: r["list"] for r in own.codes().collect()}
    centres = own.quantiser().centres
    wanted = set()
    for q in asked:
        near = np.argsort(((centres - data[q].astype(float)) ** 2).sum(1), kind="stable")[:3]
        few = np.array([i for i in range(len(data)) if of[i] in near])
        distance = np.sqrt(((data[few].astype(float) - data[q].astype(float)) ** 2).sum(1))
        wanted |= {(q, r, int(few[i])) for r, i in enumerate(np.lexsort((few, distance))[:4], 1)}
    # refine=1: by codes alone some of these were lost
    assert {(r["query_id"], r["rank"], r["chunk_id"]) for r in own.nearest(vectors, queries, 4, probes=3, refine=1).collect()} == wanted
