"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakesift.llm.common import forget, materialise

#: Parts into which the nodes of one component are dealt when they look up its label.
PARTS = 64


def components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """node, component (its smallest node) for each end of an edge; nodes are longs.

    Each round every node takes the smallest component among itself and its neighbours, and then
    the component of that one, so chains shorten by half; rounds end when nothing changes. Rounds are written to the
    shared folder. Rows stay one for a node: nothing is gathered by component.
    """
    both = materialise(edges.select(F.col(u).alias("a"), F.col(v).alias("b")).union(edges.select(F.col(v), F.col(u))).distinct(), "edges")
    state = materialise(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("component")), "component")
    while True:
        near = both.join(state.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        lower = state.join(near, "node").select("node", "component", F.least("component", "near").alias("next"), F.pmod(F.xxhash64("node"), F.lit(PARTS)).alias("part"))
        # the label of a large component is looked up once for each part of it, and its nodes meet that part only
        jump = lower.select("next", "part").distinct().join(state.select(F.col("node").alias("next"), F.col("component").alias("far")), "next")
        moved = materialise(lower.join(jump, ["next", "part"], "left").select("node", F.least("next", F.coalesce("far", "next")).alias("component"), (F.least("next", F.coalesce("far", "next")) != F.col("component")).alias("changed")), "component")
        forget(state)  # the round before; its folder is read by nothing else
        state = moved.select("node", "component")
        if moved.where("changed").limit(1).count() == 0:
            forget(both)
            return state
