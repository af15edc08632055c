"""Connected components of an edge table, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigraph.llm.common import stored

JUMPS = 3


def components(edges: DataFrame) -> DataFrame:
    """node, root (the least node of its component) for every node of ``edges`` (a, b).

    Each round hangs every node on its least neighbour, follows those pointers a few times, and contracts
    the edges; what a round leaves is at most the local minima. Every round is written to the shared folder.
    """
    live = stored(edges.select("a", "b").where("a <> b").distinct(), "edges")
    maps: list[DataFrame] = []
    while not live.isEmpty():
        both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = stored(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("root")), "hang")
        for _ in range(JUMPS):
            over = up.select(F.col("node").alias("root"), F.col("root").alias("above"))
            up = up.join(over, "root", "left").select("node", F.coalesce("above", "root").alias("root"))
        up = stored(up, "hang")
        maps.append(up)
        moved = live.join(up.select(F.col("node").alias("a"), F.col("root").alias("x")), "a").join(up.select(F.col("node").alias("b"), F.col("root").alias("y")), "b")
        live = stored(moved.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
    if not maps:
        return edges.sparkSession.createDataFrame([], "node long, root long")
    labels = maps[0]
    for up in maps[1:]:
        labels = labels.join(up.select(F.col("node").alias("root"), F.col("root").alias("above")), "root", "left").select("node", F.coalesce("above", "root").alias("root"))
    return stored(labels, "components")
