"""Connected components by repeated contraction, on DataFrames alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turbula.llm.shared import checkpointed


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges``: columns a and b, longs. Returns ``node, component`` (the smallest node) of every node with an edge to another.

    In each round every node takes the smallest of itself and its neighbours as
    its label and the edges between labels are the next round's graph, so it
    shrinks at least by half. The rounds' labels are then followed from the
    first to the last. Null ends and loops are left out; repeated edges count
    once; without edges the result is empty.
    """

    def tidy(x, y, df):
        return df.select(F.greatest(x, y).alias("a"), F.least(x, y).alias("b")).where("a <> b").distinct()

    edges = checkpointed(tidy("a", "b", edges.where("a is not null and b is not null")))
    rounds: list[DataFrame] = []
    while not rounds or not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        label = both.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("component"))
        label = checkpointed(label)
        rounds.append(label)
        # Labelled and made distinct one end at a time: the many edges of a hub become one.
        half = edges.join(label, edges["a"] == label["node"]).select(F.col("component").alias("x"), "b").distinct()
        full = half.join(label, half["b"] == label["node"]).select("x", F.col("component").alias("y"))
        edges = checkpointed(tidy("x", "y", full))
    found = rounds[0]
    for label in rounds[1:]:
        step = label.select(F.col("node").alias("_from"), F.col("component").alias("_to"))
        found = found.join(step, found["component"] == step["_from"], "left").select(
            "node", F.coalesce("_to", "component").alias("component")
        )
    return found
