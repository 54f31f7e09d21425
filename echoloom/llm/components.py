"""Connected components of an edge table, kept in tables of the shared folder throughout."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """(a, b) pairs -> (node, label): the least node of each node's component.

    Rounds of least neighbour labels followed by a jump to the label's own label, until a round changes nothing.
    """
    both = materialize(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "cc-edges")
    state = materialize(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("label")), "cc-labels")
    while True:
        near = both.join(state.select(F.col("node").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("near"))
        met = state.join(near.withColumnRenamed("a", "node"), "node").select("node", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        met = materialize(met, "cc-met")
        up = met.select(F.col("node").alias("label"), F.col("label").alias("up"))
        jumped = materialize(met.join(up, "label").select("node", "was", F.least("label", "up").alias("label")), "cc-jumped")
        changed = jumped.where(F.col("label") != F.col("was")).limit(1).count()
        discard(met)
        discard(state)
        state = jumped.select("node", "label")
        if not changed:
            discard(both)
            return state
