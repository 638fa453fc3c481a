"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import shared_table


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node that has a link; a component is its smallest node.

    Each round gives a node the smallest component among itself and its neighbours, then the
    component's own component, until nothing changes: about the logarithm of the longest chain.
    Rounds go through written tables, which carry no constraints over; those would double per round.
    """
    both = links.select(F.col(a).alias("node"), F.col(b).alias("other")).filter("node <> other")
    both = shared_table(both.unionByName(both.select(F.col("other").alias("node"), F.col("node").alias("other"))).distinct())
    state = shared_table(both.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("component")))
    while True:
        seen = both.join(state.select(F.col("node").alias("other"), "component"), "other").groupBy("node").agg(F.min("component").alias("near"))
        nearer = state.join(seen, "node").select("node", F.col("component").alias("was"), F.least("component", "near").alias("component"))
        jump = nearer.select(F.col("node").alias("component"), F.col("component").alias("further"))
        new = shared_table(nearer.join(jump, "component", "left").select("node", "was", F.least("component", F.coalesce("further", "component")).alias("component")))
        changed = new.filter(F.col("component") != F.col("was")).limit(1).count()
        state = new.select("node", "component")
        if not changed:
            return state
