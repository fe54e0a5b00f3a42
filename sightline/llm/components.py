"""Connected components of a link table by random contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, release


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b: long); ``component`` is a node of the component.

    Each round hooks every node to the neighbour (or itself) that a hash of the round orders first, jumps once along
    those pointers and contracts the links; a random order shrinks chains as well as stars, so rounds grow with the
    logarithm of the nodes.  A hub costs one pre-aggregated row per task, and its joins are split as skewed joins."""
    links = cut_lineage(links.where("a <> b").select("a", "b").distinct())
    found = None
    round_no = 0
    while not links.isEmpty():
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        key = F.struct(F.xxhash64(F.lit(round_no), F.col("b")).alias("h"), F.col("b").alias("to"))
        own = F.struct(F.xxhash64(F.lit(round_no), F.col("a")).alias("h"), F.col("a").alias("to"))
        hook = both.groupBy("a").agg(F.min(key).alias("m")).select(F.col("a").alias("node"), F.least("m", own)["to"].alias("to"))
        hook = cut_lineage(hook)
        jump = hook.select(F.col("node").alias("to"), F.col("to").alias("far"))
        near, hook = hook, cut_lineage(hook.join(jump, "to").select("node", F.col("far").alias("to")))
        before = links, near, hook, found
        if found is None:
            found = hook.withColumnRenamed("to", "component")
        else:
            nxt = hook.select(F.col("node").alias("component"), "to")
            found = found.join(nxt, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
        found = cut_lineage(found)
        left = hook.select(F.col("node").alias("a"), F.col("to").alias("pa"))
        right = hook.select(F.col("node").alias("b"), F.col("to").alias("pb"))
        links = cut_lineage(links.join(left, "a").join(right, "b").where("pa <> pb")
                            .select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct())
        release(*before)
        round_no += 1
    if found is None:
        return links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return found
