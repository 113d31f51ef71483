"""Connected components of a link table by alternating large-star and small-star rounds.

Rounds grow with the logarithm of the longest path. Each round's links, and each node's smallest neighbour
(partial minima), are written to the shared folder and read back. The smallest neighbours of hot nodes, those
with over a thousandth of the links, are broadcast (a few thousand rows at most, whatever the input), so the
links of a hot node are never brought together; all others meet theirs in a sort-merge join. Nothing but two
sums a round reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_each, written


def _stars(links: DataFrame, large: bool, total: int) -> DataFrame:
    """links(u, v): for each u, its neighbours go to the smallest of them and u."""
    least = written(links.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("_n")), "least")
    joined = join_each(links, least, "u", total, "_n").withColumn("m", F.least("u", "m"))
    if large:
        return joined.filter("v > u AND v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    others = joined.filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return others.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _state(links: DataFrame):
    h = F.xxhash64("u", "v").cast("decimal(38,0)")
    return links.agg(F.count(F.lit(1)).alias("n"), F.sum(h).alias("h")).first()


def components(links: DataFrame) -> DataFrame:
    """links(u, v), u != v, in either direction or both -> (node, component), component the smallest node
    reachable. Nodes without links aren't in the result; no links, no rows; repeated links count once."""
    turned = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v")
    now = written(turned.distinct(), "links")
    state = _state(now)
    while state["n"]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = written(_stars(both, True, 2 * state["n"]), "stars")
        now = written(_stars(large, False, 2 * state["n"]), "links")
        last, state = state, _state(now)
        if last == state:
            break
    least = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return least.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
