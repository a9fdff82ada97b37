"""Connected components of links between 64-bit keys, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut

#: A node with more than this share of all links is joined by itself; there are fewer than two over the share of them.
_SHARE = 1 / 2000


def _with_nearest(links: DataFrame, count: int) -> DataFrame:
    """links (u, v) with m, the least v of each u. Nodes with very many links meet their m in a broadcast of bounded size."""
    nearest = cut(links.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")))
    busy = nearest.where(F.col("n") > max(count * _SHARE, 100)).select("u", "m")
    if busy.isEmpty():
        return links.join(nearest.select("u", "m"), "u")
    busy = F.broadcast(busy)
    rest = links.join(busy.select("u"), "u", "left_anti").join(nearest.select("u", "m"), "u")
    return links.join(busy, "u").unionByName(rest)


def components(links: DataFrame) -> DataFrame:
    """links (u, v: long) -> node, root: every linked node with the least node of its component.

    Each round is a minimum a node (summed up before it is shuffled) and a join; rows never multiply. The links of a
    node that has a large share of them stay where they are, as its minimum is sent to all tasks. Rounds grow with the
    logarithm of the largest component and each ends in a checkpoint. Self-links and repeated links do no harm; without
    links the result is empty. A null end is ignored.
    """
    known = links.where("u IS NOT NULL AND v IS NOT NULL AND u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    edges, before = cut(known.distinct()), None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % (1 << 40))).first()
        if state == before or not state[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(edges.select("v", "v").distinct())
        before = state
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = cut(_with_nearest(both, 2 * state[0]).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct())
        small = _with_nearest(large, state[0])
        small = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(small.select("u", F.col("m").alias("v")))
        edges = cut(small.distinct())
