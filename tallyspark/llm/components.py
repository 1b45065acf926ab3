"""Connected components by alternating large-star and small-star contraction.

Every round is two grouped minima and two equi-joins over the edge list, written to the shared
folder; nothing but three numbers a round reaches the driver. The minima of all nodes of a short list are broadcast, and of longer ones those of the nodes with the
most edges, HEAVY_NODES at most, so that a star's edges stay where they are and
no node's neighbours meet in one task. Rounds grow with the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stored, stored


#: Edges up to which all minima are broadcast (two an edge at most), and nodes whose minima are broadcast beyond.
SHORT_EDGES, HEAVY_NODES = 100_000, 50_000


def _joined(pairs: DataFrame, low: DataFrame, edges: int, short: int) -> DataFrame:
    """pairs(u, v) with low(u, m, n): n is the number of u's pairs, of which there are 2 * edges at most."""
    if edges <= short:
        return pairs.join(F.broadcast(low.drop("n")), "u")
    limit = max(1, 2 * edges // HEAVY_NODES)
    heavy = F.broadcast(low.where(F.col("n") > limit).drop("n"))
    return pairs.join(heavy.select("u"), "u", "left_anti").join(low.where(F.col("n") <= limit).drop("n"), "u").unionAll(pairs.join(heavy, "u"))


def _large_star(edges: DataFrame, count: int, short: int) -> DataFrame:
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"), F.count(F.lit(1)).alias("n"))
    return _joined(both, low, count, short).where("v > u AND v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame, count: int, short: int) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    moved = _joined(down, low, count, short).where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionAll(low.select("u", F.col("m").alias("v"))).distinct()


def _print(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40))).alias("h"),
        F.sum(F.pmod(F.hash("u", "v").cast("long"), F.lit(1 << 31))).alias("g"),
    ).first()
    return tuple(row)


def connected_components(edges: DataFrame, rounds: int = 60, short: int = SHORT_EDGES) -> DataFrame:
    """edges(u, v) of longs -> (node, root) for every node on an edge; root is the smallest node reachable.

    Repeated edges, edges in both directions and loops are allowed; rows with a null end are ignored
    and no edges give no rows.
    """
    spark = edges.sparkSession
    current = stored(
        edges.where("u IS NOT NULL AND v IS NOT NULL AND u != v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(),
        "cc",
    )
    seen = _print(current)
    for _ in range(rounds):
        if not seen[0]:
            break
        nxt = stored(_small_star(_large_star(current, seen[0], short), seen[0], short), "cc")
        drop_stored(spark, current)
        current, before, seen = nxt, seen, _print(nxt)
        if seen == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = current.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
    return roots.unionAll(current.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
