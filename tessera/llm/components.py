"""Connected components of a graph given as edges, by alternating stars (Kiveris et al. 2014), distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import materialize, remove


def _large(edges: DataFrame) -> DataFrame:
    """Every neighbour above a node moves to the smallest of the node and its neighbours."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).where("a <> b").distinct()


def _small(edges: DataFrame) -> DataFrame:
    """A node and its neighbours below move to the smallest of these."""
    least = edges.groupBy("b").agg(F.min("a").alias("m"))
    moved = edges.join(least, "b").where("a <> m").select(F.col("m").alias("a"), F.col("a").alias("b"))
    return moved.unionByName(least.select(F.col("m").alias("a"), "b")).distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """edges (a long, b long), a < b -> (node long, root long) of every node that has an edge.

    Rounds go on until a round changes nothing; each is written to the shared folder. An empty table gives an empty one.
    """
    state = lambda df: df.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")), F.lit(0))).first()
    now, path = materialize(edges.select("a", "b").distinct(), "edges")
    before = state(now)
    for _ in range(most_rounds):
        if not before[0]:
            break
        nxt, to = materialize(_small(_large(now)), "edges")
        remove(edges.sparkSession, path)
        now, path, after = nxt, to, state(nxt)
        if tuple(after) == tuple(before):
            break
        before = after
    else:
        raise RuntimeError("components: too many rounds")
    stars = now.select(F.col("b").alias("node"), F.col("a").alias("root"))
    return stars.unionByName(now.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
