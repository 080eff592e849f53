"""Connected components of an edge table by alternating stars, with pre-summed minima and stored rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from fintrail.llm.common import remove_stored, stored


def _is_forest_of_stars(e: DataFrame) -> bool:
    """Whether no vertex has two parents (b of an edge a, b), or a parent as well as children."""
    ends = e.select(F.col("a").alias("v"), F.lit(1).alias("up")).unionByName(e.select(F.col("b").alias("v"), F.lit(0).alias("up")))
    odd = ends.groupBy("v").agg(F.sum("up").alias("up"), F.count(F.lit(1)).alias("n")).where("up > 1 or (up > 0 and n > up)")
    return odd.agg(F.count(F.lit(1))).first()[0] == 0


def components(edges: DataFrame) -> DataFrame:
    """(v, root) for every vertex of `edges` (long columns a, b): root is the least vertex of its component.

    Each round hangs all larger neighbours of a vertex, then all smaller ones, on the least vertex nearby, until only
    stars are left; the number of rounds grows with the logarithm of the vertices. A vertex with very many edges only
    contributes a minimum and a join side that Spark can split. Loops and repeated edges do no harm; null ends are
    left out.
    """
    e = stored(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while not _is_forest_of_stars(e):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b")
        near = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(near, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .unionByName(near.select("a", F.col("m").alias("b"))).distinct())
        new = stored(small, "edges")
        remove_stored(e)
        e = new
    return e.select(F.col("a").alias("v"), F.col("b").alias("root")).unionByName(
        e.select(F.col("b").alias("v"), F.col("b").alias("root")).distinct())
