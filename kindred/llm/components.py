"""Connected components of a large edge list, by repeated local contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, materialize


def components(edges: DataFrame, label: str = "cc") -> DataFrame:
    """edges (a, b) -> (node, root): one root for each connected component.

    Each round every node points to the neighbour (or itself) of least hashed
    priority, and the edges are carried over to the nodes pointed to. Hashed
    priorities make the number of rounds logarithmic whatever the order of the
    ids. Rounds are written to the shared folder, so no lineage grows. Joins on
    popular nodes are sort-merge joins whose large side adaptive execution
    splits. Nodes without an edge don't appear.
    """
    spark = edges.sparkSession
    priority = lambda c: F.struct(F.xxhash64(c).alias("p"), c.alias("n"))
    left = materialize(edges.where("a <> b").select("a", "b").distinct(), f"{label}-edges")
    rooted = None  # all tables of a round but the last are deleted once the next one has what it needs
    while not left.isEmpty():
        both = left.union(left.select("b", "a"))
        best = both.groupBy("a").agg(F.min(priority(F.col("b"))).alias("m"))
        points = best.select(
            F.col("a").alias("node"), F.least(F.col("m"), priority(F.col("a")))["n"].alias("root")
        )
        points = materialize(points, f"{label}-points")
        to = points.select(F.col("node").alias("_n"), F.col("root").alias("_r"))
        moved = left.join(to, F.col("a") == F.col("_n")).select(F.col("_r").alias("a"), "b")
        moved = moved.join(to, F.col("b") == F.col("_n")).select("a", F.col("_r").alias("b"))
        moved = moved.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        before, left = left, materialize(moved.distinct(), f"{label}-edges")
        forget(before)
        if rooted is None:
            rooted = points
        else:
            up = rooted.join(to, F.col("root") == F.col("_n"), "left").select("node", F.coalesce("_r", "root").alias("root"))
            before, rooted = rooted, materialize(up, f"{label}-roots")
            forget(before)
            forget(points)
    forget(left)
    if rooted is None:
        rooted = materialize(spark.createDataFrame([], "node long, root long"), f"{label}-roots")
    return rooted
