"""Connected components of who met whom."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courtside.shared import forget, stored


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """node, root for every node of the edges (two columns of one type): root is the smallest node that is reachable.

    Each round a node takes the smallest root among its neighbours and then its root's root, so the rounds grow with the
    logarithm of the longest path. Both are joins and sums per node, without a neighbourhood in one place. Edges with a null
    end are left out.
    """
    known = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).filter("x is not null and y is not null")
    ways = F.array(F.struct("x", "y"), F.struct(F.col("y").alias("x"), F.col("x").alias("y")))
    links = stored(known.select(F.inline(ways)).distinct())  # both ways from one scan
    roots = stored(links.groupBy(F.col("x").alias("node")).agg(F.min(F.least("x", "y")).alias("root")))
    while True:
        near = links.join(roots, F.col("y") == F.col("node")).groupBy("x").agg(F.min("root").alias("near"))
        moved = stored(roots.join(near, F.col("node") == F.col("x")).select("node", F.least("root", "near").alias("root"), F.col("root").alias("was")))
        changed = moved.filter("root <> was").limit(1).count()
        up = moved.select(F.col("node").alias("at"), F.col("root").alias("up"))
        last, roots = roots, stored(moved.join(up, F.col("root") == F.col("at")).select("node", F.col("up").alias("root")))
        forget(last, moved)
        if not changed:
            forget(links)
            return roots
