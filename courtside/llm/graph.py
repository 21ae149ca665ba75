"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courtside.llm.common import forget, stored


def _stars(links: DataFrame, *, large: bool) -> DataFrame:
    """Hang each node's larger (large star) or smaller (small star) neighbours on the smallest one, itself included.

    The smallest neighbour is a sum per node, joined back, so no neighbourhood is gathered in one place.
    """
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    seen = both if large else both.filter("b < a")
    lowest = seen.groupBy("a").agg(F.min("b").alias("low")).withColumn("low", F.least("a", "low"))
    hung = seen.join(lowest, "a")
    moved = hung.filter("b > a").select(F.col("low").alias("a"), "b") if large else hung.select(F.col("low").alias("a"), "b").unionByName(lowest.select(F.col("low").alias("a"), F.col("a").alias("b")))
    return moved.filter("a < b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (columns a, b; a < b), root being its component's smallest node.

    Rounds go on until the links no longer change, which takes about the logarithm of the longest path. No links, no rows.
    """
    at, before = stored(links.select("a", "b").filter("a < b").distinct()), None
    while True:
        mark = at.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == before:
            break
        before = mark
        last, at = at, stored(_stars(_stars(at, large=True), large=False))
        forget(last)
    roots = at.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct().join(roots.select("node"), "node", "left_anti"))
