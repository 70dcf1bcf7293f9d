"""Connected components of a table of links, by alternating large-star and small-star rounds (Kiveris and others 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowkin.llm.common import forget, stored


def _star(links: DataFrame) -> tuple[DataFrame, str]:
    """Large star: every larger neighbour of a node moves to the least of the node and its neighbours; and a path to forget.

    The least neighbours are a written table, so that the links of one node can be dealt to several tasks of the join.
    """
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least, path = stored(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")), path


def _small_star(links: DataFrame) -> DataFrame:
    """Small star: a node and its smaller neighbours move to the least of these. Takes links with a > b."""
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    moved = links.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b")))


def components(links: DataFrame) -> tuple[DataFrame, str]:
    """(node, root) of every linked node, root being the least node of its component, and the path of that table.

    ``links``: columns a, b (long), in any direction, repeats and loops allowed. Each round is a written table, so
    lineage stays short and lost executors cost one round. Stars of any size are joined, never gathered. Ends when a
    round changes nothing: then all links are stars around the least node. Labels only ever fall, so that always comes.
    """
    spark = links.sparkSession
    one = links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, path = stored(one, "links")
    mark = None
    while True:
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == mark or not seen[0]:
            break
        mark = seen
        moved, least_path = _star(now)
        new, new_path = stored(_small_star(moved.filter("a <> b").distinct()).distinct(), "links")
        forget(spark, path)
        forget(spark, least_path)
        now, path = new, new_path
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()), path
