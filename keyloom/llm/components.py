"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.session import settled_clean as settled


def _least(links: DataFrame) -> DataFrame:
    """(u, v, m): every neighbour v of u, and the least of u and its neighbours."""
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    return both.join(least, "u")


def _large_star(links: DataFrame) -> DataFrame:
    return _least(links).where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v")
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    rows = down.join(least, "u")
    return rows.select(F.col("v").alias("a"), F.col("m").alias("b")).unionAll(least.select(F.col("u").alias("a"), F.col("m").alias("b")))


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node in ``links`` (a, b); the component is its least node.

    Every round writes its links to the shared folder, where it cuts the lineage; a long
    chain takes a number of rounds in proportion to the logarithm of its length.
    """
    now = settled(links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = None
    while True:
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).head()
        if mark == before:
            break
        before = mark
        now = settled(_small_star(_large_star(now)).where("a != b").distinct(), "links")
    star = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return star.unionAll(roots)
