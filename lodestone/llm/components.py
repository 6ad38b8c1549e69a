"""Connected components of an edge table, by DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each node of the (a, b) edges reaches.

    Alternates two steps until nothing changes: each node's larger neighbours are
    linked to its smallest neighbour, then its smaller neighbours are. The number
    of rounds grows with the logarithm of the number of nodes. Every round is a
    written table; nothing is gathered.
    """
    def content(table: DataFrame) -> tuple:
        """What two tables of distinct pairs have in common only if they are equal: a count and 128 bits."""
        return tuple(table.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))).first())

    links = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = content(links)
    while True:
        both = links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        lower = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lower, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionAll(lower.select("a", F.col("m").alias("b"))).distinct()
        links = written(small, "links")
        after = content(links)
        if after == before:
            break
        before = after
    roots = links.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(roots)
