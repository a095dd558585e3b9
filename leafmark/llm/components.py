"""Connected components by alternating stars, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmark.llm.common import cut


def _mark(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """(a, b) links -> (node, comp): comp is the least node of the component; nodes without links don't appear.

    Each round every node links its larger neighbours to its least one (large star), then its smaller neighbours to
    the least of them (small star), and writes the links to the shared folder. It ends when a round changes nothing,
    after O(log^2 n) rounds at most. A hub is pre-aggregated by min(); its join can be split by AQE. Self-links and
    nulls are ignored; an empty table gives an empty table.
    """
    links = cut(
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    mark = _mark(links)
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        small_least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(small_least, "a")
        links = cut(
            small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionByName(small_least.select("a", F.col("m").alias("b")))
            .distinct()
        )
        before, mark = mark, _mark(links)
        if mark == before:
            break
    roots = links.select(F.col("b").alias("node")).distinct().withColumn("comp", F.col("node"))
    return links.select(F.col("a").alias("node"), F.col("b").alias("comp")).unionByName(roots)
