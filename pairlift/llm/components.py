"""Connected components of a table of links, by alternating star operations.

Each round hangs the larger neighbours of a node on its smallest neighbour, then the
smaller ones; stars stop changing after O(log n) rounds or so. Links stay in tables: the
driver sees one count and one checksum a round. A node with very many links is a hot join
key, which adaptive execution splits; the minimum before it is combined on the map side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pairlift.llm.common import staged


def _checksum(links: DataFrame) -> tuple:
    row = links.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x"), F.sum(F.hash("u", "v").cast("long")).alias("s")).first()
    return tuple(row)


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b) but the roots themselves; root: the smallest node reachable."""
    links = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    links = staged(links, "links")
    before, now = None, _checksum(links)
    while now != before and now[0]:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(staged(least, "least"), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = staged(large, "large-star")
        least = staged(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = staged(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "small-star")
        before, now = now, _checksum(links)
    return links.select(F.col("u").alias("node"), F.col("v").alias("root"))
