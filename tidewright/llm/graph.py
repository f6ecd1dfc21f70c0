"""Connected components of links, all on executors: alternating large-star and small-star steps.

Each step keeps the components and moves every node nearer to its smallest one; at the fixed point each node has one
link, to the smallest node it can reach. Steps are written to the shared folder, so lineage stays short."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm.common import removed, written


def _mark(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """(node, comp): the smallest node reachable from each node of ``links`` (u, v); a pair of equal ends adds its node alone."""
    alone = links.select(F.col("u").alias("node")).unionByName(links.select(F.col("v").alias("node"))).distinct()
    now = written(links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    mark = _mark(now)
    while mark[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("u", "m").alias("m"))
        large = both.join(least, F.col("u") == F.col("c")).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), "m")
        small = large.join(least, F.col("u") == F.col("c"))
        small = small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select(F.col("c").alias("u"), F.col("m").alias("v"))).distinct()
        old, now = now, written(small, "links")
        removed(old)
        before, mark = mark, _mark(now)
        if mark == before:
            break
    found = now.select(F.col("u").alias("n"), F.col("v").alias("comp"))
    return alone.join(found, F.col("node") == F.col("n"), "left").select("node", F.coalesce("comp", "node").alias("comp"))
