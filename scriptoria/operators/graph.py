"""Connected components of links, by stars that shrink: no component is ever gathered in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptoria.operators.tables import settled


def _large_star(links: DataFrame) -> DataFrame:
    """Every node links its greater neighbours to the least of itself and all its neighbours."""
    both = links.select(F.col("low").alias("u"), F.col("high").alias("v")).unionByName(links.select(F.col("high").alias("u"), F.col("low").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("least")).select("u", F.least("u", "least").alias("low"))
    return both.where("v > u").join(least, "u").select("low", F.col("v").alias("high")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Every node links its smaller neighbours and itself to the least of these."""
    least = links.groupBy("high").agg(F.min("low").alias("least"))
    others = links.join(least, "high").where("low > least").select(F.col("least").alias("low"), F.col("low").alias("high"))
    return others.unionByName(least.select(F.col("least").alias("low"), "high")).distinct()


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """node and component, the smallest node that it reaches, for every node of links (columns a and b, longs or strings).

    Links may be repeated, run in either direction or join a node to itself; rows with a null end are no links. Each round
    writes its links and ends where nothing changed: chains of n links need about log n rounds. Without links there are no rows.
    """
    ends = links.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    alone = ends.where("a = b").select(F.col("a").alias("node")).distinct()
    now = settled(ends.where("a <> b").select(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high")).distinct())
    before = None
    while (sums := now.agg(F.count("*"), F.sum(F.xxhash64("low", "high").cast("decimal(38,0)"))).head()) != before:
        before, now = sums, settled(_small_star(_large_star(now)))
    members = now.select(F.col("high").alias("node"), F.col("low").alias("component"))
    roots = now.select(F.col("low").alias("node"), F.col("low").alias("component")).distinct()
    found = members.unionByName(roots)
    return found.unionByName(alone.join(found.select("node"), "node", "left_anti").select("node", F.col("node").alias("component")))
