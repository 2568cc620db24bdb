"""Connected components of a table of links, by minimum labels with pointer jumping; no row leaves the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def components(links: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable from each id of links (a, b); ids without a link are absent.

    Each round gives every node the least label among itself and its neighbours, then the label's label; links are drawn anew between the
    labels, and those inside one label are done with. So the links shrink from round to round, whose number grows with the logarithm
    of a component's diameter. Every round is a table in the shared folder.
    """
    edges = cut(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "links")
    found = None
    while True:
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = cut(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("low")).select("id", F.least("id", "low").alias("mid")), "labels")
        far = low.select(F.col("id").alias("mid"), F.col("mid").alias("far"))
        step = cut(low.join(far, "mid").select("id", F.col("far").alias("component")), "labels")
        if found is None:
            found = step
        else:  # nodes whose label was not looked at keep it
            now = step.select(F.col("id").alias("component"), F.col("component").alias("_now"))
            found = cut(found.join(now, "component", "left").select("id", F.coalesce("_now", "component").alias("component")), "labels")
        name = {side: step.select(F.col("id").alias(side), F.col("component").alias(f"c{side}")) for side in "ab"}
        drawn = edges.join(name["a"], "a").join(name["b"], "b").where("ca <> cb")
        edges = cut(drawn.select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).distinct(), "links")
        if edges.isEmpty():
            return found


def joined_components(found: DataFrame, more: DataFrame) -> DataFrame:
    """The components after further links (a, b): only components that these join are looked at."""
    name = {side: found.select(F.col("id").alias(side), F.col("component").alias(f"c{side}")) for side in "ab"}
    placed = more.join(name["a"], "a", "left").join(name["b"], "b", "left").select("a", "b", F.coalesce("ca", "a").alias("ca"), F.coalesce("cb", "b").alias("cb"))
    placed = cut(placed, "links-placed")
    merged = components(placed.where("ca <> cb").select(F.col("ca").alias("a"), F.col("cb").alias("b")))
    fresh = placed.select(F.col("a").alias("id")).union(placed.select("b")).distinct().join(found, "id", "left_anti")
    every = found.unionByName(fresh.withColumn("component", F.col("id")))
    now = merged.select(F.col("id").alias("component"), F.col("component").alias("_low"))
    return cut(every.join(now, "component", "left").select("id", F.coalesce("_low", "component").alias("component")), "labels")
