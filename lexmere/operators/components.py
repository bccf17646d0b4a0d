"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmere.session import stored


def connected_components(edges: DataFrame) -> DataFrame:
    """(a, b) bigint edges -> (node, root): root is the least node reachable.

    Alternating large-star and small-star rounds; every round is a partial
    aggregate and an equi-join (which AQE splits at hot nodes), and ends in a
    stored table. Self loops and repeated edges are ignored; nodes that are
    their own root do not appear.
    """
    pair = lambda x, y: (F.greatest(x, y).alias("a"), F.least(x, y).alias("b"))
    e = stored(edges.where("a <> b").select(*pair("a", "b")).distinct())
    seen = None
    while True:
        mark = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen or not mark[0]:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = mark
        both = e.selectExpr("a u", "b v").union(e.selectExpr("b u", "a v"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").selectExpr("v a", "m b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        linked = large.join(least, "a")
        e = stored(linked.select("a", F.col("m").alias("b")).union(linked.select(*pair("b", "m"))).where("a <> b").distinct())
