"""Connected components of a link table, by hooking to the smallest neighbour and jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sectionspark.llm.scratch import dropped, stored


def components(links: DataFrame) -> DataFrame:
    """links: columns u, v (BIGINT). Returns (id, component) for every id in a link with
    another; the component is the smallest id reachable.

    Links point from the larger to the smaller id. A turn replaces the links of u by links of
    u and of its neighbours to the smallest neighbour, and each end by its own smallest
    neighbour, until all links point to ends that have none: stars, which most callers give,
    need no turn at all. No neighbourhood is collected, so a node with a third of all links is
    only a skewed join key. Each turn is written to the shared folder.
    """
    now = stored(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    while True:
        least = now.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        ends = least.select(F.col("u").alias("e"), F.col("m").alias("e_m"))
        most, chained = least.join(ends, F.col("m") == F.col("e"), "left").agg(F.max("n"), F.count("e")).first()
        if (most or 1) == 1 and not chained:
            break
        joined = now.join(least, "u")
        pairs = joined.select("m", F.explode(F.array("u", "v")).alias("x")).where("x <> m")
        after = pairs.join(ends, F.col("m") == F.col("e"), "left").select(F.col("x").alias("u"), F.coalesce("e_m", "m").alias("v"))
        # the end itself keeps its link to its own smallest neighbour by its own row
        after = stored(after.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
        dropped(now)
        now = after
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).union(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
