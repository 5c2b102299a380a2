"""Connected components of an edge list, as joins and aggregations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import Workspace


def connected_components(edges: DataFrame, ws: Workspace, name: str = "cc") -> DataFrame:
    """node, component (the smallest node reachable) for each node of ``edges`` (u, v).

    Alternating large-star and small-star steps (Kiveris and others, 2014): every step hangs
    neighbours on the smallest node known, by a combinable minimum and a join, so a node with very
    many edges makes no quadratic work; after O(log^2 n) steps all components are stars. Each step is
    written to the shared folder. Edges with a null end, loops and repeated edges are dropped; no
    edges give no rows.
    """
    e = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u is not null and v is not null and u <> v").distinct()
    e = ws.save(e, f"{name}0")
    seen, step = None, 0
    while True:
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now[0] == 0 or now == seen:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select("v", "v").distinct())
        seen = now
        low = e.groupBy("u").agg(F.min("v").alias("m"))
        large = e.join(low.withColumnRenamed("u", "lu"), F.col("v") == F.col("lu"), "left").select("u", F.coalesce("m", "v").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(low.select("u", F.col("m").alias("v")))
        step += 1
        e = ws.save(small.distinct(), f"{name}{step}")
        ws.drop(f"{name}{step - 1}")
