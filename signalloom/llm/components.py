"""Connected components of an edge table by alternating stars, over the cluster.

Large star: every node hands the smallest of its neighbourhood to its larger neighbours. Small star: every node hands it to
its smaller ones and itself. Each round is two aggregations and two joins on the edges alone, and a component of any shape
becomes a star around its smallest node after about log2 of its diameter rounds. Every round is written to the shared
folder, so lineage stays short and lost executors cost one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalloom.llm.common import files_for, materialise


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    """One star operation on (u, v) with u != v; returns distinct (u, v) with v the smaller."""
    if larger:
        arcs = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        arcs = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = arcs.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    joined = arcs.join(least, "u")
    if larger:
        out = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.filter("u != v").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of (u, v): root is the smallest node that it reaches."""
    edges = materialise(edges.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    state, files = None, files_for(edges.count())
    while True:
        edges = materialise(_star(_star(edges, True), False).repartition(files), "edges")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
