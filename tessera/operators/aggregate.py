"""Neighbour aggregation whose result no placement may change.

Features are long: (v, c, x). A layer is a join of edges with features and a
sum; sharding only adds a column to group by.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.graphs import TemporalGraph
from .supra import both_ways


def features(g: TemporalGraph, columns: int = 8) -> DataFrame:
    """v, c, x: whole numbers by a fixed rule."""
    c = g.spark.range(columns).select(F.col("id").alias("c"))
    return g.vertices().select("v").join(F.broadcast(c)).select("v", "c", ((F.col("v") * 7 + F.col("c") * 13) % 11).alias("x"))


def neighbour_sum(g: TemporalGraph, x: DataFrame) -> DataFrame:
    """v, c, x: sums over neighbours, one for each edge and way; 0 for isolated vertices."""
    s = both_ways(g.edges).join(x.withColumnRenamed("v", "b"), "b").groupBy(F.col("a").alias("v"), "c").agg(F.sum("x").alias("s"))
    return x.select("v", "c").join(s, ["v", "c"], "left").select("v", "c", F.coalesce("s", F.lit(0)).alias("x"))


def neighbour_mean(g: TemporalGraph, x: DataFrame, layers: int, loops: bool = False) -> DataFrame:
    """v, c, x after layers of relu(mean over neighbours), with the vertex itself among them if ``loops``."""
    e = both_ways(g.edges)
    if loops:
        e = e.unionAll(g.vertices().select(F.col("v").alias("a"), F.col("v").alias("b")))
    deg = e.groupBy(F.col("a").alias("v")).agg(F.count("*").alias("d"))
    for _ in range(layers):
        s = e.join(x.withColumnRenamed("v", "b"), "b").groupBy(F.col("a").alias("v"), "c").agg(F.sum("x").alias("s")).join(deg, "v")
        x = x.select("v", "c").join(s, ["v", "c"], "left").select("v", "c", F.greatest(F.lit(0.0), F.coalesce(F.col("s") / F.col("d"), F.lit(0.0))).alias("x"))
    return x


def dense(x: DataFrame, weights: DataFrame) -> DataFrame:
    """v, c, x of x times a matrix (i, j, w): relu of the sums."""
    return x.join(F.broadcast(weights), x["c"] == weights["i"]).groupBy("v", F.col("j").alias("c")).agg(F.greatest(F.lit(0), F.sum(F.col("x") * F.col("w"))).alias("x"))


def sharded_layer(g: TemporalGraph, x: DataFrame, weights: DataFrame, shards: int) -> DataFrame:
    """A layer with columns, and the matrix's rows, dealt to shards: partial products are summed before the relu."""
    shard = x.withColumn("shard", F.col("c") % shards)
    s = both_ways(g.edges).join(shard.withColumnRenamed("v", "b"), "b").groupBy(F.col("a").alias("v"), "c", "shard").agg(F.sum("x").alias("x"))
    w = F.broadcast(weights.withColumn("shard", F.col("i") % shards))
    part = s.join(w, (s["c"] == w["i"]) & (s["shard"] == w["shard"])).groupBy("v", "j", s["shard"]).agg(F.sum(F.col("x") * F.col("w")).alias("p"))
    return part.groupBy("v", F.col("j").alias("c")).agg(F.greatest(F.lit(0), F.sum("p")).alias("x"))


def largest_difference(one: DataFrame, two: DataFrame) -> DataFrame:
    """rows, max_abs_diff of two feature tables; a row of only one of them counts in full."""
    j = one.withColumnRenamed("x", "p").join(two.withColumnRenamed("x", "q"), ["v", "c"], "full")
    return j.agg(F.count("*").alias("rows"), F.max(F.abs(F.coalesce("p", F.lit(0)) - F.coalesce("q", F.lit(0)))).alias("max_abs_diff"))


def partitioned_sum(g: TemporalGraph, x: DataFrame, place: DataFrame) -> DataFrame:
    """The neighbour sum from each part's own rows and the halo rows that it receives, and nothing else."""
    home = place.select("v", "part")
    e = both_ways(g.edges).join(home.withColumnRenamed("v", "a"), "a")
    need = e.select("part", "b").distinct()
    received = need.join(x.withColumnRenamed("v", "b"), "b")
    s = e.join(received, ["part", "b"]).groupBy(F.col("a").alias("v"), "c").agg(F.sum("x").alias("s"))
    return x.select("v", "c").join(s, ["v", "c"], "left").select("v", "c", F.coalesce("s", F.lit(0)).alias("x"))
