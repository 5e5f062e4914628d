"""Synthetic temporal graphs from ``spark.range`` and hashes of the row number: repeatable at any parallelism."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ONE = 1 << 30


def draw(row: str, salt: int) -> Column:
    """A number in [0, 1) of a row and a salt."""
    return F.pmod(F.xxhash64(row, F.lit(salt)), F.lit(ONE)) / float(ONE)


def pick(row: str, salt: int, n: int | Column) -> Column:
    return F.floor(draw(row, salt) * n).cast("long")


def rmat(spark: SparkSession, log2_nodes: int, edges: int, a: float = 0.57, b: float = 0.19, c: float = 0.19, seed: int = 0) -> DataFrame:
    """src, dst, t: a quadrant drawn for each bit."""
    e = spark.range(edges)
    src = dst = F.lit(0).cast("long")
    for k in range(log2_nodes):
        r = draw("id", seed * 1000 + k)
        src = src * 2 + F.when(r < a + b, 0).otherwise(1)
        dst = dst * 2 + F.when((r < a) | ((r >= a + b) & (r < a + b + c)), 0).otherwise(1)
    return e.select(src.cast("long").alias("src"), dst.cast("long").alias("dst"), F.col("id").alias("t"))


def communities(spark: SparkSession, nodes: int, edges: int, groups: int, inside: float = 0.9, seed: int = 0) -> DataFrame:
    """src, dst, t: most edges stay within the source's group of ids."""
    size = max(1, nodes // groups)
    e = spark.range(edges).withColumn("src", pick("id", seed * 10 + 1, nodes))
    own = (F.col("src") - F.col("src") % size) + pick("id", seed * 10 + 2, size)
    dst = F.when(draw("id", seed * 10 + 3) < inside, F.least(own, F.lit(nodes - 1))).otherwise(pick("id", seed * 10 + 4, nodes))
    return e.select("src", dst.cast("long").alias("dst"), F.col("id").alias("t"))


def hotspot(spark: SparkSession, nodes: int, edges: int, groups: int, snaps: int, hot: float = 0.7, seed: int = 0) -> DataFrame:
    """src, dst, t: a share of the edges falls in one group, which moves on with time."""
    size = max(1, nodes // groups)
    e = spark.range(edges).withColumn("s", F.expr(f"id * {snaps} div {max(1, edges)}"))
    at = F.expr(f"s * {groups} div {snaps}") * size
    here = draw("id", seed * 10 + 5) < hot
    end = lambda k: F.least(F.when(here, at + pick("id", seed * 10 + k, size)).otherwise(pick("id", seed * 10 + k, nodes)), F.lit(nodes - 1)).cast("long")
    return e.select(end(6).alias("src"), end(7).alias("dst"), F.col("id").alias("t"))


def feature_widths(spark: SparkSession, nodes: int, share: float, rich: int, base: int, seed: int = 0) -> DataFrame:
    """v, fv: a share of the vertices is wide."""
    return spark.range(nodes).select(F.col("id").alias("v"), F.when(draw("id", seed + 99) < share, rich).otherwise(base).cast("long").alias("fv"))
