"""Features and samples for training on temporal graphs: the data side only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.graphs import TemporalGraph
from .supra import both_ways
from .temporal import with_snap


def vertex_features(edges: DataFrame, column: str = "efeat") -> DataFrame:
    """v, c, x: the mean of each component of an array column over the edge ends at a vertex; a loop counts twice."""
    e = both_ways(edges, column).select(F.col("a").alias("v"), F.posexplode(column).alias("c", "x"))
    return e.groupBy("v", F.col("c").cast("long").alias("c")).agg(F.avg("x").alias("x"))


def negatives(g: TemporalGraph, seed: int = 0) -> DataFrame:
    """pos, src, dst, label: each edge with label 1, and once more with a destination drawn by a hash of its position, label 0.

    A draw that gives the edge's own destination takes the next vertex.
    """
    n = max(1, g.num_nodes)
    draw = (F.col("pos") * 2654435761 + seed * 40503 + 12345) % 4294967296 % n
    other = F.when(draw == F.col("dst"), (draw + 1) % n).otherwise(draw)
    real = g.edges.select("pos", "src", "dst", F.lit(1).alias("label"))
    return real.unionAll(g.edges.select("pos", "src", other.cast("long").alias("dst"), F.lit(0).alias("label")))


def message_means(g: TemporalGraph, snaps: int, value: str) -> DataFrame:
    """snap, v, messages, mean: of an expression over the edges that come to a vertex in a snapshot."""
    e = with_snap(g, snaps).select("snap", F.col("dst").alias("v"), F.expr(value).alias("x"))
    return e.groupBy("snap", "v").agg(F.count("*").alias("messages"), F.avg("x").alias("mean"))


def decayed(g: TemporalGraph, snaps: int, width: int, decay: float) -> DataFrame:
    """snap, v, x: edge ends at a vertex in the last ``width`` snapshots, each snapshot back weighing ``decay`` times less.

    A sliding frame with decay: counts go to the snapshots that they reach, ``width`` rows at most, and are summed there.
    """
    c = both_ways(with_snap(g, snaps), "snap").groupBy(F.col("a").alias("v"), "snap").agg(F.count("*").alias("c"))
    reach = c.select("v", F.explode(F.expr(f"sequence(snap, least(snap + {width - 1}, {snaps - 1}))")).alias("to"), "snap", "c")
    return reach.groupBy(F.col("to").alias("snap"), "v").agg(F.sum(F.col("c") * F.pow(F.lit(decay), F.col("to") - F.col("snap"))).alias("x"))


def half_precision(column: str):
    """The nearest number that 16-bit floats have (ties to even): 10 bits after the first, steps of 2^-24 below 2^-14, infinity from 65520 on."""
    x = F.abs(F.col(column).cast("double"))
    step = F.pow(F.lit(2.0), F.greatest(F.lit(-14.0), F.floor(F.log2(F.greatest(x, F.lit(2.0**-24))))) - 10)
    near = F.bround(x / step) * step
    return F.signum(F.col(column).cast("double")) * F.when(near > 65504, F.lit(float("inf"))).otherwise(near)
