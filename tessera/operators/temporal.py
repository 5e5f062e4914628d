"""Order, snapshots, windows and slices of temporal edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.position import with_position
from ..sources.graphs import TemporalGraph


def summary(g: TemporalGraph) -> DataFrame:
    """n, e, tmin, tmax, span; zeros for an empty graph."""
    return g.edges.agg(F.count("*").alias("e"), F.coalesce(F.min("t"), F.lit(0)).alias("tmin"), F.coalesce(F.max("t"), F.lit(0)).alias("tmax")).select(
        F.lit(g.num_nodes).cast("long").alias("n"), "e", "tmin", "tmax", (F.col("tmax") - F.col("tmin")).alias("span")
    )


def div(a: Column, b) -> Column:
    """Floor division of non-negative whole numbers."""
    return F.floor(a / b) if not isinstance(b, int) else ((a - a % b) / b).cast("long")


def snap_of(g: TemporalGraph, snaps: int) -> Column:
    """Equal-count snapshot of ``pos``: floor(pos * S / E), not ntile, which puts the remainder in front."""
    return F.least(F.expr(f"pos * {snaps} div {max(g.num_edges, 1)}"), F.lit(snaps - 1)).cast("long")


def with_snap(g: TemporalGraph, snaps: int) -> DataFrame:
    return g.edges.withColumn("snap", snap_of(g, snaps))


def snap_count(g: TemporalGraph, snaps: int) -> DataFrame:
    return with_snap(g, snaps).groupBy("snap").agg(F.count("*").alias("edges"))


def snap_width(g: TemporalGraph, num: int = 32, interval: int | None = None) -> DataFrame:
    """Equal-width slices (index, t_start, t_end, lo, hi); empty ones are left out and the rest numbered anew."""
    if not g.num_edges:
        return g.spark.createDataFrame([], "index long, t_start long, t_end long, lo long, hi long")
    row = g.edges.agg(F.min("t").alias("a"), F.max("t").alias("b")).first()
    step = interval or max(1, -(-(row["b"] - row["a"] + 1) // num))
    b = g.edges.withColumn("bucket", F.expr(f"(t - {row['a']}) div {step}")).groupBy("bucket").agg(F.min("pos").alias("lo"), (F.max("pos") + 1).alias("hi"))
    start = F.lit(row["a"]) + F.col("bucket") * step
    # One row a slice: a small table, so one task may number it.
    return b.select((F.row_number().over(Window.orderBy("bucket")) - 1).cast("long").alias("index"), start.alias("t_start"), (start + step).alias("t_end"), "lo", "hi")


def windows(snaps: DataFrame, size: int, stride: int) -> DataFrame:
    """window_id and edges of runs of ``size`` snapshots; a trailing partial run is left out, one short run stays if there are too few."""
    n = snaps.agg(F.max("index")).first()[0]
    spark = snaps.sparkSession
    if n is None:
        return spark.createDataFrame([], "window_id long, edges long")
    starts = spark.range(0, max(0, n + 1 - size) + 1, stride).select(F.col("id").alias("window_id"))
    inside = (F.col("index") >= F.col("window_id")) & (F.col("index") < F.col("window_id") + size)
    return snaps.join(F.broadcast(starts), inside).groupBy("window_id").agg(F.sum(F.col("hi") - F.col("lo")).alias("edges"))


def time_slice(edges: DataFrame, t0: int, t1: int) -> DataFrame:
    """Edges with t0 <= t < t1; the range reaches the Parquet scan."""
    return edges.where((F.col("t") >= t0) & (F.col("t") < t1))


def remap_dense(edges: DataFrame) -> DataFrame:
    """old_id, new_id: ids in order, from 0."""
    ids = edges.select(F.explode(F.array("src", "dst")).alias("old_id")).distinct()
    return with_position(ids, ["old_id"], "new_id").select("old_id", "new_id")


def warm_split(g: TemporalGraph, share_num: int = 7, share_den: int = 10) -> DataFrame:
    """Edges marked train, or test if both ends were seen in training; later edges with an unseen end go."""
    cut = g.num_edges * share_num // share_den
    train, rest = g.edges.where(F.col("pos") < cut), g.edges.where(F.col("pos") >= cut)
    seen = train.select(F.explode(F.array("src", "dst")).alias("v")).distinct()
    warm = rest.join(seen.withColumnRenamed("v", "src"), "src", "left_semi").join(seen.withColumnRenamed("v", "dst"), "dst", "left_semi")
    cols = ["pos", "src", "dst", "t"]
    return train.select(*cols, F.lit("train").alias("part")).unionAll(warm.select(*cols, F.lit("test").alias("part")))


def top_k(scores: DataFrame, k: int, score: str = "score", key: str = "v") -> DataFrame:
    """The k rows of the highest score, ties by the least key."""
    return scores.orderBy(F.desc(score), key).limit(k)


def fake_quantised(values: DataFrame, column: str, levels: int = 127) -> DataFrame:
    """``column`` rounded half to even to ``levels`` steps of its greatest magnitude, as ``q``."""
    top = values.agg(F.max(F.abs(column)).alias("_top"))
    scale = F.when(F.col("_top") > 0, F.col("_top") / levels).otherwise(1.0)
    return values.join(F.broadcast(top)).withColumn("q", F.bround(F.col(column) / scale) * scale).drop("_top")
