"""The vertex-by-time graph: cells, their pairs, and cuts of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.position import with_position
from ..sources.graphs import TemporalGraph
from .temporal import with_snap


def both_ways(edges: DataFrame, *keep: str) -> DataFrame:
    """(a, b) and (b, a) of every edge; a loop comes twice."""
    return edges.select(F.col("src").alias("a"), F.col("dst").alias("b"), *keep).unionAll(edges.select(F.col("dst").alias("a"), F.col("src").alias("b"), *keep))


def active(g: TemporalGraph, snaps: int) -> DataFrame:
    """v, snap: a vertex active in a snapshot, once."""
    return both_ways(with_snap(g, snaps), "snap").select(F.col("a").alias("v"), "snap").distinct()


def cells(g: TemporalGraph, snaps: int) -> DataFrame:
    """cell_id, v, snap; ids in (v, snap) order."""
    return with_position(active(g, snaps), ["v", "snap"], "cell_id").select("cell_id", "v", "snap")


def spatial_pairs(g: TemporalGraph, cell: DataFrame, snaps: int) -> DataFrame:
    """pos, snap, a, b: the cells of an edge's ends, one row per edge, loops left out."""
    e = with_snap(g, snaps).where("src <> dst")
    one = cell.select(F.col("cell_id").alias("a"), F.col("v").alias("src"), "snap")
    two = cell.select(F.col("cell_id").alias("b"), F.col("v").alias("dst"), "snap")
    return e.join(one, ["src", "snap"]).join(two, ["dst", "snap"]).select("pos", "snap", "a", "b")


def temporal_pairs(cell: DataFrame) -> DataFrame:
    """v, a, b: cells of one vertex in consecutive active snapshots."""
    w = Window.partitionBy("v").orderBy("snap")
    return cell.select("v", F.lag("cell_id").over(w).alias("a"), F.col("cell_id").alias("b")).where("a IS NOT NULL")


def cuts(spatial: DataFrame, temporal: DataFrame, dev: DataFrame) -> DataFrame:
    """spatial, temporal: pairs whose cells (cell_id, dev) are on different devices."""
    da, db = dev.select(F.col("cell_id").alias("a"), F.col("dev").alias("da")), dev.select(F.col("cell_id").alias("b"), F.col("dev").alias("db"))
    count = lambda p, name: p.join(da, "a").join(db, "b").agg(F.count_if(F.col("da") != F.col("db")).alias(name))
    return count(spatial, "spatial").join(count(temporal, "temporal"))


def blocks_of(cell: DataFrame, column: str, parts: int) -> DataFrame:
    """cell_id, dev: contiguous blocks of the distinct values of ``column``: rank * D div distinct."""
    ranks = with_position(cell.select(column).distinct(), [column], "r")
    n = ranks.count()
    return cell.join(ranks, column).select("cell_id", F.expr(f"r * {parts} div {max(n, 1)}").alias("dev"))


def majority_fold(g: TemporalGraph, cell_dev: DataFrame) -> DataFrame:
    """v, part: the device of most of a vertex's cells (v, dev), ties to the least; 0 for a vertex without cells."""
    count = cell_dev.groupBy("v", "dev").agg(F.count("*").alias("c"))
    best = count.groupBy("v").agg(F.min(F.struct((-F.col("c")).alias("c"), "dev")).alias("m")).select("v", F.col("m.dev").alias("part"))
    return g.vertices().select("v").join(best, "v", "left").select("v", F.coalesce("part", F.lit(0)).cast("long").alias("part"))


def factor_cuts(g: TemporalGraph, snaps: int, factors: list[tuple[int, int]]) -> DataFrame:
    """dv, dt, sc, tc for vertex blocks v * dv div N and time blocks snap * dt div S; tc counts a vertex's blocks less one."""
    spark, n = g.spark, max(g.num_nodes, 1)
    f = F.broadcast(spark.createDataFrame(factors, "dv long, dt long"))
    e = with_snap(g, snaps)
    sc = e.groupBy("src", "dst").agg(F.count("*").alias("c")).join(f).where(F.expr(f"src * dv div {n} <> dst * dv div {n}")).groupBy("dv", "dt").agg(F.sum("c").alias("sc"))
    t = active(g, snaps).join(f).groupBy("dv", "dt", "v").agg((F.count_distinct(F.expr(f"snap * dt div {snaps}")) - 1).alias("x")).groupBy("dv", "dt").agg(F.sum("x").alias("tc"))
    return f.join(sc, ["dv", "dt"], "left").join(t, ["dv", "dt"], "left").select("dv", "dt", F.coalesce("sc", F.lit(0)).cast("long").alias("sc"), F.coalesce("tc", F.lit(0)).cast("long").alias("tc"))


def mixed_cut(g: TemporalGraph, snaps: int, dc: int, dp: int, core: DataFrame) -> DataFrame:
    """sc, tc of a mixed granularity: core vertices (v) in dc vertex blocks, others in dp time blocks."""
    n = max(g.num_nodes, 1)
    flag = core.select("v", F.lit(True).alias("core"))
    place = lambda v, c: F.when(F.col(c), F.expr(f"{v} * {dc} div {n}")).otherwise(F.lit(dc) + F.expr(f"snap * {dp} div {snaps}"))
    e = with_snap(g, snaps).join(flag.withColumnsRenamed({"v": "src", "core": "cs"}), "src", "left").join(flag.withColumnsRenamed({"v": "dst", "core": "cd"}), "dst", "left")
    sc = e.fillna(False, ["cs", "cd"]).agg(F.count_if(place("src", "cs") != place("dst", "cd")).alias("sc"))
    a = active(g, snaps).join(flag, "v", "left").fillna(False, ["core"])
    tc = a.groupBy("v").agg((F.count_distinct(place("v", "core")) - 1).alias("x")).agg(F.coalesce(F.sum("x"), F.lit(0)).cast("long").alias("tc"))
    return sc.join(tc)


def temporal_bound(g: TemporalGraph, snaps: int, parts: int) -> DataFrame:
    """l_temporal: sum over vertices of (|T_v| - 1) / (S - 1) * (k_v - 1), with k_v the time blocks a vertex is active in; numerator only."""
    t = active(g, snaps).groupBy("v").agg(F.count("*").alias("tv"), F.count_distinct(F.expr(f"snap * {parts} div {snaps}")).alias("k"))
    return t.agg(F.sum((F.col("tv") - 1) * (F.col("k") - 1)).cast("long").alias("numerator"), F.lit(snaps - 1).cast("long").alias("denominator"))
