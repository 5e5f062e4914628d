"""What a placement of vertices on devices costs: counts that the cost model prices.

Placements are tables (v, part); joins with them are left to the planner, which
broadcasts them while they are small and shuffles both sides when they aren't.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.graphs import TemporalGraph
from .stats import degree
from .supra import both_ways


def domain(g: TemporalGraph, parts: int) -> DataFrame:
    return g.spark.range(parts).select(F.col("id").alias("part"))


def filled(g: TemporalGraph, parts: int, *tables: DataFrame) -> DataFrame:
    """All parts, with 0 where a table has no row for one."""
    out = domain(g, parts)
    for t in tables:
        out = out.join(t, "part", "left")
    return out.fillna(0)


def placed(g: TemporalGraph, place: DataFrame) -> DataFrame:
    """Edges with ps and pd."""
    p = place.select("v", "part")
    return g.edges.join(p.withColumnsRenamed({"v": "src", "part": "ps"}), "src").join(p.withColumnsRenamed({"v": "dst", "part": "pd"}), "dst")


def cross_matrix(g: TemporalGraph, place: DataFrame) -> DataFrame:
    return placed(g, place).groupBy("ps", "pd").agg(F.count("*").alias("cnt"))


def part_summary(g: TemporalGraph, place: DataFrame, parts: int) -> DataFrame:
    """part, nodes, edges: vertices, and edges with both ends there."""
    nodes = place.groupBy("part").agg(F.count("*").alias("nodes"))
    local = placed(g, place).where("ps = pd").groupBy(F.col("ps").alias("part")).agg(F.count("*").alias("edges"))
    return filled(g, parts, nodes, local)


def halo_rows(g: TemporalGraph, place: DataFrame) -> DataFrame:
    """part, b: each remote vertex that a part reads, once."""
    e = placed(g, place)
    return e.select(F.col("ps").alias("part"), F.col("dst").alias("b"), F.col("pd").alias("home")).unionAll(e.select(F.col("pd").alias("part"), F.col("src").alias("b"), F.col("ps").alias("home"))).where("part <> home").select("part", "b").distinct()


def edgecut(g: TemporalGraph, place: DataFrame, parts: int) -> DataFrame:
    """part, incident, halo, nodes, cut (the whole cut in every row)."""
    inc = degree(g).join(place, "v").groupBy("part").agg(F.sum("deg").alias("incident"), F.count("*").alias("nodes"))
    halo = halo_rows(g, place).groupBy("part").agg(F.count("*").alias("halo"))
    cut = placed(g, place).agg(F.count_if(F.col("ps") != F.col("pd")).alias("cut"))
    return filled(g, parts, inc, halo).join(F.broadcast(cut)).select("part", "incident", "halo", "nodes", "cut")


def landing(parts: int) -> Column:
    """Where an edge between two core vertices is gathered: a fixed rule of its position and direction."""
    return F.pmod(F.col("pos") * 2 + F.col("way"), F.lit(parts))


def vertexcut(g: TemporalGraph, place: DataFrame, core: DataFrame, parts: int) -> DataFrame:
    """part, incident, halo, nodes, cut with ``core`` (v) replicated on every part; core vertices have no home in ``place``."""
    home = place.join(core, "v", "left_anti").select("v", "part")
    a, b = home.withColumnsRenamed({"v": "a", "part": "pa"}), home.withColumnsRenamed({"v": "b", "part": "pb"})
    e = g.edges.select("pos", F.col("src").alias("a"), F.col("dst").alias("b"), F.lit(0).alias("way")).unionAll(g.edges.select("pos", F.col("dst").alias("a"), F.col("src").alias("b"), F.lit(1).alias("way")))
    e = e.join(a, "a", "left").join(b, "b", "left")
    inc = e.groupBy(F.coalesce("pa", "pb", landing(parts)).alias("part")).agg(F.count("*").alias("incident"))
    halo = e.where("pa <> pb").select(F.col("pa").alias("part"), "b").distinct().groupBy("part").agg(F.count("*").alias("rows"))
    cut = e.where("way = 0").agg(F.count_if(F.col("pa") != F.col("pb")).alias("cut"))
    nodes = home.groupBy("part").agg(F.count("*").alias("own"))
    size = core.agg(F.count("*").alias("core"))
    out = filled(g, parts, inc, halo, nodes).join(F.broadcast(cut)).join(F.broadcast(size))
    return out.select("part", "incident", (F.col("rows") + F.col("core") * (parts - 1) / parts).alias("halo"), (F.col("own") + F.col("core")).alias("nodes"), "cut")


def feature_bytes(g: TemporalGraph, place: DataFrame, parts: int) -> DataFrame:
    b = g.vertices().join(place, "v").groupBy("part").agg((F.sum("fv") * 4).alias("bytes"))
    return filled(g, parts, b)


def feature_work(g: TemporalGraph, place: DataFrame, parts: int) -> DataFrame:
    """part, inc_fw, comm_fw: as incident and halo, each row weighted by the width that it moves."""
    f = g.vertices()
    inc = both_ways(g.edges).join(place.withColumnRenamed("v", "a"), "a").join(f.withColumnsRenamed({"v": "b", "fv": "w"}), "b").groupBy("part").agg(F.sum("w").alias("inc_fw"))
    comm = halo_rows(g, place).join(f.withColumnRenamed("v", "b"), "b").groupBy("part").agg(F.sum("fv").alias("comm_fw"))
    return filled(g, parts, inc, comm)


def report(g: TemporalGraph, place: DataFrame, parts: int) -> DataFrame:
    """cut, balance_count, balance_featmem, peak_bytes, comm_bytes: every crossing edge charges its destination's row."""
    count = filled(g, parts, place.groupBy("part").agg(F.count("*").alias("c"))).agg((F.max("c") / F.avg("c")).alias("balance_count"))
    mem = feature_bytes(g, place, parts).agg((F.max("bytes") / F.avg("bytes")).alias("balance_featmem"), F.max("bytes").alias("peak_bytes"))
    cut = placed(g, place).where("ps <> pd").join(g.vertices().withColumnsRenamed({"v": "dst"}), "dst").agg(F.count("*").alias("cut"), (F.coalesce(F.sum("fv"), F.lit(0)) * 4).alias("comm_bytes"))
    return cut.join(count).join(mem).select("cut", F.round("balance_count", 6).alias("balance_count"), F.round("balance_featmem", 6).alias("balance_featmem"), "peak_bytes", "comm_bytes")


def edge_partition_report(g: TemporalGraph, edge_part: DataFrame, parts: int) -> DataFrame:
    """copies (distinct vertex and part), nodes, edge_balance of edges (src, dst, part); copies / nodes is the replication factor."""
    copies = both_ways(edge_part, "part").select("a", "part").distinct().agg(F.count("*").alias("copies"))
    load = filled(g, parts, edge_part.groupBy("part").agg(F.count("*").alias("c"))).agg(F.round(F.max("c") / F.avg("c"), 6).alias("edge_balance"))
    return copies.join(load).select("copies", F.lit(g.num_nodes).cast("long").alias("nodes"), "edge_balance")


def boundary(g: TemporalGraph, place: DataFrame, parts: int) -> DataFrame:
    """owner, k: pairs of a part's vertex and another part that reads it."""
    h = halo_rows(g, place).withColumnsRenamed({"part": "reader", "b": "v"}).join(place, "v").groupBy("part").agg(F.count("*").alias("k"))
    return filled(g, parts, h).withColumnRenamed("part", "owner")


def block_matrix(g: TemporalGraph, place: DataFrame) -> DataFrame:
    e = placed(g, place)
    return e.groupBy(F.least("ps", "pd").alias("bi"), F.greatest("ps", "pd").alias("bj")).agg(F.count("*").alias("w"))


def cut_vertices(g: TemporalGraph, place: DataFrame) -> DataFrame:
    return placed(g, place).where("ps <> pd").agg(F.count_distinct("dst").alias("cut_vertices"))


def intra_inter(g: TemporalGraph, place: DataFrame, ranks_per_node: int, parts: int) -> DataFrame:
    """rank, intra, inter: halo rows from ranks of the same machine and from others."""
    h = halo_rows(g, place).withColumnsRenamed({"part": "rank", "b": "v"}).join(place, "v").withColumn("same", F.expr(f"rank div {ranks_per_node} = part div {ranks_per_node}"))
    c = h.groupBy(F.col("rank").alias("part")).agg(F.count_if("same").alias("intra"), F.count_if(~F.col("same")).alias("inter"))
    return filled(g, parts, c).withColumnRenamed("part", "rank")
