"""Placements of vertices that are relational: arithmetic, ranges, order and split, hubs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.position import with_position
from ..functions.scratch import kept
from ..sources.graphs import TemporalGraph
from .stats import degree
from .supra import active


def by_hash(g: TemporalGraph, parts: int) -> DataFrame:
    return g.vertices().select("v", (F.col("v") % parts).alias("part"))


def by_random(g: TemporalGraph, parts: int, seed: int = 0) -> DataFrame:
    return g.vertices().select("v", F.pmod(F.xxhash64("v", F.lit(seed)), F.lit(parts)).alias("part"))


def by_capacity(g: TemporalGraph, shares: list[int]) -> DataFrame:
    """Ranges of ids in proportion to whole-number shares: ends at floor(N * running share / total), the tail to the last."""
    total, run, ends = sum(shares), 0, []
    for s in shares[:-1]:
        run += s
        ends.append(g.num_nodes * run // total)
    part = F.lit(0)
    for e in ends:
        part = part + (F.col("v") >= e).cast("int")
    return g.vertices().select("v", part.cast("long").alias("part"))


def split(work: DataFrame, order: list, parts: int, shares: list[int] | None = None) -> DataFrame:
    """v, part, work: rows (v, work) in ``order``, cut into runs of equal work, or of work in proportion to whole ``shares``.

    Cut k is at the first row whose running work reaches k / D of the total (the first k shares of it), and
    that row begins the next run; without any work, runs of equal length. The
    running sum is taken within ranges and their starts are added, so no task
    has all rows.
    """
    p = kept(with_position(work, order, "r"), "order")
    total = p.agg(F.sum("work").alias("w"), F.count("*").alias("n")).first()
    if not total["w"]:
        return p.select("v", F.expr(f"r * {parts} div {max(total['n'], 1)}").alias("part"), "work")
    blocks = max(1, min(int(p.sparkSession.conf.get("spark.sql.shuffle.partitions")), total["n"]))
    p = p.withColumn("blk", F.expr(f"r * {blocks} div {total['n']}"))
    sums = p.groupBy("blk").agg(F.sum("work").alias("s"))
    start = sums.select("blk", (F.sum("s").over(Window.orderBy("blk").rowsBetween(Window.unboundedPreceding, 0)) - F.col("s")).alias("base"))
    run = p.join(F.broadcast(start), "blk").withColumn("prefix", F.col("base") + F.sum("work").over(Window.partitionBy("blk").orderBy("r").rowsBetween(Window.unboundedPreceding, 0)))
    run = kept(run.select("v", "r", "work", "prefix"), "prefix")
    shares = shares or [1] * parts
    short = [F.count_if(F.col("prefix") * sum(shares) < sum(shares[:k]) * total["w"]).alias(f"c{k}") for k in range(1, parts)]
    cuts = run.agg(*short).first() if short else []
    part = F.lit(0)
    for c in cuts:
        part = part + (F.col("r") >= c).cast("int")
    return run.select("v", part.cast("long").alias("part"), "work")


def by_locality(g: TemporalGraph, parts: int, rank: DataFrame | None = None, shares: list[int] | None = None) -> DataFrame:
    """Runs of equal incident work in the order of ``rank`` (v, rank); by degree, the highest first, without one."""
    work = degree(g).withColumnRenamed("deg", "work")
    if rank is None:
        return split(work, [F.desc("work"), F.asc("v")], parts, shares)
    return split(work.join(rank, "v"), ["rank", "v"], parts, shares).select("v", "part", "work")


def by_feature_bytes(g: TemporalGraph, shares: list[int]) -> DataFrame:
    """The order of degrees cut so that parts get feature widths in proportion to their memory."""
    work = degree(g).join(g.vertices(), "v").select("v", "deg", F.col("fv").alias("work"))
    return split(work, [F.desc("deg"), F.asc("v")], len(shares), shares)


def by_first_activity(g: TemporalGraph, snaps: int, parts: int) -> DataFrame:
    first = active(g, snaps).groupBy("v").agg(F.min("snap").alias("first"))
    work = degree(g).withColumnRenamed("deg", "work").join(first, "v", "left").fillna(snaps + 1, ["first"])
    return split(work, ["first", "v"], parts)


def periphery(g: TemporalGraph, core: DataFrame, parts: int, rank: DataFrame | None = None) -> DataFrame:
    """Homes of all vertices but the core's, in runs of equal work."""
    work = degree(g).withColumnRenamed("deg", "work").join(core, "v", "left_anti")
    return split(work, [F.desc("work"), F.asc("v")], parts) if rank is None else split(work.join(rank, "v"), ["rank", "v"], parts)


def hubs(g: TemporalGraph, percent: int) -> DataFrame:
    """v, deg of the ``percent`` % of highest degree, with all that tie with the last of them."""
    k = max(1, g.num_nodes * percent // 100)
    deg = degree(g)
    # The degree of the last of them by the counts of degrees, one row each.
    run = F.sum("c").over(Window.orderBy(F.desc("deg")).rowsBetween(Window.unboundedPreceding, 0))
    last = deg.groupBy("deg").agg(F.count("*").alias("c")).withColumn("run", run).where(F.col("run") >= k).agg(F.max("deg").alias("least"))
    return deg.join(F.broadcast(last), F.col("deg") >= F.col("least")).select("v", "deg")
