"""Decisions over small tables of prices: axis, number of parts, replicas, budgets, intents."""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.position import with_position
from ..sources.graphs import TemporalGraph
from . import cost as C
from . import memory as R
from .metrics import halo_rows
from .stats import degree

#: The gates that the axis rule may take when it is fitted, with the design's own in the middle.
DENSE, LOCAL, BURST = (10.0, 15.0, 20.0, 25.0, 30.0, 40.0, 50.0), (0.3, 0.4, 0.5, 0.6, 0.7), (0.5, 0.75, 1.0, 1.25, 1.5)
DESIGN = (25.0, 0.5, 1.0)


def barrier_ms(k: Column, alpha: float, beta: float) -> Column:
    """Time of a barrier among k parts: one hop for each doubling."""
    return alpha * F.ceil(F.log2(F.greatest(F.lit(2), k))) + beta


def best_k(jobs: DataFrame, alpha: float, beta: float) -> DataFrame:
    """``jobs`` (n, e, feat, cap, link, bw) with k_mem, the least number of parts that hold it; k_bal, where more parts stop paying; k_star and its barrier."""
    k_mem = F.greatest(F.lit(1), F.ceil((F.col("n") * F.col("feat") * 4.0 + F.col("e") * C.RESIDENT_EDGE) / F.greatest(F.col("cap"), F.lit(1))))
    move = lambda speed: C.GATHERS * C.TRAVERSAL * F.col("feat") * F.col("e") / (speed * 1e9) * 1e3
    k_bal = F.greatest(F.lit(1.0), F.greatest(move(F.col("bw")), move(F.col("link"))) * math.log(2) / max(1e-9, alpha))
    out = jobs.withColumn("k_mem", k_mem.cast("long")).withColumn("k_bal", k_bal)
    out = out.withColumn("k_star", F.bround(F.greatest(F.col("k_mem").cast("double"), F.col("k_bal"))).cast("long"))
    return out.withColumn("barrier_ms", F.round(barrier_ms(F.col("k_star"), alpha, beta), 9)).withColumn("k_bal", F.round("k_bal", 6))


def crossover_phi(comp: Column, comm: Column) -> Column:
    """The overlap from which communication is hidden; null without computation."""
    return F.when(comp > 0, comm / comp)


def boundary_vertices(g: TemporalGraph, place: DataFrame) -> DataFrame:
    """v, deg, readers: vertices that other parts read, and how many do."""
    return halo_rows(g, place).groupBy(F.col("b").alias("v")).agg(F.count("*").alias("readers")).join(degree(g), "v").select("v", "deg", "readers")


def replica_table(g: TemporalGraph, place: DataFrame, width: int, percents: Iterable[float] = (0.5, 1, 2, 5, 10, 25, 50, 100)) -> DataFrame:
    """pct, vertices, rows, bytes: copies of the ``pct`` % of boundary vertices of highest degree, and the bytes that they hold and save a step."""
    b = with_position(boundary_vertices(g, place), [F.desc("deg"), F.asc("v")], "r")
    total = b.agg(F.count("*").alias("b"))
    take = g.spark.createDataFrame([(float(p),) for p in percents], "pct double").join(F.broadcast(total)).where("b > 0")
    take = take.withColumn("vertices", F.least(F.greatest(F.lit(1), F.bround(F.col("b") * F.col("pct") / 100)), "b").cast("long"))
    s = b.join(F.broadcast(take), F.col("r") < F.col("vertices")).groupBy("pct", "vertices").agg(F.sum("readers").alias("rows"))
    return s.select("pct", "vertices", "rows", (F.col("rows") * width * 4).alias("bytes"))


def recompute_table(g: TemporalGraph, place: DataFrame, width: int, links: dict[str, float], flops: float = 1.5e13, bw: float = 1.5e12) -> DataFrame:
    """link, gbps, comm_ms, recompute_ms, recompute, even_gbps: for the boundary vertices, sending their rows against one hop computed anew."""
    s = boundary_vertices(g, place).agg(F.count("*").alias("b"), F.avg("deg").alias("d"))
    nnz = F.col("b") * F.greatest(F.lit(1.0), F.col("d"))
    moved = (nnz + F.col("b")) * width * 4 + width * width * 4
    again = F.greatest(moved / bw, (2.0 * nnz * width + 2.0 * F.col("b") * width * width) / flops)
    s = s.select((F.col("b") * width * 4).alias("bytes"), again.alias("again"))
    j = g.spark.createDataFrame(list(links.items()), "link string, gbps double").join(F.broadcast(s))
    comm = F.col("bytes") / (F.col("gbps") * 1e9)
    return j.select("link", "gbps", F.round(comm * 1e3, 9).alias("comm_ms"), F.round(F.col("again") * 1e3, 9).alias("recompute_ms"), (F.col("again") < comm).alias("recompute"), F.round(F.col("bytes") / (F.col("again") * 1e9), 6).alias("even_gbps"))


def predicted_axis(parts: int = 8) -> Column:
    """The axis by rule from n, e, feat, local, burst, hbm (bytes), link, bw and the gates dense_gate, local_gate, burst_gate."""
    c = F.col
    node = c("n") / parts * c("feat") * 4.0 + 2.0 * c("e") / parts * C.RESIDENT_EDGE
    column = c("feat") / parts * c("n") * 4.0 + c("e") * C.RESIDENT_EDGE
    comp, edge = C.compute_ms(2.0 * c("e") / parts, c("bw")), c("n") / parts * c("feat") * C.FEATURE * C.GATHERS / (c("link") * 1e9) * 1e3
    relief = (node > c("hbm")) & (column <= c("hbm"))
    binds = (edge > comp) & (2.0 * c("e") / F.greatest(F.lit(1), c("n")) >= c("dense_gate"))
    return F.when(relief | binds, "ATTRIBUTE").when((c("local") > c("local_gate")) & (c("burst") > c("burst_gate")), "TIME").otherwise("STRUCTURE")


def gates(spark: SparkSession) -> DataFrame:
    """dense_gate, local_gate, burst_gate and far, how far they are from the design's."""
    rows = [(d, t, b, abs(d - DESIGN[0]) + abs(t - DESIGN[1]) + abs(b - DESIGN[2])) for d in DENSE for t in LOCAL for b in BURST]
    return spark.createDataFrame(rows, "dense_gate double, local_gate double, burst_gate double, far double")


def scorecard(stats: DataFrame, parts: int = 8) -> DataFrame:
    """name, family, predicted, held_out: by the design's gates, and by those fitted on all other rows (most hits, then nearest the design, then least).

    ``stats`` has one row a graph, and there are 175 sets of gates: small tables.
    """
    spark, g = stats.sparkSession, gates(stats.sparkSession)
    every = stats.join(F.broadcast(g)).select("name", "family", "dense_gate", "local_gate", "burst_gate", "far", predicted_axis(parts).alias("p")).withColumn("hit", (F.col("p") == F.col("family")).cast("long"))
    total = every.groupBy("dense_gate", "local_gate", "burst_gate").agg(F.sum("hit").alias("all_hits"))
    others = every.join(total, ["dense_gate", "local_gate", "burst_gate"]).withColumn("hits", F.col("all_hits") - F.col("hit"))
    rank = F.row_number().over(Window.partitionBy("name").orderBy(F.desc("hits"), "far", "dense_gate", "local_gate", "burst_gate"))
    held = others.withColumn("r", rank).where("r = 1").select("name", F.col("p").alias("held_out"))
    design = spark.createDataFrame([DESIGN], "dense_gate double, local_gate double, burst_gate double")
    return stats.join(F.broadcast(design)).select("name", "family", predicted_axis(parts).alias("predicted")).join(held, "name")


def budgets(plans: DataFrame, dev: DataFrame) -> DataFrame:
    """Per row of a memory plan: units and bytes that stay and that are streamed, capacity, and whether it fits."""
    d = plans.join(F.broadcast(dev.select(F.col("id").alias("device"), "h2d_gbps", F.col("usable_mem").alias("capacity"))), "device")
    return d.select("w", "device", "resident", "streamed", F.col("peak").alias("resident_bytes"), F.bround(F.col("staging_sec") * F.col("h2d_gbps") * 1e9).cast("long").alias("streamed_bytes"), "capacity", (F.col("feasible") & (F.col("peak") <= F.col("capacity"))).alias("fits"))


def pool_plan(plans: DataFrame, windows: DataFrame, snaps: int, stride: int, epochs: int, policy: str = "belady") -> DataFrame:
    """w, device, unit_bytes, slots, hits, misses, staged_bytes, pinned_misses: a cache of a plan's peak for the windows over ``snaps`` snapshots.

    ``windows`` (w, window) has the snapshots that are held together; rows of plans without room are left out.
    """
    spark = plans.sparkSession
    p = plans.join(F.broadcast(windows), "w").where("peak > 0 AND feasible")
    p = p.withColumn("unit_bytes", F.greatest(F.lit(1), F.expr("peak div greatest(1, window)"))).withColumn("slots", F.greatest(F.lit(1), F.expr("peak div unit_bytes")))
    p = p.withColumn("cache", F.row_number().over(Window.orderBy("w", "device")).cast("long")).select("cache", "w", "device", "window", "unit_bytes", "slots")
    out = None
    for (size,) in p.select("window").distinct().orderBy("window").collect():
        own = p.where(F.col("window") == size)
        seq = R.next_use(R.access_sequence(spark, snaps, int(size), stride, epochs))
        m = R.cache_misses(seq.join(F.broadcast(own.select("cache", "slots"))), policy, "cache").select("cache", "hits", "misses")
        r = F.row_number().over(Window.partitionBy("cache").orderBy("f"))
        first = seq.groupBy("unit").agg(F.min("pos").alias("f"), F.count("*").alias("c")).join(F.broadcast(own.select("cache", "slots"))).withColumn("r", r)
        naive = first.groupBy("cache").agg(F.sum(F.when(F.col("r") <= F.col("slots"), 1).otherwise(F.col("c"))).alias("pinned_misses"))
        one = own.join(m, "cache").join(naive, "cache")
        out = one if out is None else out.unionByName(one)
    return out.select("w", "device", "unit_bytes", "slots", "hits", "misses", (F.col("misses") * F.col("unit_bytes")).alias("staged_bytes"), "pinned_misses")


def axis_prices(best: DataFrame, n: int, e: int, feat: int, dev: list[tuple], link: float, layers: int = 2) -> DataFrame:
    """axis, ms, fits: the best structural candidate (cand, makespan_ms, feasible), a split by feature columns, and a grid of about sqrt D by sqrt D."""
    d, bw, least = len(dev), sum(x[7] for x in dev) / len(dev), min(x[3] for x in dev)
    k = max(1, round(d**0.5))
    join = lambda f: layers * n * f * C.FEATURE / (link * 1e9) * 1e3
    gather = lambda f, p: layers * 2 * (e / p) * f * C.TRAVERSAL / (bw * 1e9) * 1e3
    feature = gather(feat, d) + 2 * join(feat)
    # The grid's boundary is that of half the vertices: the rule takes a vertex for each edge end.
    edge = layers * n / 2 * (k - 1) / k * feat * C.FEATURE / (link * 1e9) * 1e3
    grid = max(gather(feat, k) + edge, gather(feat // k, k) + join(feat // k)) + join(feat // k)
    rows = [("feature", feature, feat / d * n * 4.0 + e * C.RESIDENT_EDGE <= least), ("hybrid", grid, feat / k * (n / k) * 4.0 + e * C.RESIDENT_EDGE <= least)]
    own = best.select(F.when(F.col("cand").startswith("temporal"), "time").otherwise("structure").alias("axis"), F.col("makespan_ms").alias("ms"), F.col("feasible").alias("fits"))
    return own.unionAll(best.sparkSession.createDataFrame(rows, "axis string, ms double, fits boolean")).withColumn("ms", F.round("ms", 6))


def choose_axis(prices: DataFrame) -> DataFrame:
    """The cheapest axis that fits; the cheapest of all if none does."""
    return prices.orderBy(F.desc("fits"), "ms", "axis").limit(1)


def resolved(flights: DataFrame, intent: str = "min_time") -> DataFrame:
    """cand, makespan_sec, headroom, feasible of the candidate that an intent takes, from preflight rows (cand, device, headroom, oom, compute_sec).

    ``fit_memory`` wants the greatest least headroom, any other intent the least makespan; infeasible ones only if there is no other.
    """
    s = flights.groupBy("cand").agg(F.max("compute_sec").alias("makespan_sec"), F.min("headroom").alias("headroom"), (~F.max("oom")).alias("feasible"))
    order = F.desc("headroom") if intent == "fit_memory" else F.asc("makespan_sec")
    return s.orderBy(F.desc("feasible"), order, "cand").limit(1)
