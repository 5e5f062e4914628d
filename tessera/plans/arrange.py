"""Choose a placement: candidates, their prices, and the cheapest that is feasible."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scratch import kept
from ..operators import cost as C
from ..operators import greedy as K
from ..operators import iterate as I
from ..operators import metrics as M
from ..operators import placement as P
from ..operators import stats as S
from ..operators import supra as G
from ..sources.graphs import TemporalGraph

FLOOR = "locality floor"


@dataclass
class Arrangement:
    """The candidates' prices, the winner's name and its homes; core vertices are in ``core`` and have no home of their own."""

    candidates: DataFrame
    name: str
    place: DataFrame
    core: DataFrame | None


def shares(dev: list[tuple], column: int) -> list[int]:
    """Whole-number shares of a device column (a speed, or MB of memory)."""
    return [int(d[column] if d[column] < 1e6 else d[column] >> 20) for d in dev]


def edge_cuts(g: TemporalGraph, snaps: int, dev: list[tuple], rank: DataFrame | None = None) -> dict[str, DataFrame]:
    """Candidates in which every vertex has one home."""
    d = len(dev)
    return {
        "edge-cut(hetero)": P.by_locality(g, d, rank, shares(dev, 7)),
        "edge-cut(feat-aware)": P.by_feature_bytes(g, shares(dev, 3)),
        "spatial(PSS)": P.by_locality(g, d, rank),
        "temporal(PTS)": P.by_first_activity(g, snaps, d),
    }


def priced(g: TemporalGraph, name: str, place: DataFrame, dev: DataFrame, d: int, link: float, core: DataFrame | None = None) -> DataFrame:
    """cand, cut, makespan_ms, imbalance, feasible in one row."""
    if core is None:
        m, work, mem = M.edgecut(g, place, d), M.feature_work(g, place, d), M.feature_bytes(g, place, d)
    else:
        m = M.vertexcut(g, place, core, d)
        mean = g.vertices().agg(F.avg("fv").alias("f"))
        work = m.join(F.broadcast(mean)).select("part", (F.col("incident") * F.col("f")).alias("inc_fw"), (F.col("halo") * F.col("f")).alias("comm_fw"))
        extra = g.vertices().join(core, "v").agg(F.coalesce(F.sum("fv") * 4, F.lit(0)).alias("x"))
        mem = M.feature_bytes(g, place, d).join(F.broadcast(extra)).select("part", (F.col("bytes") + F.col("x")).alias("bytes"))
    ms = C.predict_ms(work, dev, link).withColumnRenamed("device", "part")
    row = m.join(ms, "part").join(mem, "part").join(F.broadcast(dev.select(F.col("id").alias("part"), "usable_mem")), "part")
    return row.agg(
        F.max("cut").alias("cut"), F.max("total_ms").alias("makespan_ms"), F.round(F.max("incident") / F.avg("incident"), 6).alias("imbalance"),
        F.min(C.feasible(F.col("bytes"), F.col("incident"), F.col("usable_mem"))).alias("feasible"),
    ).select(F.lit(name).alias("cand"), "*")


def candidates(g: TemporalGraph, snaps: int, dev: list[tuple], link: float) -> DataFrame:
    """Prices of the edge cuts, in one query."""
    table = g.spark.createDataFrame(dev, C.DEVICE)
    rows = [priced(g, name, p, table, len(dev), link) for name, p in edge_cuts(g, snaps, dev).items()]
    return reduce(DataFrame.unionByName, rows)


def pick(prices: DataFrame, parts: int) -> DataFrame:
    """The one row of least makespan among feasible, balanced candidates (a floor needs no balance); the best balanced one if there is none."""
    ok = F.col("feasible") & ((F.col("imbalance") <= 0.5 * parts + 0.5) | F.col("cand").contains("floor"))
    order = [F.when(ok, 0).otherwise(1), F.when(ok, F.col("makespan_ms")).otherwise(F.col("imbalance")), "cand"]
    return prices.orderBy(*order).limit(1)


def arrange(g: TemporalGraph, snaps: int, dev: list[tuple], link: float, quantiles: tuple[float, ...] = (0.5, 0.9, 0.97), rounds: int = 3) -> Arrangement:
    """All candidates: edge cuts along label-propagation order, vertex cuts over coreness quantiles, and a multilevel floor."""
    d = len(dev)
    rank = kept(I.label_rank(I.label_propagation(g, rounds)), "rank")
    places: dict[str, tuple[DataFrame, DataFrame | None]] = {k: (kept(p.select("v", "part"), "cand"), None) for k, p in edge_cuts(g, snaps, dev, rank).items()}
    core_of = kept(I.coreness(g), "core")
    limits = core_of.agg(*[F.percentile("core", q).alias(f"q{i}") for i, q in enumerate(quantiles)]).first()
    for q in sorted({max(2, int(x or 0)) for x in limits}):
        core = kept(core_of.where(F.col("core") >= q).select("v"), "cores")
        if 0 < core.count() < g.num_nodes:
            places[f"vertex-cut({q}-core)"] = (kept(P.periphery(g, core, d, rank).select("v", "part"), "cand"), core)
    places[FLOOR] = (kept(K.multilevel(g, d), "cand"), None)
    table = g.spark.createDataFrame(dev, C.DEVICE)
    prices = kept(reduce(DataFrame.unionByName, [priced(g, n, p, table, d, link, c) for n, (p, c) in places.items()]), "prices")
    best = pick(prices, d).first()["cand"]
    return Arrangement(prices, best, *places[best])


def plan(g: TemporalGraph, snaps: int, cluster: str, link: float, feat_dim: int = 128) -> DataFrame:
    """One row per device: winner, nodes, incident, halo, total_ms, footprint, headroom."""
    dev = C.cluster_rows(cluster)
    table, a = g.spark.createDataFrame(dev, C.DEVICE), arrange(g, snaps, dev, link)
    d = len(dev)
    m = M.edgecut(g, a.place, d) if a.core is None else M.vertexcut(g, a.place, a.core, d)
    work = m.select("part", (F.col("incident") * feat_dim).alias("inc_fw"), (F.col("halo") * feat_dim).alias("comm_fw"))
    ms = C.predict_ms(work, table, link).withColumnRenamed("device", "part")
    flight = C.preflight(m.select("part", "nodes", F.col("incident").alias("edges"), F.col("halo").cast("long").alias("halo")), table, feat_dim).withColumnRenamed("device", "part")
    return m.join(ms, "part").join(flight, "part").select(F.lit(a.name).alias("winner"), "part", "nodes", "incident", F.col("halo").cast("double").alias("halo"), "total_ms", "footprint", "headroom")


def allocate(g: TemporalGraph, snaps: int, dev: list[tuple], link: float, w_space: int = 2, w_time: int = 1) -> DataFrame:
    """part, cells, vertices, bytes, cost, from_supra: the cells' devices by the supra solver or by the arrangement, whichever has the lesser weighted cut.

    Vertices that an arrangement holds everywhere count at a device by their id.
    """
    d, cell = len(dev), kept(G.cells(g, snaps), "cells")
    sp, tp = kept(G.spatial_pairs(g, cell, snaps), "spatial"), kept(G.temporal_pairs(cell), "temporal")
    a = arrange(g, snaps, dev, link)
    lifted = kept(cell.join(a.place.select("v", "part"), "v", "left").select("cell_id", F.coalesce("part", F.col("v") % d).cast("long").alias("dev")), "lifted")
    solved = kept(K.supra_solve(g, snaps, d, w_space, w_time).select("cell_id", "dev"), "solved")
    price = lambda p: (lambda r: w_space * r["spatial"] + w_time * r["temporal"])(G.cuts(sp, tp, p).first())
    costs = {True: price(solved), False: price(lifted)}
    supra = costs[True] <= costs[False]
    c = cell.join(solved if supra else lifted, "cell_id")
    count = c.groupBy(F.col("dev").alias("part")).agg(F.count("*").alias("cells"))
    rows = c.select("dev", "v").distinct().join(g.vertices(), "v").groupBy(F.col("dev").alias("part")).agg(F.count("*").alias("vertices"), (F.sum("fv") * 4).alias("bytes"))
    return M.filled(g, d, count, rows).select("part", "cells", "vertices", "bytes", F.lit(costs[supra]).cast("long").alias("cost"), F.lit(supra).alias("from_supra"))


def schedule(g: TemporalGraph, snaps: int, cluster: str, link: float, feat_dim: int = 128, epochs: int = 10) -> DataFrame:
    """One row: axis, winner, makespan_ms, weights of cuts, feasible, and the estimate of a job of some epochs."""
    dev = C.cluster_rows(cluster)
    table = g.spark.createDataFrame(dev, C.DEVICE)
    axis = C.decide_axis(g.num_nodes, g.num_edges, dev, feat_dim, link)
    weights = C.calibrate(table, S.persistence(g, snaps), link, feat_dim)
    best = pick(arrange(g, snaps, dev, link).candidates, len(dev))
    return best.join(F.broadcast(weights)).select(F.lit(axis["axis"]).alias("axis"), F.col("cand").alias("winner"), "makespan_ms", "feasible", "w_s_ns", "w_t_ns", F.round(F.col("makespan_ms") * epochs, 6).alias("job_ms"))
