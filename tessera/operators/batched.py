"""Streams of vertices placed batch by batch, at any size: no decision waits for the one before it, only for the batch before.

A batch's vertices are scored against all devices by one join with the
neighbours that are placed, and ask for the best device that has room. A device
takes those that have most to lose elsewhere, as far as its room goes, decided
on sums for each device, step of that loss and bucket of a hash; the others ask
again, of what has room then. The driver sees these sums, not the vertices.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.position import with_position
from ..functions.scratch import kept
from ..sources.graphs import TemporalGraph
from .metrics import placed
from .stats import degree
from .supra import both_ways

BUCKETS = 64


def fitted_caps(caps: list[int], n: int) -> list[int]:
    """Vertices that each device may have: ``caps``, or where they don't hold all n, n cut at the same shares as the sum of ``caps`` is."""
    total, ends = sum(caps), np.cumsum([0, *caps])
    if total >= n:
        return [min(int(c), n) for c in caps]
    return np.diff(ends * n // max(total, 1)).tolist()


def link_costs(link: list[list[float]]) -> list[list[float]]:
    """What an edge costs between two devices: nothing on one, else what a row takes at the link's bandwidth."""
    return [[0.0 if i == j or not np.isfinite(x) or x <= 0 else 1 / x for j, x in enumerate(row)] for i, row in enumerate(link)]


def _priced(g: TemporalGraph, near: DataFrame, who: DataFrame, place: DataFrame, cost: list[list[float]]) -> DataFrame:
    """v, costs: of each vertex of ``who`` (v), what its edges to placed neighbours cost from each device, in an array."""
    spark, d = g.spark, len(cost)
    table = F.broadcast(spark.createDataFrame([(p, [float(row[p]) for row in cost]) for p in range(d)], "part long, each array<double>"))  # a row a device
    votes = near.join(who.select(F.col("v").alias("a")), "a", "left_semi").join(place.select(F.col("v").alias("b"), "part"), "b").groupBy("a", "part").agg(F.sum("w").alias("s"))
    votes = votes.join(table, "part").groupBy(F.col("a").alias("v")).agg(*[F.sum(F.col("s") * F.col("each")[k]).alias(f"c{k}") for k in range(d)])
    return who.select("v").join(votes, "v", "left").select("v", F.array(*[F.coalesce(f"c{k}", F.lit(0.0)) for k in range(d)]).alias("costs"))


def _asked(priced: DataFrame, extra: np.ndarray) -> DataFrame:
    """v, costs, part (the cheapest device of those whose ``extra`` isn't infinite), level (the step of what the next one would cost more), bucket."""
    every = F.array(*[F.struct((F.col("costs")[k] + float(x)).alias("c"), F.lit(k).cast("long").alias("p")) for k, x in enumerate(extra) if np.isfinite(x)])
    order = F.array_sort(every)
    loss = F.coalesce(F.get(order, F.lit(1))["c"], F.lit(1e9)) - order[0]["c"]
    level = F.round(4 * F.log2(F.lit(1.0) + loss * 1000)).cast("int")
    return priced.select("v", "costs", order[0]["p"].alias("part"), level.alias("level"), F.pmod(F.xxhash64("v"), F.lit(BUCKETS)).cast("int").alias("bucket"))


def _taken(asked: DataFrame, room: np.ndarray) -> tuple[DataFrame, np.ndarray]:
    """The cells (part, level, bucket) of ``asked`` that devices have room for, those with most to lose first, and how many that is a device.

    A cell that doesn't fit as a whole waits; where none of a device's does, its first one is cut by hashes of its own.
    """
    sums = asked.groupBy("part", "level", "bucket").agg(F.count("*").alias("n")).toPandas().sort_values(["level", "bucket"], ascending=[False, True], kind="stable")
    cells, got = [], np.zeros(len(room), np.int64)
    for p, own in sums.groupby("part"):
        run = own["n"].to_numpy().cumsum()
        fit = int(np.searchsorted(run, room[p], side="right"))
        cells += [(int(p), int(x), int(b)) for x, b in zip(own["level"][:fit], own["bucket"][:fit], strict=True)]
        got[p] = run[fit - 1] if fit else 0
    return asked.sparkSession.createDataFrame(cells or [(-1, 0, 0)], "part long, level int, bucket int"), got


def _placed_batch(g: TemporalGraph, near: DataFrame, batch: DataFrame, done: DataFrame, cost: list[list[float]], alpha: float, cap: np.ndarray, load: np.ndarray) -> DataFrame:
    """v, part of a batch; ``load`` is brought up to date."""
    todo, out = kept(_priced(g, near, batch, done, cost), "priced"), None
    while True:
        room = cap - load
        extra = np.where(room > 0, alpha * load / np.maximum(cap, 1), np.inf)
        if not np.isfinite(extra).any():
            raise ValueError("more vertices than the devices hold")
        asked = kept(_asked(todo, extra), "asked")
        cells, got = _taken(asked, room)
        if not got.any():
            # Less room than any cell has vertices: what is left takes it one by one, in the order of loss.
            few = with_position(asked.select("v", "part", "level"), ["part", F.desc("level"), "v"], "r")
            base = few.groupBy("part").agg(F.min("r").alias("base"))
            limit = g.spark.createDataFrame([(p, int(x)) for p, x in enumerate(room)], "part long, room long")
            new = kept(few.join(F.broadcast(base), "part").join(F.broadcast(limit), "part").where(F.col("r") - F.col("base") < F.col("room")).select("v", "part"), "taken")
            got = np.zeros(len(cap), np.int64)
            for r in new.groupBy("part").count().collect():
                got[r["part"]] = r["count"]
        else:
            new = asked.join(F.broadcast(cells), ["part", "level", "bucket"], "left_semi").select("v", "part")
        load += got
        out = new if out is None else out.unionAll(new)
        todo = kept(todo.join(new.select("v"), "v", "left_anti"), "priced")
        if todo.limit(1).count() == 0:
            return out


def heterogeneous(g: TemporalGraph, caps: list[int], link: list[list[float]], alpha: float = 1.0, passes: int = 2, order: str = "auto", prior: DataFrame | None = None, budget: float = 0.0, batches: int = 8) -> DataFrame:
    """v, part: vertices in ``batches``, each to the device from which its placed neighbours are cheapest to reach, plus ``alpha`` times how full it is.

    ``caps`` are the devices' vertices, ``link`` the bandwidths between them (infinite or 0 on the diagonal: free).
    Vertices come by first appearance if one device can hold all, else by degree, unless ``order`` names one; then
    ``passes`` of moves that lessen the cost. With ``prior`` (v, part) only vertices without a part are placed, and
    those, their neighbours and about the share ``budget`` of all with the most crossing edges may move.
    """
    n, cost = g.num_nodes, link_costs(link)
    cap, load = np.array(fitted_caps(caps, n)), np.zeros(len(caps), np.int64)
    near = kept(both_ways(g.edges).where("a <> b").groupBy("a", "b").agg(F.count("*").alias("w")), "near")
    new = g.vertices().select("v")
    done = g.spark.createDataFrame([], "v long, part long")
    if prior is not None:
        done = kept(prior.select("v", F.col("part").cast("long").alias("part")), "prior")
        new = new.join(done, "v", "left_anti")
        for r in done.groupBy("part").count().collect():
            load[r["part"]] = r["count"]
    if order == "degree" or order == "auto" and cap.max() < n:
        turn, by = degree(g).select("v", F.col("deg").alias("key")), [F.desc("key"), F.asc("v")]
    else:
        first = both_ways(g.edges, "pos").groupBy(F.col("a").alias("v")).agg(F.min("pos").alias("key"))
        turn, by = g.vertices().select("v").join(first, "v", "left").fillna(g.num_edges, ["key"]), [F.asc("key"), F.asc("v")]
    new = kept(with_position(turn.join(new, "v", "left_semi"), by, "r"), "turns")
    count = new.count()
    for k in range(batches if count else 0):
        batch = new.where(F.expr(f"r * {batches} div {count}") == k).select("v")
        if batch.limit(1).count():
            done = kept(done.unionAll(_placed_batch(g, near, batch, done, cost, alpha, cap, load)), "placed")
    free = g.vertices().select("v") if prior is None else _free(g, near, new, done, budget)
    free = kept(free, "free")
    for k in range(passes):
        done, moved = _moved(g, near, free, done, cost, cap, load, k)
        if not moved:
            break
    return done


def _free(g: TemporalGraph, near: DataFrame, new: DataFrame, done: DataFrame, budget: float) -> DataFrame:
    """v: new vertices, their neighbours, and those with the most crossing edges, as many as the budget holds without splitting a tie."""
    around = near.join(new.select(F.col("v").alias("a")), "a", "left_semi").select(F.col("b").alias("v"))
    own = new.select("v").unionAll(around).distinct()
    room = int(budget * g.num_nodes)
    if not room:
        return own
    cross = kept(placed(g, done).where("ps <> pd").select(F.explode(F.array("src", "dst")).alias("v")).join(own, "v", "left_anti").groupBy("v").agg(F.count("*").alias("c")), "crossing")
    held, least = 0, None
    for r in cross.groupBy("c").agg(F.count("*").alias("n")).orderBy(F.desc("c")).toLocalIterator():  # a row a count
        held += r["n"]
        if held > room:
            break
        least = r["c"]
    return own if least is None else own.unionAll(cross.where(F.col("c") >= least).select("v"))


def _moved(g: TemporalGraph, near: DataFrame, free: DataFrame, done: DataFrame, cost: list[list[float]], cap: np.ndarray, load: np.ndarray, k: int) -> tuple[DataFrame, bool]:
    """The placement after moves of half of the free vertices, by a hash, to devices that are cheaper and have room."""
    half = free.where(F.pmod(F.xxhash64("v", F.lit(k)), F.lit(2)) == k % 2)
    p = _priced(g, near, half, done, cost).join(done.withColumnRenamed("part", "own"), "v")
    room = cap - load
    asked = _asked(p.select("v", "costs", "own"), np.where(room > 0, 0.0, np.inf)) if (room > 0).any() else None
    if asked is None:
        return done, False
    asked = kept(asked.join(done.withColumnRenamed("part", "own"), "v").where(F.element_at("costs", (F.col("part") + 1).cast("int")) < F.element_at("costs", (F.col("own") + 1).cast("int")) - 1e-9), "asked")
    cells, got = _taken(asked, room)
    if not got.any():
        return done, False
    moves = kept(asked.join(F.broadcast(cells), ["part", "level", "bucket"], "left_semi").select("v", F.col("part").alias("to"), "own"), "moves")
    for r in moves.groupBy("own").count().collect():
        load[r["own"]] -= r["count"]
    load += got
    return kept(done.join(moves.select("v", "to"), "v", "left").select("v", F.coalesce("to", "part").alias("part")), "placed"), True
