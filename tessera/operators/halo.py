"""Refinement of a placement by what parts must read from each other.

The incidence table (v, part, n) says how many edges a vertex has into each
part. A vertex is in the halo of each part but its own that it has edges into,
so the halo volume is a count of its rows. What a move of v from p to q saves
follows from the rows of v and of its neighbours: a neighbour that v alone tied
to p leaves that halo, one that had nothing in q joins that one. A round's
moves change the table by their own edges only: these deltas are added to it,
and a round that doesn't lessen the objective is taken back and tried with
fewer moves at once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scratch import dropped, kept, sized
from ..sources.graphs import TemporalGraph
from .multilevel import BUCKETS, both, simple

#: What a halo row costs against an edge end, in the work of a part.
ALPHA = 128


def incidence(sym: DataFrame, place: DataFrame) -> DataFrame:
    """v, part, n: edges of each vertex into each part it has any into."""
    return sym.join(place.select(F.col("v").alias("b"), "part"), "b").groupBy(F.col("a").alias("v"), "part").agg(F.sum("w").alias("n"))


def part_costs(inc: DataFrame, place: DataFrame) -> dict[int, tuple[int, int, int]]:
    """Of each part: vertices, edge ends, and rows it reads from others. A row a part comes to the driver."""
    own = inc.join(place.select("v", F.col("part").alias("home")), "v")
    ends = own.groupBy(F.col("home").alias("part")).agg(F.sum("n").alias("ends"))
    halo = own.where("part <> home").groupBy("part").agg(F.count("*").alias("halo"))
    rows = place.groupBy("part").agg(F.count("*").alias("c")).join(ends, "part", "left").join(halo, "part", "full").fillna(0)
    with sized(inc.sparkSession):
        return {r["part"]: (r["c"], r["ends"], r["halo"]) for r in rows.collect()}


def gains(sym: DataFrame, inc: DataFrame, place: DataFrame, movers: DataFrame, parts: int | None = None) -> DataFrame:
    """v, part, to, gain: what a move of each of ``movers`` (v) to a part (0..parts - 1) it has edges into takes from the halo volume."""
    if parts is None:
        parts = (place.agg(F.max("part")).first()[0] or 0) + 1
    into = [F.coalesce(F.sum(F.when(F.col("part") == q, F.col("n"))), F.lit(0)).alias(f"n{q}") for q in range(parts)]
    state = inc.groupBy("v").agg(*into).join(place.select("v", F.col("part").alias("home")), "v")
    # A row an edge with the state of its far end; those that a move brings into the halo of a part, and those whose only edges there it takes.
    near = sym.join(movers.select(F.col("v").alias("a")), "a", "left_semi").join(state.withColumnRenamed("v", "b"), "b")
    far = lambda q: F.col("home") != q
    joins = [F.count_if(far(q) & (F.col(f"n{q}") == 0)).alias(f"join{q}") for q in range(parts)]
    leaves = [F.count_if(far(q) & (F.col(f"n{q}") == F.col("w"))).alias(f"leave{q}") for q in range(parts)]
    d = near.groupBy(F.col("a").alias("v")).agg(*joins, *leaves).join(state, "v")
    at = lambda name: F.element_at(F.array(*[F.col(f"{name}{q}") for q in range(parts)]), F.col("home").cast("int") + 1)
    # v itself leaves q's halo, and is in that of its home if it has edges there.
    gain = lambda q: at("leave") - F.col(f"join{q}") + 1 - (at("n") > 0).cast("long")
    moves = F.array(*[F.when(far(q) & (F.col(f"n{q}") > 0), F.struct(F.lit(q).cast("long").alias("to"), gain(q).alias("gain"))) for q in range(parts)])
    return d.select("v", F.col("home").alias("part"), F.explode(F.array_compact(moves)).alias("m")).select("v", "part", "m.to", "m.gain")


def refined(g: TemporalGraph, place: DataFrame, parts: int, cap: float, objective: str = "halo", rounds: int = 6) -> tuple[DataFrame, list[int]]:
    """v, part and the objective before and after each round that was kept: it falls from one to the next.

    ``halo`` is the halo volume; ``straggler`` the greatest work of a part, its edge ends and ``ALPHA`` times its halo: only the busiest part gives vertices away.
    """
    if objective not in ("halo", "straggler"):
        raise ValueError(objective)
    e = kept(simple(g), "simple")
    sym = both(e)
    place = kept(place.select("v", F.col("part").cast("long").alias("part")), "place")
    inc = kept(incidence(sym, place), "incidence")
    work = lambda c: {p: x[1] + ALPHA * x[2] for p, x in c.items()}
    value = lambda c: sum(x[2] for x in c.values()) if objective == "halo" else max(work(c).values(), default=0)
    costs = part_costs(inc, place)
    trace, share = [value(costs)], BUCKETS
    for k in range(rounds):
        who = inc.join(place.withColumnRenamed("part", "home"), "v").groupBy("v", "home").agg(F.count_if(F.col("part") != F.col("home")).alias("out")).where("out > 0")
        busy = max(work(costs), key=lambda p: (work(costs)[p], -p), default=0)
        if objective == "straggler":
            who = who.where(F.col("home") == busy)
        who = who.where(F.pmod(F.xxhash64("v", F.lit(k)), F.lit(BUCKETS)) < share)
        room = {p: max(0, int(cap) - costs.get(p, (0, 0, 0))[0]) for p in range(parts)}
        d = gains(sym, inc, place, who, parts).where("gain > 0")
        best = kept(d.groupBy("v", "part").agg(F.max(F.struct("gain", (-F.col("to")).alias("t"))).alias("m")).select("v", "part", (-F.col("m.t")).alias("to"), F.col("m.gain").alias("gain")), "moves")
        # As many as a part has room for, those of most gain first, by a hash among equals.
        sums = best.groupBy("to", "gain", F.pmod(F.xxhash64("v"), F.lit(BUCKETS)).alias("bucket")).agg(F.count("*").alias("c")).toPandas().sort_values(["gain", "bucket"], ascending=[False, True])
        cells = [(int(r["to"]), int(r["gain"]), int(r["bucket"])) for p, own in sums.groupby("to") for r in own[own["c"].cumsum() <= room[int(p)]].to_dict("records")]
        if not cells:
            dropped(best)
            break
        fit = F.broadcast(g.spark.createDataFrame(cells, "to long, gain long, bucket long"))  # a row a part, gain and bucket
        moves = kept(best.withColumn("bucket", F.pmod(F.xxhash64("v"), F.lit(BUCKETS))).join(fit, ["to", "gain", "bucket"], "left_semi").select("v", "part", "to"), "moves")
        edge = sym.join(moves.withColumnRenamed("v", "a"), "a")
        delta = edge.select(F.col("b").alias("v"), "part", (-F.col("w")).alias("n")).unionAll(edge.select(F.col("b").alias("v"), F.col("to").alias("part"), F.col("w").alias("n")))
        inc_then = kept(inc.unionAll(delta).groupBy("v", "part").agg(F.sum("n").alias("n")).where("n > 0"), "incidence")
        then = kept(place.join(moves.select("v", "to"), "v", "left").select("v", F.coalesce("to", "part").alias("part")), "place")
        costs_then = part_costs(inc_then, then)
        falls = value(costs_then) < trace[-1]
        dropped(best, moves, *((place, inc) if falls else (then, inc_then)))
        if falls:
            place, inc, costs = then, inc_then, costs_then
            trace.append(value(costs))
        elif share == 1:
            break
        else:
            share = max(1, share // 4)
    dropped(e, inc)
    return place, trace
