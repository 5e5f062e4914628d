"""Multilevel placement in rounds of joins: cluster and contract, bisect the small graph, project and swap.

Two thirds of the vertices, by a hash, join the heaviest neighbour of the rest;
what is still alone then joins others whose heaviest neighbour has the same
label (two hops away), vertices without an edge each other. Clusters that would
be too heavy are dealt out by a hash. The graph is contracted until it has about
``SMALL`` vertices, whatever it had at first, and these are split by recursive
bisection in one task, whose size is that bound.

Refinement exchanges vertices between parts. For each pair of parts the moves
both ways stand in order of gain, and are carried out down to the depth at
which the two marginal gains no longer add up to more than nothing; a part with
room takes moves with gain, and a part over its cap gives away those that lose
least: that is the balance pass. All of it is decided on sums for each pair,
level of gain and bucket of a hash, so no task has all moves of a part; the driver gets these sums, not the vertices.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scratch import dropped, kept
from ..sources.graphs import TemporalGraph
from .placement import split

#: Vertices of the graph that is bisected, more only for more than a few dozen parts; buckets that moves of one gain are told apart by.
SMALL, BUCKETS = 1000, 16
#: Of the buckets, those whose vertices may move in one round.
OUT = 12
#: A cluster's weight in one contraction is at most so many times the mean.
GROWTH = 8


def simple(g: TemporalGraph) -> DataFrame:
    """a < b and w, the number of edges between them; loops go."""
    return g.edges.where("src <> dst").groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.count("*").alias("w"))


def both(e: DataFrame) -> DataFrame:
    return e.unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b"), "w"))


# Contraction


def clustered(sym: DataFrame, v: DataFrame, most: float, turn: int = 0) -> DataFrame:
    """v, w, up: clusters of about ``most`` in weight at most (a vertex may weigh more by itself), ``up`` being one of their vertices."""
    asks = lambda x: F.pmod(F.xxhash64(x, F.lit(turn)), F.lit(3)) < 2
    asked = sym.where(asks("a") & ~asks("b")).groupBy(F.col("a").alias("v")).agg(F.max(F.struct("w", F.xxhash64("a", "b", F.lit(turn)).alias("h"), "b")).alias("m")).select("v", F.col("m.b").alias("to"))
    now = kept(_parted(v.join(asked, "v", "left").select("v", "w", F.coalesce("to", "v").alias("hub")), most), "clusters")
    # Two hops: clusters of one vertex join where their heaviest neighbours have one label; those without neighbours, too.
    size = now.groupBy("up").agg(F.count("*").alias("n"), F.min("v").alias("v")).where("n = 1").select("v", F.lit(True).alias("alone"))
    alone = now.join(size, "v").select("v", "w")
    near = sym.join(alone.select(F.col("v").alias("a")), "a", "left_semi").join(now.select(F.col("v").alias("b"), F.col("up").alias("hub")), "b")
    hub = near.groupBy("a", "hub").agg(F.sum("w").alias("s")).groupBy(F.col("a").alias("v")).agg(F.max(F.struct("s", "hub")).alias("m")).select("v", F.col("m.hub").alias("hub"))
    joined = _parted(alone.join(hub, "v", "left").fillna(-1, ["hub"]), most).select("v", F.col("up").alias("to"))
    out = kept(now.join(joined, "v", "left").select("v", "w", F.coalesce("to", "up").alias("up")), "clusters")
    dropped(now)
    return out


def _parted(asked: DataFrame, most: float) -> DataFrame:
    """v, w, up: those that ask for one hub (v, w, hub) together, in as many groups by a hash as their weight needs, two thirds full on average."""
    groups = asked.groupBy("hub").agg(F.greatest(F.lit(1), F.ceil(F.sum("w") / (most / 1.5))).alias("k"))
    asked = asked.join(groups, "hub").withColumn("group", F.when(F.col("v") == F.col("hub"), 0).otherwise(F.pmod(F.xxhash64("v", F.lit(11)), F.col("k"))))
    ids = asked.groupBy("hub", "group").agg(F.min("v").alias("up"))
    return asked.join(ids, ["hub", "group"]).select("v", "w", "up")


def contracted(e: DataFrame, up: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges and vertices of the graph of the clusters."""
    x, y = up.select(F.col("v").alias("a"), F.col("up").alias("x")), up.select(F.col("v").alias("b"), F.col("up").alias("y"))
    edges = e.join(x, "a").join(y, "b").where("x <> y").groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.sum("w").alias("w"))
    return edges, up.groupBy(F.col("up").alias("v")).agg(F.sum("w").alias("w"))


# The small graph


def bisected(e: DataFrame, v: DataFrame, parts: int) -> DataFrame:
    """v, w, part of a graph of at most a few thousand vertices, by recursive bisection in one task."""

    def place(key, rows):
        verts, edges = rows[rows["b"] < 0].sort_values("a"), rows[rows["b"] >= 0]
        ids, weight = verts["a"].to_numpy(), verts["w"].to_numpy().astype(float)
        near = np.zeros((len(ids), len(ids)))
        x, y = np.searchsorted(ids, edges["a"].to_numpy()), np.searchsorted(ids, edges["b"].to_numpy())
        near[x, y] = near[y, x] = edges["w"].to_numpy()
        part, todo = np.zeros(len(ids), np.int64), [(np.arange(len(ids)), 0, parts)]
        while todo:
            own, first, k = todo.pop()
            if k == 1 or not len(own):
                part[own] = first
                continue
            side = halves(near[np.ix_(own, own)], weight[own], (k // 2) / k)
            todo += [(own[side], first, k // 2), (own[~side], first + k // 2, k - k // 2)]
        return pd.DataFrame({"v": ids, "w": weight.astype(np.int64), "part": part})

    rows = v.select(F.col("v").alias("a"), F.lit(-1).cast("long").alias("b"), "w").unionAll(e.select("a", "b", "w"))
    return rows.withColumn("one", F.lit(0)).groupBy("one").applyInPandas(place, "v long, w long, part long")


def halves(near: np.ndarray, weight: np.ndarray, share: float) -> np.ndarray:
    """Of a small graph, which vertices are on the first side: a sweep along the Fiedler vector, then exchanges while they help."""
    n, total = len(weight), weight.sum()
    vector = np.linalg.eigh(np.diag(near.sum(1)) - near)[1][:, min(1, n - 1)]
    order = np.argsort(vector, kind="stable")
    side = np.zeros(n, bool)
    side[order[np.cumsum(weight[order]) - weight[order] / 2 <= share * total]] = True
    slack = max(weight.max(), 0.01 * total)
    gain = np.where(side, -1, 1) * (near @ np.where(side, 1.0, -1.0))  # what the cut loses if a vertex goes over
    held = weight[side].sum()
    for _ in range(2 * n):
        a, b = (np.flatnonzero(s) for s in (side, ~side))
        a, b = (x[np.argsort(-gain[x], kind="stable")[:40]] for x in (a, b))
        if not len(a) or not len(b):
            break
        better = gain[a][:, None] + gain[b][None, :] - 2 * near[np.ix_(a, b)]
        shift = np.abs(held - weight[a][:, None] + weight[b][None, :] - share * total)
        better[(shift > slack) & (shift >= abs(held - share * total))] = -np.inf
        i, j = np.unravel_index(better.argmax(), better.shape)
        if better[i, j] <= 1e-9:
            break
        for x in (a[i], b[j]):
            s = np.where(side == side[x], 1.0, -1.0)
            held += -weight[x] if side[x] else weight[x]
            gain += 2 * near[x] * s
            side[x] = not side[x]
            gain[x] = -gain[x]
    return side


# Refinement


def exchanged(e: DataFrame, place: DataFrame, parts: int, cap: float | list[float], rounds: int = 6, sym: DataFrame | None = None) -> DataFrame:
    """v, w, part: the placement of least cut among those under ``cap`` (one, or one a part) that rounds of exchanges come to, ``place`` included.

    If none of them is under the cap, rounds go on while the greatest load falls, and the last is given.
    """
    cap = np.broadcast_to(np.asarray(cap, float), parts)
    given, sym = sym, sym if sym is not None else kept(both(e), "sym")
    now, best, least, heaviest, k = kept(place.select("v", "w", "part"), "place"), None, None, None, 0
    load = np.zeros(parts)
    for r in now.groupBy("part").agg(F.sum("w").alias("s")).collect():
        load[r["part"]] = r["s"]
    own_sym = sym if given is None else None
    while True:
        near = sym.join(now.select(F.col("v").alias("b"), F.col("part").alias("to")), "b").groupBy("a", "to").agg(F.sum("w").alias("s"))
        j = now.select(F.col("v").alias("a"), "part", F.col("w").alias("weight")).join(near, "a")
        own = F.coalesce(F.sum(F.when(F.col("to") == F.col("part"), F.col("s"))), F.lit(0))
        pick = F.max(F.when(F.col("to") != F.col("part"), F.struct("s", F.xxhash64("a", "to", F.lit(k)).alias("h"), "to")))
        one = j.groupBy(F.col("a").alias("v"), "part", "weight").agg(F.sum("s").alias("all"), own.alias("own"), pick.alias("m")).where("all > own")
        gain = F.col("m.s") - F.col("own")
        # Gains in steps of a fifth, so that there are a few dozen of them whatever the weights.
        level = (F.signum(gain) * F.round(4 * F.log2(1 + F.abs(gain)))).cast("int")
        one = kept(one.select("v", "part", "weight", (F.col("all") - F.col("own")).alias("out"), F.col("m.to").alias("to"), gain.alias("gain"), level.alias("level"), F.pmod(F.xxhash64("v", F.lit(k)), F.lit(BUCKETS)).cast("int").alias("bucket")), "gains")
        sums = one.groupBy("part", "to", "level", "bucket").agg(F.sum("weight").alias("w"), F.sum("out").alias("out"), (F.sum(F.col("gain") * F.col("weight")) / F.sum("weight")).alias("gain")).toPandas()
        cut, top = int(sums["out"].sum()) // 2, (load / np.maximum(cap, 1e-9)).max()
        if top <= 1 and (least is None or cut < least):
            old, best, least = best, now, cut
            dropped(*[old] if old is not None else [])
        if k >= rounds and (best is not None or heaviest is not None and top >= heaviest):
            dropped(one, *[own_sym] if own_sym is not None else [], *[now] if best is not None and best is not now else [])
            return best if best is not None else now
        heaviest, k = top, k + 1
        chosen, load = _chosen(sums, load, cap)
        moves = one.join(F.broadcast(now.sparkSession.createDataFrame(chosen, "part long, to long, level int, bucket int")), ["part", "to", "level", "bucket"], "left_semi").select("v", "to")
        spill = _inner(now, one, load, cap, k)
        then = kept(now.join(moves if spill is None else moves.unionAll(spill), "v", "left").select("v", "w", F.coalesce("to", "part").alias("part")), "place")
        dropped(one, *[now] if now is not best else [])
        now = then
        if spill is not None:
            load = np.zeros(parts)
            for r in now.groupBy("part").agg(F.sum("w").alias("s")).collect():
                load[r["part"]] = r["s"]


def _chosen(sums: pd.DataFrame, load: np.ndarray, cap: np.ndarray) -> tuple[list[tuple], np.ndarray]:
    """Which cells (part, to, level, bucket) of moves are carried out, and the loads then.

    ``sums`` has a row for each cell that occurs: at most parts * parts * levels * buckets of them. Of the buckets
    a share is exchanged, as vertices that leave together spoil each other's gain.
    """
    load, out, cap = load.copy(), [], cap * 0.999
    sums = sums.sort_values(["level", "bucket"], ascending=[False, True], kind="stable")
    queue = {key: d for key, d in sums.groupby(["part", "to"], sort=False)}
    take = lambda d: out.extend(zip(d["part"], d["to"], d["level"], d["bucket"], strict=True))
    taken = {}
    for (p, q), d in queue.items():
        taken[p, q] = 0
        if p > q or (q, p) not in queue:
            continue
        x, y = (z[z["bucket"] < OUT] for z in (d, queue[q, p]))
        if not len(x) or not len(y):
            continue
        gx, gy, wx, wy = x["gain"].to_numpy(), y["gain"].to_numpy(), x["w"].to_numpy().cumsum(), y["w"].to_numpy().cumsum()
        depth = np.unique(np.concatenate([wx, wy]))
        depth = depth[depth <= min(wx[-1], wy[-1])]
        pays = gx[np.searchsorted(wx, depth)] + gy[np.searchsorted(wy, depth)] > 0
        most = depth[pays].max() if pays.any() else 0
        for key, z, w in (((p, q), x, wx), ((q, p), y, wy)):
            taken[key] = int((w <= most).sum())
            take(z.iloc[: taken[key]])
            moved = w[taken[key] - 1] if taken[key] else 0
            load[key[0]] -= moved
            load[key[1]] += moved
            queue[key] = pd.concat([z.iloc[taken[key] :], queue[key][queue[key]["bucket"] >= OUT]]) if load[key[0]] > cap[key[0]] else z.iloc[taken[key] :]
    # Moves that there is room for: those with gain, then any from a part over its cap until it is under.
    for (p, q), d in sorted(queue.items(), key=lambda kv: -load[kv[0][0]]):
        d = d.sort_values(["level", "bucket"], ascending=[False, True], kind="stable")
        good = (d["gain"] > 0) & ((d["bucket"] < OUT) | (load[p] > cap[p]))
        for own, room in ((d[good], cap[q] - load[q]), (d[~good], None)):
            run = own["w"].to_numpy().cumsum()
            n = int(np.searchsorted(run, room if room is not None else min(cap[q] - load[q], load[p] - cap[p]), side="right"))
            if n:
                take(own.iloc[:n])
                load[p] -= run[n - 1]
                load[q] += run[n - 1]
    return [tuple(int(z) for z in x) for x in out] or [(-1, -1, 0, 0)], load


def _inner(now: DataFrame, edge: DataFrame, load: np.ndarray, cap: np.ndarray, k: int) -> DataFrame | None:
    """v, to: of parts that are over the cap still, vertices without an edge to another part, as many as are over, to parts with room."""
    over, room = np.maximum(load - cap, 0), np.maximum(cap - load, 0)
    if over.sum() < 1 or room.sum() <= 0:
        return None
    ends = np.cumsum(room) / room.sum()
    h = lambda salt: F.pmod(F.xxhash64("v", F.lit(salt)), F.lit(1 << 20)) / (1 << 20)
    to = sum((F.when(h(k) >= float(x), 1).otherwise(0) for x in ends[:-1]), F.lit(0)).cast("long")
    share = F.element_at(F.create_map(*[F.lit(x) for p in np.flatnonzero(over) for x in (int(p), float(1.1 * over[p] / load[p]))]), F.col("part").cast("int"))
    inner = now.where(F.col("part").isin([int(p) for p in np.flatnonzero(over)])).join(edge.select("v"), "v", "left_anti")
    return inner.where(h(k + 1000) < share).select("v", to.alias("to"))


# All levels


def multilevel(g: TemporalGraph, parts: int, slack: float = 1.03, weight: DataFrame | None = None, small: int = SMALL, rounds: tuple[int, int] = (1, 10)) -> DataFrame:
    """v, part with at most ``slack`` times the mean weight on a part, of vertices (v, w) that weigh 1 if none are given.

    ``rounds`` are those of the contracted graphs and of the whole one. A graph that clusters can't make smaller
    begins from its order by weight.
    """
    e = kept(simple(g), "edges")
    v = kept(weight if weight is not None else g.vertices().select("v", F.lit(1).cast("long").alias("w")), "vertices")
    row = v.agg(F.sum("w").alias("w"), F.count("*").alias("n")).first()
    total, n, cap = row["w"] or 0, row["n"], slack * (row["w"] or 0) / parts
    stop, stack = max(30 * parts, small), []
    while n > 2 * stop:
        sym = both(e)
        up = clustered(sym, v, min(3 * total / stop, GROWTH * total / n), len(stack))
        ee, vv = (kept(x, "contracted") for x in contracted(e, up))
        fewer = vv.count()
        if fewer > 0.95 * n:
            dropped(up, ee, vv)
            break
        stack.append((e, up))
        dropped(v)
        e, v, slow, n = ee, vv, fewer > 0.7 * n, fewer
        if slow and n <= 4 * stop:
            break
    if n <= 4 * stop:
        place = kept(bisected(e, v, parts), "place")
    else:
        place = split(v.select("v", F.col("w").alias("work")), [F.desc("work"), F.asc("v")], parts).select("v", F.col("work").alias("w"), "part")
    for ee, up in reversed(stack):
        better = exchanged(e, place, parts, cap, rounds[0], both(e))
        dropped(place, e)
        place = kept(up.join(better.select(F.col("v").alias("up"), "part"), "up").select("v", "w", "part"), "place")
        dropped(better, up)
        e = ee
    out = exchanged(e, place, parts, cap, rounds[1], both(e)).select("v", "part")
    dropped(place, e)
    return out
