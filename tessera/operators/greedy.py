"""Placements that depend on order, and their batch-synchronous forms.

In a stream each decision depends on those before it. ``streamed`` and
``edge_streamed`` make them block by block, one task a block and parameter set,
with what the blocks before have left behind: votes that joins have counted,
loads, and the state of the vertices that the block meets. So a task's rows are
bounded, whatever the graph, but blocks follow each other. Wherever rounds will
do, placements come from ``multilevel`` and ``refined``: joins and aggregations
whose moves are admitted by running sums under each part's cap, and of which
the best round is kept.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.position import with_position
from ..functions.scratch import appended, dropped, kept, table_path
from ..sources.graphs import TemporalGraph
from . import supra as G
from .metrics import placed
from .multilevel import multilevel
from .stats import degree
from .supra import both_ways

#: Of a block of a stream of vertices: vote counts, and pairs with both ends in it, at most about; ids are dealt to blocks in so many ranges.
BLOCK_VOTES, BLOCK_PAIRS, RANGES = 1 << 22, 1 << 21, 512
#: Edges of a block of a stream of edges.
BLOCK_EDGES = 1 << 20


def _blocks(pairs: np.ndarray, ids: int, votes: int, most: int) -> list[tuple[int, int]]:
    """Blocks lo..hi - 1 of ranges of ``ids`` vertices; ``pairs`` has how many pairs two ranges have, the later one first. A range is never cut."""
    out, lo = [], 0
    while lo < len(pairs):
        hi, inside = lo + 1, pairs[lo, lo]
        while hi < len(pairs) and (hi + 1 - lo) * ids <= votes and inside + pairs[hi, lo : hi + 1].sum() <= most:
            inside += pairs[hi, lo : hi + 1].sum()
            hi += 1
        out.append((lo, hi))
        lo = hi
    return out


def streamed(g: TemporalGraph, parts: int, modes: tuple[str, ...] = ("fennel", "ldg"), gamma: float = 1.5) -> DataFrame:
    """mode, v, part: vertices in order of id, each to the part of the best score among its placed neighbours less a load penalty.

    ``fennel`` skips parts over a soft cap of 1.1 times the mean, ``ldg`` scales by the room left.
    """
    spark, n, m, columns = g.spark, g.num_nodes, g.num_edges, [f"n{p}" for p in range(parts)]
    schema = "mode string, v long, part long"
    if not n:
        return spark.createDataFrame([], schema)
    # Of a pair only the later end asks. Ranges of it are written together, so that a block reads its own files.
    near = g.edges.where("src <> dst").groupBy(F.greatest("src", "dst").alias("v"), F.least("src", "dst").alias("b")).agg(F.count("*").alias("w"))
    near = kept(near.repartitionByRange("v"), "near")
    ids = -(-n // RANGES)
    pairs = np.zeros((-(-n // ids),) * 2, np.int64)
    for r in near.groupBy(F.expr(f"v div {ids}").alias("x"), F.expr(f"b div {ids}").alias("y")).agg(F.count("*").alias("c")).collect():
        pairs[r["x"], r["y"]] = r["c"]
    weight, mean = m * parts ** (gamma - 1) / max(1, n) ** gamma * gamma, n / parts
    loads = {mode: [0] * parts for mode in modes}
    done, path = None, table_path(spark, "streamed")
    each = F.explode(F.array(*[F.lit(mode) for mode in modes])).alias("mode")

    def decided(lo: int, hi: int, before: dict[str, list[int]]):
        def place(key, d):
            mode, load = key[0], list(before[key[0]])
            v, b, w = d["v"].to_numpy() - lo, d["b"].to_numpy(), d[columns].to_numpy()
            votes = np.zeros((hi - lo, parts), np.int64)
            old, inner = (v >= 0) & (b < 0), np.flatnonzero(b >= 0)
            votes[v[old]] = w[old]
            inner = inner[np.argsort(v[inner], kind="stable")]
            at, others, times = np.searchsorted(v[inner], np.arange(hi - lo + 1)).tolist(), b[inner] - lo, w[inner, 0]
            part = np.zeros(hi - lo, np.int64)
            penalty = lambda x: float((np.array([x], float) ** (gamma - 1))[0] * weight)
            room = lambda x: max(0.0, 1 - x / mean)
            if mode == "fennel":
                less, scale = [penalty(x) for x in load], [1] * parts
            else:
                less, scale = [1e-9 * x for x in load], [room(x) for x in load]
            # The first part has no soft cap, so that there is always one to take.
            full = [mode == "fennel" and p > 0 and load[p] >= 1.1 * mean for p in range(parts)]
            for first in range(0, hi - lo, 1 << 14):
                for i, vote in enumerate(votes[first : first + (1 << 14)].tolist(), first):
                    for k in range(at[i], at[i + 1]):
                        vote[part[others[k]]] += int(times[k])
                    best, to = -np.inf, 0
                    for p in range(parts):
                        score = vote[p] * scale[p] - less[p]
                        if score > best and not full[p]:
                            best, to = score, p
                    part[i] = to
                    load[to] += 1
                    if mode == "fennel":
                        less[to], full[to] = penalty(load[to]), to > 0 and load[to] >= 1.1 * mean
                    else:
                        less[to], scale[to] = 1e-9 * load[to], room(load[to])
            return pd.DataFrame({"mode": mode, "v": np.arange(lo, hi), "part": part})

        return place

    for x, y in _blocks(pairs, ids, max(1, BLOCK_VOTES // parts), BLOCK_PAIRS):
        lo, hi = x * ids, min(y * ids, n)
        own, none = near.where((F.col("v") >= lo) & (F.col("v") < hi)), [F.lit(0).cast("long").alias(c) for c in columns[1:]]
        # A row a mode, so that none is without a task; pairs within the block; votes of the blocks before.
        rows = spark.range(1).select(each, F.lit(-1).cast("long").alias("v"), F.lit(-1).cast("long").alias("b"), F.lit(0).cast("long").alias(columns[0]), *none)
        rows = rows.unionAll(own.where(F.col("b") >= lo).select(each, "v", "b", F.col("w").alias(columns[0]), *none))
        if done is not None:
            placed_before = done.select("mode", F.col("v").alias("b"), "part")
            counts = [F.coalesce(F.sum(F.when(F.col("part") == p, F.col("w"))), F.lit(0)).alias(c) for p, c in enumerate(columns)]
            rows = rows.unionAll(own.where(F.col("b") < lo).join(placed_before, "b").groupBy("mode", "v").agg(*counts).select("mode", "v", F.lit(-1).cast("long").alias("b"), *columns))
        done = appended(rows.groupBy("mode").applyInPandas(decided(lo, hi, loads), schema), path)
        loads = {mode: [0] * parts for mode in modes}
        for r in done.groupBy("mode", "part").agg(F.count("*").alias("c")).collect():
            loads[r["mode"]][r["part"]] = r["c"]
    dropped(near)
    return done


def edge_streamed(g: TemporalGraph, parts: int, balance: tuple[float, ...] = (1.0,)) -> DataFrame:
    """balance, src, dst, part: edges in order, each to the part that already has its ends, its rarer end first, less how full it is."""
    spark, schema = g.spark, "balance double, src long, dst long, part long"
    if not g.num_edges:
        return spark.createDataFrame([], schema)
    ends = lambda e, *more: e.select(*more, F.explode(F.array("src", "dst")).alias("v"))
    deg = kept(ends(g.edges).groupBy("v").agg(F.count("*").alias("n")), "degrees")
    sets = F.explode(F.array(*[F.lit(float(x)) for x in balance])).alias("balance")
    sizes = {float(x): [0] * parts for x in balance}

    def decided(before: dict[float, list[int]]):
        def place(key, e, s):
            e, size = e.sort_values("pos"), list(before[key[0]])
            src, dst = e["src"].to_numpy(), e["dst"].to_numpy()
            ids, code = np.unique(np.concatenate([src, dst]), return_inverse=True)
            at, part, n = np.searchsorted(ids, s["v"].to_numpy()), s["part"].to_numpy(), s["n"].to_numpy()
            count, has, out = np.zeros(len(ids), np.int64), [0] * len(ids), np.empty(len(e), np.int64)
            count[at[part < 0]] = n[part < 0]
            for v, p in zip(at[part >= 0].tolist(), part[part >= 0].tolist(), strict=True):
                has[v] |= 1 << p  # a bit a part
            count = count.tolist()
            for i, (u, v) in enumerate(zip(code[: len(e)].tolist(), code[len(e) :].tolist(), strict=True)):
                share = count[u] / (count[u] + count[v])
                most, x, y, best, to = max(size), has[u], has[v], -np.inf, 0
                spread = 1 + most - min(size)
                for p in range(parts):
                    score = (2 - share if x >> p & 1 else 0) + (1 + share if y >> p & 1 else 0) + key[0] * (most - size[p]) / spread
                    if score > best:
                        best, to = score, p
                out[i] = to
                has[u] |= 1 << to
                has[v] |= 1 << to
                size[to] += 1
            return pd.DataFrame({"balance": key[0], "src": src, "dst": dst, "part": out})

        return place

    done, at = None, table_path(spark, "edge-streamed")
    has = spark.createDataFrame([], "balance double, v long, part long")
    for lo in range(0, g.num_edges, BLOCK_EDGES):
        block = g.edges.where((F.col("pos") >= lo) & (F.col("pos") < lo + BLOCK_EDGES)).select("pos", "src", "dst")
        met = ends(block).distinct()
        # What the block's vertices are: how often they occur in all, and the parts that have them already.
        state = deg.join(met, "v", "left_semi").select(sets, "v", F.lit(-1).cast("long").alias("part"), "n")
        state = state.unionAll(has.join(met, "v", "left_semi").select("balance", "v", "part", F.lit(0).cast("long").alias("n")))
        new = kept(block.select(sets, "*").groupBy("balance").cogroup(state.groupBy("balance")).applyInPandas(decided(sizes), schema), "block")
        for r in new.groupBy("balance", "part").agg(F.count("*").alias("c")).collect():
            sizes[r["balance"]][r["part"]] += r["c"]
        if lo + BLOCK_EDGES < g.num_edges:
            then = kept(has.unionAll(ends(new, "balance", "part").select("balance", "v", "part")).distinct(), "has")
            dropped(has)
            has = then
        done = appended(new, at)
        dropped(new)
    dropped(deg, has)
    return done


def cut_of(e: DataFrame, place: DataFrame) -> int:
    """Weight of edges (a, b, w; each once) between parts of ``place`` (v, part)."""
    p = place.select("v", "part")
    j = e.join(p.withColumnsRenamed({"v": "a", "part": "pa"}), "a").join(p.withColumnsRenamed({"v": "b", "part": "pb"}), "b")
    return j.agg(F.sum(F.when(F.col("pa") != F.col("pb"), F.col("w")))).first()[0] or 0


#: Moves of one gain are admitted in so many parts, by a hash.
BUCKETS = 64


def _admitted(moves: DataFrame, place: DataFrame, cap: float) -> DataFrame:
    """v, to: of ``moves`` (v, to, gain, weight) those that fit under the cap of their target, by gain and then by a hash of v.

    Running sums are taken over sums a target, gain and bucket, so no task has all moves of a part.
    """
    m = moves.withColumn("bucket", F.pmod(F.xxhash64("v"), F.lit(BUCKETS)))
    sums = m.groupBy("to", "gain", "bucket").agg(F.sum("weight").alias("s"))
    load = place.groupBy(F.col("part").alias("to")).agg(F.sum("w").alias("load"))
    run = sums.withColumn("run", F.sum("s").over(Window.partitionBy("to").orderBy(F.desc("gain"), "bucket").rowsBetween(Window.unboundedPreceding, 0)))
    fit = run.join(F.broadcast(load), "to", "left").where(F.coalesce("load", F.lit(0)) + F.col("run") <= cap).select("to", "gain", "bucket")
    return m.join(fit, ["to", "gain", "bucket"], "left_semi").select("v", "to")


def refined(e: DataFrame, place: DataFrame, parts: int, cap: float, rounds: int = 6) -> DataFrame:
    """v, w, part no worse than ``place``: rounds of moves with gain, admitted by gain while the target stays under ``cap``, upward and downward in turn.

    ``e`` (a, b, w) holds each edge once, ``place`` has v, w (weight) and part. One table a round tells the cut of the
    placement so far and the moves that would lessen it; only vertices with an edge to another part are in it.
    """
    sym = kept(e.unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b"), "w")), "sym")
    best = now = kept(place.select("v", "w", "part"), "place")
    least = None
    for k in range(rounds + 1):
        near = sym.join(now.select(F.col("v").alias("b"), F.col("part").alias("to")), "b").groupBy("a", "to").agg(F.sum("w").alias("s"))
        j = near.join(now.select(F.col("v").alias("a"), "part", F.col("w").alias("weight")), "a")
        up = (F.col("to") > F.col("part")) if k % 2 == 0 else (F.col("to") < F.col("part"))
        own = F.coalesce(F.sum(F.when(F.col("to") == F.col("part"), F.col("s"))), F.lit(0))
        pick = F.max(F.when(up, F.struct("s", (-F.col("to")).alias("t"))))
        one = j.groupBy(F.col("a").alias("v"), "weight").agg(F.sum("s").alias("all"), own.alias("own"), pick.alias("m")).where("all > own")
        one = kept(one.select("v", "weight", (F.col("all") - F.col("own")).alias("out"), (-F.col("m.t")).alias("to"), (F.col("m.s") - F.col("own")).alias("gain")), "gains")
        cut = (one.agg(F.sum("out")).first()[0] or 0) // 2
        if least is None or cut < least:
            best, least = now, cut
        elif k % 2 == 0:
            break
        if k < rounds:
            moves = _admitted(one.where("gain > 0"), now, cap)
            now = kept(now.join(moves, "v", "left").select("v", "w", F.coalesce("to", "part").alias("part")), "place")
    return best


def two_level(g: TemporalGraph, groups: int, parts: int) -> DataFrame:
    """v, grp, part: groups by multilevel, then parts of each group by multilevel on its own edges."""
    top = kept(multilevel(g, groups).withColumnRenamed("part", "grp"), "groups")
    inside = kept(placed(g, top.withColumnRenamed("grp", "part")).where("ps = pd").select("pos", F.col("ps").alias("grp"), "src", "dst"), "inside")
    one = F.lit(1).cast("long").alias("w")
    each = []
    for k in range(groups):
        own = TemporalGraph(inside.where(F.col("grp") == k).select("pos", "src", "dst"), g.num_nodes, g.num_edges, f"{g.name}-{k}")
        each.append(multilevel(own, parts, weight=top.where(F.col("grp") == k).select("v", one)).select("v", F.lit(k).cast("long").alias("grp"), "part"))
    return reduce(DataFrame.unionAll, each)


def lpt(g: TemporalGraph, speeds: list[float]) -> DataFrame:
    """v, work, part: vertices by falling degree, each to the part that is free first; planned on the counts of degrees."""
    from .orders import packed_by_work

    return packed_by_work(degree(g).select("v", F.col("deg").alias("work")), speeds)


def supra_solve(g: TemporalGraph, snaps: int, parts: int, w_space: int = 2, w_time: int = 1) -> DataFrame:
    """cell_id, dev, cost of the least weighted cut among vertex blocks, time blocks, and both refined by capped moves."""
    cell = kept(G.cells(g, snaps), "cells")
    pairs = G.spatial_pairs(g, cell, snaps).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.lit(w_space).cast("long").alias("w"))
    e = kept(pairs.unionAll(G.temporal_pairs(cell).select("a", "b", F.lit(w_time).cast("long").alias("w"))).groupBy("a", "b").agg(F.sum("w").alias("w")), "pairs")
    n = cell.count()
    cap = max(1.10 * n / parts, -(-n // parts))
    best = None
    for column in ("v", "snap"):
        start = kept(G.blocks_of(cell, column, parts).select(F.col("cell_id").alias("v"), F.lit(1).cast("long").alias("w"), F.col("dev").alias("part")), "corner")
        for place in (start, refined(e, start, parts, cap)):
            cost = cut_of(e, place)
            if best is None or cost < best[0]:
                best = (cost, place)
    return best[1].select(F.col("v").alias("cell_id"), F.col("part").alias("dev"), F.lit(best[0]).cast("long").alias("cost"))


def touch_set(g: TemporalGraph, prior: DataFrame, since: int, budget: float) -> DataFrame:
    """v: placed vertices that events since a position touch, at most a share of all, those with most crossing edges first."""
    room = int(budget * g.num_nodes)
    touched = g.edges.where(F.col("pos") >= since).select(F.explode(F.array("src", "dst")).alias("v")).distinct().join(prior.select("v"), "v", "left_semi")
    cross = placed(g, prior).where("ps <> pd").select(F.explode(F.array("src", "dst")).alias("v")).groupBy("v").agg(F.count("*").alias("c"))
    # Places in ranges of the order, so that no one task takes the first ``room``.
    return with_position(touched.join(cross, "v", "left").fillna(0, ["c"]), [F.desc("c"), F.asc("v")], "i").where(F.col("i") < room).select("v")


def incremental(g: TemporalGraph, prior: DataFrame, since: int, parts: int, budget: float = 0.05, rounds: int = 6) -> DataFrame:
    """v, part: ``prior`` kept but for new vertices and the touch set, which take the vote of their neighbours (fixed ones count four times), then spill where a part is over N div D + 1."""
    n = g.num_nodes
    moving = touch_set(g, prior, since, budget)
    fixed = kept(prior.join(moving, "v", "left_anti").select("v", "part"), "fixed")
    todo = kept(g.vertices().select("v").join(fixed, "v", "left_anti"), "todo")
    near = kept(both_ways(g.edges).join(todo.withColumnRenamed("v", "a"), "a", "left_semi").groupBy("a", "b").agg(F.count("*").alias("w")), "near")
    anchored = near.join(fixed.withColumnRenamed("v", "b"), "b").groupBy("a", "part").agg((F.sum("w") * 4).alias("s"))
    loose = kept(near.join(todo.withColumnRenamed("v", "b"), "b", "left_semi"), "loose")
    anchored = kept(anchored, "anchored")
    now = todo.select("v", (F.col("v") % parts).alias("part"))
    for k in range(rounds):
        votes = anchored.unionAll(loose.join(now.withColumnRenamed("v", "b"), "b").groupBy("a", "part").agg(F.sum("w").alias("s"))).groupBy("a", "part").agg(F.sum("s").alias("s"))
        best = votes.groupBy("a").agg(F.min(F.struct((-F.col("s")).alias("s"), "part")).alias("m")).select(F.col("a").alias("v"), F.col("m.part").alias("new"))
        now = now.join(best, "v", "left").select("v", F.coalesce("new", "part").alias("part"))
        if k % 2:
            now = kept(now, "votes")
    out = kept(fixed.withColumn("free", F.lit(False)).unionAll(now.select("v", "part", F.lit(True).alias("free"))), "placed")
    return _spilled(out, parts, n // parts + 1)


def _spilled(place: DataFrame, parts: int, cap: int) -> DataFrame:
    """Free vertices of full parts, the last ids first, to parts with room: loads are D numbers, moves a ranked take."""
    load = {r["part"]: r["c"] for r in place.groupBy("part").agg(F.count("*").alias("c")).collect()}
    free = {r["part"]: r["c"] for r in place.where("free").groupBy("part").agg(F.count("*").alias("c")).collect()}
    spans, at = [], {}
    for full in range(parts):
        over = min(load.get(full, 0) - cap, free.get(full, 0))
        for to in sorted(range(parts), key=lambda p: load.get(p, 0)):
            room = cap - load.get(to, 0)
            if over <= 0 or room <= 0 or to == full:
                continue
            k = min(over, room)
            spans.append((full, at.get(full, 0), at.get(full, 0) + k, to))
            at[full] = at.get(full, 0) + k
            load[full], load[to], over = load[full] - k, load.get(to, 0) + k, over - k
    if not spans:
        return place.select("v", "part")
    s = place.sparkSession.createDataFrame(spans, "part long, lo long, hi long, to long")
    # Places within a part from places in all of them: ranges of (part, id) are sorted, not parts.
    ranked = with_position(place.where("free"), [F.asc("part"), F.desc("v")], "r")
    first = ranked.groupBy("part").agg(F.min("r").alias("base"))
    ranked = ranked.join(F.broadcast(first), "part").withColumn("i", F.col("r") - F.col("base"))
    moves = ranked.join(F.broadcast(s), (ranked["part"] == s["part"]) & (F.col("i") >= F.col("lo")) & (F.col("i") < F.col("hi"))).select("v", "to")
    return place.join(moves, "v", "left").select("v", F.coalesce("to", "part").alias("part"))


def migration(prior: DataFrame, now: DataFrame, width: int) -> DataFrame:
    """moved, added, bytes: placed vertices on another part than before, new ones, and the rows' bytes."""
    j = now.select("v", F.col("part").alias("q")).join(prior.select("v", F.col("part").alias("p")), "v", "left")
    moved = F.count_if(F.col("p").isNotNull() & (F.col("p") != F.col("q")))
    return j.agg(moved.alias("moved"), F.count_if(F.col("p").isNull()).alias("added")).select("moved", "added", (F.col("moved") * width * 4).alias("bytes"))


def matched(prior: DataFrame, now: DataFrame, parts: int) -> DataFrame:
    """``now`` with its part numbers renamed one to one so that most vertices keep theirs; the overlaps are D * D numbers."""
    over = {(r["p"], r["q"]): r["c"] for r in prior.select("v", F.col("part").alias("p")).join(now.select("v", F.col("part").alias("q")), "v").groupBy("p", "q").agg(F.count("*").alias("c")).collect()}
    if parts <= 6:
        from itertools import permutations

        best = max(permutations(range(parts)), key=lambda t: sum(over.get((t[q], q), 0) for q in range(parts)))
        names = dict(enumerate(best))
    else:
        names, taken = {}, set()
        for (p, q), _ in sorted(over.items(), key=lambda x: (-x[1], x[0])):
            if q not in names and p not in taken:
                names[q] = p
                taken.add(p)
        rest = iter(sorted(set(range(parts)) - taken))
        names |= {q: next(rest) for q in range(parts) if q not in names}
    m = now.sparkSession.createDataFrame(list(names.items()), "part long, name long")
    return now.join(F.broadcast(m), "part").select("v", F.col("name").alias("part"))


def online(g: TemporalGraph, parts: int, prior: DataFrame | None = None, batches: int = 16, slack: float = 1.05) -> DataFrame:
    """v, part: vertices placed batch by batch as their first events come, each by the vote of placed neighbours times the room left, less the load; old ones stay."""
    first = both_ways(g.edges, "pos").groupBy(F.col("a").alias("v")).agg(F.min("pos").alias("first"))
    order = g.vertices().select("v").join(first, "v", "left").fillna(g.num_edges, ["first"])
    if prior is not None:
        order = order.join(prior, "v", "left_anti")
    order = kept(order.withColumn("batch", F.expr(f"least(first * {batches} div {max(1, g.num_edges)}, {batches - 1})")), "arrivals")
    near = kept(both_ways(g.edges).where("a <> b").groupBy("a", "b").agg(F.count("*").alias("w")), "near")
    cap = slack * g.num_nodes / parts
    done = prior.select("v", "part") if prior is not None else g.spark.createDataFrame([], "v long, part long")
    for k in range(batches):
        batch = order.where(F.col("batch") == k).select("v")
        load = g.spark.range(parts).select(F.col("id").alias("part")).join(done.groupBy("part").agg(F.count("*").alias("load")), "part", "left").fillna(0)
        votes = near.join(batch.withColumnRenamed("v", "a"), "a").join(done.withColumnRenamed("v", "b"), "b").groupBy(F.col("a").alias("v"), "part").agg(F.sum("w").alias("s"))
        room = F.greatest(F.lit(0.0), 1 - F.col("load") / cap)
        score = F.coalesce("s", F.lit(0)) * room - F.col("load") / cap
        every = batch.join(F.broadcast(load)).join(votes, ["v", "part"], "left").withColumn("score", F.when(room > 0, score).otherwise(-1e9 - F.col("load")))
        new = every.groupBy("v").agg(F.max(F.struct("score", (-F.col("part")).alias("p"))).alias("m")).select("v", (-F.col("m.p")).alias("part"))
        done = kept(done.unionAll(new), "online")
    return done
