"""Graphs that change by windows: bounds, active vertices, what moves, and who holds the hot ones.

A window is a run of snapshots, so it is a range of positions; tables over
windows have one row per window and vertex, keyed by the window's last snapshot.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.position import with_position
from ..functions.scratch import kept
from ..sources.graphs import TemporalGraph
from .metrics import filled
from .stats import degree
from .supra import both_ways


def snapshot_bounds(g: TemporalGraph, snaps: int, by: str = "edges", window: int = 0) -> DataFrame:
    """snap (1 to S), lo, hi: positions of its edges, from the start (``window`` 0) or of the last ``window`` snapshots.

    By ``edges`` snapshots have equal counts, by ``time`` equal spans; an empty span repeats the bound before it.
    """
    grid = g.spark.range(1, snaps + 1).select(F.col("id").alias("snap"))
    ends = grid.select("snap", F.expr(f"snap * {g.num_edges} div {snaps}").alias("hi"))
    if by == "time" and g.num_edges:
        t = g.edges.agg(F.min("t").alias("a"), F.max("t").alias("b")).first()
        if t["b"] > t["a"]:
            # The first snapshot whose end is after an edge; the last one takes the rest.
            s = F.least(F.expr(f"(t - {t['a']}) * {snaps} div {t['b'] - t['a']} + 1"), F.lit(snaps)).cast("long")
            count = g.edges.groupBy(s.alias("snap")).agg(F.count("*").alias("c"))
            ends = grid.join(count, "snap", "left").select("snap", F.sum(F.coalesce("c", F.lit(0))).over(Window.orderBy("snap")).alias("hi"))  # one row a snapshot
    before = F.lag("hi", window, 0).over(Window.orderBy("snap")) if window else F.lit(0)
    return ends.select("snap", before.cast("long").alias("lo"), F.col("hi").cast("long").alias("hi"))


def window_edges(g: TemporalGraph, bounds: DataFrame) -> DataFrame:
    """snap, pos, src, dst: an edge in each window that has it; bounds are one row a snapshot, so they are broadcast."""
    return g.edges.join(F.broadcast(bounds), (F.col("pos") >= F.col("lo")) & (F.col("pos") < F.col("hi"))).select("snap", "pos", "src", "dst")


def window_active(g: TemporalGraph, bounds: DataFrame) -> DataFrame:
    """snap, v, local: vertices of each window, numbered from 0 in the order of ids."""
    v = window_edges(g, bounds).select("snap", F.explode(F.array("src", "dst")).alias("v")).distinct()
    r = with_position(v, ["snap", "v"], "r")
    base = r.groupBy("snap").agg(F.min("r").alias("base"))
    return r.join(F.broadcast(base), "snap").select("snap", "v", (F.col("r") - F.col("base")).alias("local"))


def turnover(active: DataFrame) -> DataFrame:
    """snap, active, entered, departed: against the window before; all of the first have entered."""
    now, old = active.select("snap", "v"), active.select((F.col("snap") + 1).alias("snap"), "v", F.lit(True).alias("old"))
    j = now.withColumn("new", F.lit(True)).join(old, ["snap", "v"], "full")
    last = active.agg(F.max("snap").alias("last"))
    out = j.groupBy("snap").agg(F.count_if(F.col("new")).alias("active"), F.count_if(F.col("new") & F.col("old").isNull()).alias("entered"), F.count_if(F.col("new").isNull()).alias("departed"))
    return out.join(F.broadcast(last), F.col("snap") <= F.col("last")).select("snap", "active", "entered", "departed")


def window_cut(g: TemporalGraph, bounds: DataFrame, place: DataFrame, core: DataFrame | None = None) -> DataFrame:
    """snap, cut: edges of a window between parts of ``place`` (snap, v, part); edges at a vertex of ``core`` (snap, v), which all parts hold, aren't cut."""
    p = place.select("snap", "v", "part")
    if core is not None:
        p = p.join(core.select("snap", "v"), ["snap", "v"], "left_anti")
    e = window_edges(g, bounds).join(p.withColumnsRenamed({"v": "src", "part": "ps"}), ["snap", "src"]).join(p.withColumnsRenamed({"v": "dst", "part": "pd"}), ["snap", "dst"])
    cut = e.groupBy("snap").agg(F.count_if(F.col("ps") != F.col("pd")).alias("cut"))
    return bounds.select("snap").join(cut, "snap", "left").fillna(0)


def window_core(g: TemporalGraph, bounds: DataFrame, quantile: float = 0.9) -> DataFrame:
    """snap, v: vertices with the most edges in a window, from the quantile of its active ones on."""
    count = both_ways(window_edges(g, bounds), "snap").groupBy("snap", F.col("a").alias("v")).agg(F.count("*").alias("c"))
    limit = count.groupBy("snap").agg(F.percentile("c", quantile).alias("q"))
    return count.join(F.broadcast(limit), "snap").where("c >= q").select("snap", "v")


def active_migration(place: DataFrame, parts: int) -> DataFrame:
    """snap, both, moved: vertices that a window shares with the one before, and those on another part, part numbers matched first.

    Up to 6 parts the best of all renamings is taken, beyond each part's greatest overlap; what is compared are D * D sums a window.
    """
    old = place.select((F.col("snap") + 1).alias("snap"), "v", F.col("part").alias("p"))
    over = place.select("snap", "v", F.col("part").alias("q")).join(old, ["snap", "v"]).groupBy("snap", "q", "p").agg(F.count("*").alias("c"))
    total = over.groupBy("snap").agg(F.sum("c").alias("both"))
    if parts <= 6:
        names = [(i, q, p) for i, t in enumerate(permutations(range(parts))) for q, p in enumerate(t)]
        s = over.join(F.broadcast(place.sparkSession.createDataFrame(names, "perm long, q long, p long")), ["q", "p"]).groupBy("snap", "perm").agg(F.sum("c").alias("kept"))
        best = s.groupBy("snap").agg(F.max("kept").alias("kept"))
    else:
        best = over.groupBy("snap", "q").agg(F.max("c").alias("c")).groupBy("snap").agg(F.sum("c").alias("kept"))
    return total.join(best, "snap", "left").select("snap", "both", (F.col("both") - F.coalesce("kept", F.lit(0))).alias("moved"))


def sliding_incremental(g: TemporalGraph, bounds: DataFrame, parts: int, cap: float = 1.1, rounds: int = 2) -> DataFrame:
    """snap, v, part for each window in turn: vertices that stay keep their part, those that enter take the vote of their neighbours while it has room.

    A part has room up to ``cap`` times the mean; who is over takes the emptiest parts in turn. Each window is one pass of joins over its edges.
    """
    active = kept(window_active(g, bounds), "active")
    edges = kept(window_edges(g, bounds), "window-edges")
    prior, out = None, None
    for (s,) in bounds.select("snap").orderBy("snap").collect():
        here = active.where(F.col("snap") == s).select("v", "local")
        now = here.join(prior, "v", "left") if prior is not None else here.withColumn("part", F.lit(None).cast("long"))
        now = now.select("v", "local", F.col("part").alias("old"), F.coalesce("part", F.col("local") % parts).alias("part"))
        near = both_ways(edges.where(F.col("snap") == s)).where("a <> b")
        for _ in range(rounds if prior is not None else 0):
            votes = near.join(now.where("old IS NULL").select(F.col("v").alias("a")), "a", "left_semi").join(now.select(F.col("v").alias("b"), "part"), "b").groupBy("a", "part").agg(F.count("*").alias("c"))
            best = votes.groupBy("a").agg(F.min(F.struct((-F.col("c")).alias("c"), "part")).alias("m")).select(F.col("a").alias("v"), F.col("m.part").alias("to"))
            now = kept(now.join(best, "v", "left").select("v", "local", "old", F.when(F.col("old").isNull(), F.coalesce("to", "part")).otherwise(F.col("part")).alias("part")), "window-place")
        place = now.select("v", "part", F.col("old").isNull().alias("free"))
        from .greedy import _spilled

        n = here.count()
        place = kept(_spilled(place, parts, int(cap * n / parts) + 1), "window-place")
        prior = place.select("v", "part")
        one = prior.select(F.lit(s).alias("snap"), "v", "part")
        out = one if out is None else out.unionAll(one)
    return out


def footprint(g: TemporalGraph, place: DataFrame, parts: int, weight: float) -> DataFrame:
    """part, load: vertices and ``weight`` times the edge ends at them, to the nearest whole number."""
    inc = degree(g).join(place.select("v", "part"), "v").groupBy("part").agg(F.count("*").alias("nodes"), F.sum("deg").alias("incident"))
    return filled(g, parts, inc).select("part", F.floor(F.col("nodes") + weight * F.col("incident") + 0.5).alias("load"))


def caps_of(shares: list[int], total: float, headroom: float = 1.1) -> list[int]:
    """What each device can hold: its share of the total with the headroom, to the nearest whole number."""
    return [int(s / sum(shares) * total * headroom + 0.5) for s in shares]


def feasibility(load: DataFrame, caps: DataFrame) -> DataFrame:
    """feasible, over, pinned_feasible, pinned_over: the most by which loads are over ``caps`` (part, cap), k-th largest on k-th largest, and each on its own.

    One row a part on both sides.
    """
    at = lambda c: F.row_number().over(Window.orderBy(F.desc(c), "part"))
    free = load.select("load", at("load").alias("r")).join(caps.select("cap", at("cap").alias("r")), "r").agg(F.max(F.col("load") - F.col("cap")).alias("x"))
    own = load.join(caps, "part").agg(F.max(F.col("load") - F.col("cap")).alias("y"))
    zero = lambda c: F.greatest(F.lit(0), F.col(c)).cast("long")
    return free.join(own).select((F.col("x") <= 0).alias("feasible"), zero("x").alias("over"), (F.col("y") <= 0).alias("pinned_feasible"), zero("y").alias("pinned_over"))


def rebalanced(g: TemporalGraph, place: DataFrame, parts: int, weight: float, caps: list[float], budget: int) -> DataFrame:
    """v, part: while a part's footprint is over its cap, its hottest vertices move to the part with most room, at most ``budget`` in all.

    A round reads one sum a part and one count for each degree on the full part; the
    vertices that go are all above a degree and, of that degree, the first by id.
    """
    deg = kept(degree(g), "degree")
    now, left = kept(place.select("v", "part").join(deg, "v"), "place"), budget
    for _ in range(4 * parts):
        rows = {r["part"]: r["fp"] for r in now.groupBy("part").agg((F.count("*") + weight * F.sum("deg")).alias("fp")).collect()}
        fp = [float(rows.get(p, 0)) for p in range(parts)]
        full, room = max(range(parts), key=lambda p: fp[p] - caps[p]), max(range(parts), key=lambda p: caps[p] - fp[p])
        over, free = fp[full] - caps[full], caps[room] - fp[room]
        if over <= 0 or left <= 0 or full == room or free <= 0:
            break
        need, moved, last, some = min(over, free), 0, None, 0
        for r in now.where(F.col("part") == full).groupBy("deg").agg(F.count("*").alias("c")).orderBy(F.desc("deg")).collect():
            per = 1.0 + weight * r["deg"]
            last, some = r["deg"], min(r["c"], left - moved, int(-(-need // per)))
            moved, need = moved + some, need - some * per
            if need <= 0 or moved >= left:
                break
        edge = with_position(now.where((F.col("part") == full) & (F.col("deg") == last)).select("v"), ["v"], "i").where(F.col("i") < some).select("v", F.lit(True).alias("goes"))
        go = (F.col("part") == full) & ((F.col("deg") > last) | F.col("goes"))
        now = kept(now.join(edge, "v", "left").select("v", F.when(go, room).otherwise(F.col("part")).cast("long").alias("part"), "deg"), "place")
        left -= moved
    return now.select("v", "part")


def sync_cost(cut_vertices: Column, width: int, snaps: int, link: float) -> tuple[Column, Column]:
    """Seconds a snapshot and in all of keeping the state of cut vertices equal on their devices."""
    per = cut_vertices * width * 4 / (link * 1e9)
    return per, per * snaps


def temporal_sync(g: TemporalGraph, snaps: int, parts: int, width: int, link: float) -> DataFrame:
    """cut, per_snap_ms, total_ms: vertices active in several of ``parts`` blocks of time, and the cost of their state."""
    from .supra import active

    k = active(g, snaps).groupBy("v").agg(F.count_distinct(F.expr(f"snap * {parts} div {snaps}")).alias("k")).agg(F.count_if(F.col("k") > 1).alias("cut"))
    per, total = sync_cost(F.col("cut"), width, snaps, link)
    return k.select("cut", F.round(per * 1e3, 9).alias("per_snap_ms"), F.round(total * 1e3, 9).alias("total_ms"))
