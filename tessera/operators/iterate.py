"""Algorithms in rounds of joins: labels, cores, event depth, spectra.

Each round is one join and one aggregation over an edge table that is written
once; states are written every other round, so a plan stays short and a lost
executor costs a round.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.position import with_position
from ..functions.scratch import kept
from ..sources.graphs import TemporalGraph
from .supra import both_ways


def label_propagation(g: TemporalGraph, rounds: int = 5) -> DataFrame:
    """v, label after synchronous rounds: the commonest label among neighbours, ties to the least; isolated vertices keep theirs."""
    sym = kept(both_ways(g.edges).groupBy("a", "b").agg(F.count("*").alias("w")), "sym")
    labels = g.vertices().select("v", F.col("v").alias("label"))
    for k in range(rounds):
        votes = sym.join(labels.withColumnRenamed("v", "b"), "b").groupBy("a", "label").agg(F.sum("w").alias("c"))
        best = votes.groupBy("a").agg(F.min(F.struct((-F.col("c")).alias("c"), "label")).alias("m")).select(F.col("a").alias("v"), F.col("m.label").alias("new"))
        labels = labels.join(best, "v", "left").select("v", F.coalesce("new", "label").alias("label"))
        if k % 2 or k == rounds - 1:
            labels = kept(labels, "labels")
    return labels


def label_rank(labels: DataFrame) -> DataFrame:
    """v, rank in the order of (label, v)."""
    return with_position(labels, ["label", "v"], "rank").select("v", "rank")


def clusterability(g: TemporalGraph, rank: DataFrame) -> DataFrame:
    """score in [0, 1]: how far edges within round(sqrt N) bands of the order exceed what volumes alone give; numbers are whole until the end."""
    bands = max(1, round(g.num_nodes**0.5))
    b = rank.select("v", F.expr(f"rank * {bands} div {max(1, g.num_nodes)}").alias("band"))
    e = g.edges.join(b.withColumnsRenamed({"v": "src", "band": "x"}), "src").join(b.withColumnsRenamed({"v": "dst", "band": "y"}), "dst")
    inside = e.agg(F.count_if(F.col("x") == F.col("y")).alias("inside"), F.count("*").alias("m"))
    vol = e.select(F.explode(F.array("x", "y")).alias("band")).groupBy("band").agg(F.count("*").alias("c")).agg(F.sum(F.col("c") * F.col("c")).alias("sq"))
    s = inside.join(F.broadcast(vol)).select((F.col("inside") / F.col("m")).alias("w"), (F.col("sq") / (4 * F.col("m") * F.col("m"))).alias("x"))
    return s.select(F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("w") - F.col("x")) / (1 - F.col("x")))), 6).alias("score"))


def coreness(g: TemporalGraph, rounds: int | None = None) -> DataFrame:
    """v, core of the simple graph: each round takes the h-index of the neighbours' values, from degrees down to the fixpoint."""
    sym = kept(both_ways(g.edges).where("a <> b").distinct(), "simple")
    core = g.vertices().select("v").join(sym.groupBy(F.col("a").alias("v")).agg(F.count("*").alias("core")), "v", "left").fillna(0)
    k = 0
    while rounds is None or k < rounds:
        # On the counts of equal values, so that a hub is as many rows as its neighbours have values.
        near = sym.join(core.withColumnRenamed("v", "b"), "b").groupBy("a", "core").agg(F.count("*").alias("c"))
        r = near.withColumn("r", F.sum("c").over(Window.partitionBy("a").orderBy(F.desc("core")).rowsBetween(Window.unboundedPreceding, 0)))
        h = r.groupBy(F.col("a").alias("v")).agg(F.max(F.least("core", "r")).cast("long").alias("h"))
        step = core.join(h, "v", "left").select("v", F.col("core").alias("old"), F.coalesce("h", "core").alias("core"))
        k += 1
        if rounds is None or k % 2 == 0 or k == rounds:
            step = kept(step, "core")
            if rounds is None and step.where("old <> core").limit(1).count() == 0:
                return step.select("v", "core")
        core = step.select("v", "core")
    return core


def event_ears(edges: DataFrame) -> DataFrame:
    """pos, ear: the latest earlier event that shares an end, -1 if none; an event isn't its own."""
    ends = edges.select("pos", F.explode(F.array_distinct(F.array("src", "dst"))).alias("v"))
    last = ends.withColumn("last", F.lag("pos").over(Window.partitionBy("v").orderBy("pos")))
    return last.groupBy("pos").agg(F.coalesce(F.max("last"), F.lit(-1)).alias("ear"))


def event_depth(ears: DataFrame, max_rounds: int = 40) -> DataFrame:
    """pos, depth: steps along ears to an event without one, by doubling the step each round."""
    state = kept(ears.select("pos", F.col("ear").alias("up"), F.when(F.col("ear") < 0, 0).otherwise(1).cast("long").alias("depth")), "depth")
    for _ in range(max_rounds):
        if state.where("up >= 0").limit(1).count() == 0:
            break
        far = state.select(F.col("pos").alias("up"), F.col("up").alias("up2"), F.col("depth").alias("more"))
        state = kept(state.join(far, "up", "left").select("pos", F.when(F.col("up") < 0, -1).otherwise(F.col("up2")).alias("up"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")), "depth")
    return state.select("pos", "depth")


def changed_cone(edges: DataFrame, since: int) -> DataFrame:
    """v: ends of events from position ``since`` on."""
    return edges.where(F.col("pos") >= since).select(F.explode(F.array("src", "dst")).alias("v")).distinct()


def breadth_first(g: TemporalGraph, root: int | None = None, restart: bool = False) -> DataFrame:
    """v, level from the vertex of highest degree (or ``root``), to the last level; vertices out of reach are left out.

    With ``restart`` every other component has its levels too, from its first vertex in the
    cyclic order of ids after the root, and a column root tells the components apart.
    """
    sym = kept(both_ways(g.edges).where("a <> b").distinct(), "simple")
    if root is None:
        top = sym.groupBy("a").agg(F.count("*").alias("c")).orderBy(F.desc("c"), "a").first()
        root = top["a"] if top else 0
    if restart:
        n = max(1, g.num_nodes)
        turn = kept(g.vertices().select("v", F.expr(f"(v - {root} + {n}) % {n}").alias("turn")), "turn")
        while True:
            near = sym.join(turn.withColumnRenamed("v", "b"), "b").groupBy(F.col("a").alias("v")).agg(F.min("turn").alias("near"))
            step = kept(turn.join(near, "v", "left").select("v", F.least("turn", "near").alias("turn"), (F.col("near") < F.col("turn")).alias("less")), "turn")
            turn = step.select("v", "turn")
            if step.where("less").limit(1).count() == 0:
                break
        front = kept(turn.where(F.col("turn") == F.expr(f"(v - {root} + {n}) % {n}")).select("v", F.lit(0).cast("long").alias("level"), F.col("v").alias("root")), "front")
    else:
        front = g.spark.createDataFrame([(root, 0, root)], "v long, level long, root long")
    seen, before, k = front, front.limit(0), 0
    while True:
        k += 1
        # Neighbours of a level are in it, the one before or the next.
        new = sym.join(front.withColumnRenamed("v", "a"), "a").select(F.col("b").alias("v"), "root").distinct()
        new = new.join(front.select("v").unionAll(before.select("v")), "v", "left_anti").select("v", F.lit(k).cast("long").alias("level"), "root")
        before, front = front, kept(new, "front")
        if front.limit(1).count() == 0:
            break
        seen = seen.unionAll(front)
        if k % 16 == 0:
            seen = kept(seen, "seen")
    return seen if restart else seen.drop("root")


def spectral_gap(g: TemporalGraph, rounds: int = 200) -> DataFrame:
    """lambda2 of the normalised Laplacian off the leading vector, rounded to 3 digits; half of it bounds conductance from below.

    Each round takes the best vector of the span of the last one, its residual and the last
    step, until the residual is below the printed digits; an error if it isn't after ``rounds``.
    """
    sym = kept(both_ways(g.edges).where("a <> b").groupBy("a", "b").agg(F.count("*").alias("w")), "sym")
    deg = kept(sym.groupBy(F.col("a").alias("v")).agg(F.sum("w").alias("d")), "deg")
    half = kept(sym.join(deg.withColumnsRenamed({"v": "a", "d": "da"}), "a").join(deg.withColumnsRenamed({"v": "b", "d": "db"}), "b").select("a", "b", (F.col("w") / F.sqrt(F.col("da") * F.col("db"))).alias("w")), "walk")
    vol = deg.agg(F.sum("d")).first()[0] or 1

    def times(state: DataFrame, x: str) -> DataFrame:
        """With the product of (I + A) / 2 and a column: the same order of eigenvalues and none below 0."""
        y = half.join(state.select(F.col("v").alias("b"), x), "b").groupBy(F.col("a").alias("v")).agg(F.sum(F.col("w") * F.col(x)).alias("y"))
        return kept(state.join(y, "v", "left").withColumn(f"m{x}", (F.col(x) + F.coalesce("y", F.lit(0.0))) / 2).drop("y"), "power")

    def dots(state: DataFrame, pairs: list[tuple[str, str]]) -> list[float]:
        return [z or 0.0 for z in state.agg(*[F.sum(F.col(a) * F.col(b)) for a, b in pairs]).first()]

    start = deg.select("v", F.sqrt(F.col("d") / vol).alias("u"), F.sin(F.col("v") + 1.0).alias("x"))
    off = dots(start, [("u", "x")])[0]
    state = times(start.withColumn("x", F.col("x") - off * F.col("u")), "x").withColumns({"p": F.lit(0.0), "mp": F.lit(0.0)})
    xx, xm, ux = dots(state, [("x", "x"), ("x", "mx"), ("u", "x")])
    value, basis = 0.0, ["x", "r"]
    if xx > 1e-20:
        state = state.withColumns({c: F.col(c) / xx**0.5 for c in ("x", "mx")})
        ux /= xx**0.5
        value = xm / xx - ux * ux
        for _ in range(rounds):
            state = times(state.withColumn("r", F.col("mx") - ux * F.col("u") - value * F.col("x")), "r")
            n = len(basis)
            some = dots(state, [(a, b) for a in basis for b in basis] + [(a, f"m{b}") for a in basis for b in basis] + [("u", a) for a in basis])
            gram, prod, lead = np.array(some[: n * n]).reshape(n, n), np.array(some[n * n : 2 * n * n]).reshape(n, n), np.array(some[2 * n * n :])
            if gram[1, 1] ** 0.5 < 2e-5:
                break
            size = np.sqrt(np.maximum(np.diag(gram), 1e-300))
            gram, prod = gram / np.outer(size, size), (prod + prod.T) / 2 - np.outer(lead, lead)
            e, q = np.linalg.eigh(gram)
            q = q[:, e > 1e-12] / np.sqrt(e[e > 1e-12])
            e, c = np.linalg.eigh(q.T @ (prod / np.outer(size, size)) @ q)
            value, c = float(e[-1]), (q @ c[:, -1]) / size
            ux = float(c @ lead)
            mix = lambda k, m: sum(float(z) * F.col(m + b) for z, b in zip(c[k:], basis[k:], strict=True))
            state = state.select("v", "u", *[mix(k, m).alias(m + x) for k, x in ((0, "x"), (1, "p")) for m in ("", "m")])
            basis = ["x", "r", "p"]
        else:
            raise RuntimeError(f"lambda2 has not settled in {rounds} rounds")
    lam = max(0.0, 2 - 2 * value)
    return g.spark.createDataFrame([(round(lam, 3), round(lam / 2, 4))], "lambda2 double, conductance_bound double")
