"""Lambda2 of many graphs at once, and the sweep cut along its vector.

A table of edges keyed by graph (a snapshot, say) is one matrix of blocks. Each
round multiplies all of them with one join and one sum, takes every graph's
inner products in one aggregation, and mixes each graph's vectors by its own
few numbers; graphs that have settled keep theirs. The driver sees a row of
inner products a graph, never a vector.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.position import with_position
from ..functions.scratch import kept
from ..sources.graphs import TemporalGraph
from .supra import both_ways
from .temporal import with_snap

#: A residual below this leaves lambda2 right to three digits and more.
SETTLED = 2e-5


def weights(edges: DataFrame, *keys: str) -> DataFrame:
    """keys, a, b, w both ways, loops left out."""
    return both_ways(edges, *keys).where("a <> b").groupBy(*keys, "a", "b").agg(F.count("*").alias("w"))


def gaps(sym: DataFrame, rounds: int = 200) -> tuple[DataFrame, DataFrame]:
    """k, lambda2, vol; and k, v, d, x, the vector of each graph of ``sym`` (k, a, b, w both ways), x being over the root of d.

    The normalised Laplacian's least eigenvalue off the leading vector: 0 for a graph in pieces. An error if one hasn't settled after ``rounds``.
    """
    spark = sym.sparkSession
    sym = kept(sym, "sym")
    deg = kept(sym.groupBy("k", F.col("a").alias("v")).agg(F.sum("w").alias("d")), "deg")
    vol = deg.groupBy("k").agg(F.sum("d").alias("vol"))
    da, db = deg.select("k", F.col("v").alias("a"), F.col("d").alias("da")), deg.select("k", F.col("v").alias("b"), F.col("d").alias("db"))
    half = kept(sym.join(da, ["k", "a"]).join(db, ["k", "b"]).select("k", "a", "b", (F.col("w") / F.sqrt(F.col("da") * F.col("db"))).alias("w")), "walk")

    def times(state: DataFrame, x: str) -> DataFrame:
        """With the product of (I + A) / 2 and a column: no eigenvalue is below 0, and lambda2's is the greatest but one."""
        y = half.join(state.select("k", F.col("v").alias("b"), x), ["k", "b"]).groupBy("k", F.col("a").alias("v")).agg(F.sum(F.col("w") * F.col(x)).alias("y"))
        return kept(state.join(y, ["k", "v"], "left").withColumn(f"m{x}", (F.col(x) + F.coalesce("y", F.lit(0.0))) / 2).drop("y"), "power")

    def dots(state: DataFrame, pairs: list[tuple[str, str]]) -> dict[int, np.ndarray]:
        return {r["k"]: np.array(r[1:], float) for r in state.groupBy("k").agg(*[F.sum(F.col(a) * F.col(b)).alias(f"d{i}") for i, (a, b) in enumerate(pairs)]).collect()}

    def by_graph(rows: dict[int, tuple[float, ...]], names: list[str]) -> DataFrame:
        return F.broadcast(spark.createDataFrame([(int(k), *map(float, c)) for k, c in rows.items()], "k long, " + ", ".join(f"{n} double" for n in names)))  # a row a graph

    start = deg.join(F.broadcast(vol), "k").select("k", "v", F.sqrt(F.col("d") / F.col("vol")).alias("u"), F.sin(F.col("v") * 1.7 + 1.0).alias("x"))
    state = kept(start, "power")
    for _ in range(2):  # twice, as the first leaves a rest of the leading vector
        off = dots(state, [("u", "x")])
        state = kept(state.join(by_graph({k: (d[0],) for k, d in off.items()}, ["c"]), "k").select("k", "v", "u", (F.col("x") - F.col("c") * F.col("u")).alias("x")), "power")
    state = times(state, "x").withColumns({"p": F.lit(0.0), "mp": F.lit(0.0)})
    norm = {k: (d[0] ** -0.5 if d[0] > 1e-20 else 0.0,) for k, d in dots(state, [("x", "x")]).items()}
    state = kept(state.join(by_graph(norm, ["c"]), "k").withColumns({z: F.col("c") * F.col(z) for z in ("x", "mx")}).drop("c"), "power")
    found = {k: (d[1] - d[2] ** 2, d[2]) for k, d in dots(state, [("x", "x"), ("x", "mx"), ("u", "x")]).items()}
    basis, n = ("x", "r", "p"), 3
    open_, settled = {k for k, (c,) in norm.items() if c}, False
    for turn in range(rounds):
        if not open_:
            settled = True
            break
        state = state.join(by_graph({k: x for k, x in found.items()}, ["value", "ux"]), "k")
        state = times(state.withColumn("r", F.col("mx") - F.col("ux") * F.col("u") - F.col("value") * F.col("x")).drop("value", "ux"), "r")
        some = dots(state, [(a, b) for a in basis for b in basis] + [(a, f"m{b}") for a in basis for b in basis] + [("u", a) for a in basis])
        mix = {}
        for k, s in some.items():
            mix[k] = (1.0, 0.0, 0.0)
            gram, prod, lead = s[:9].reshape(n, n), s[9:18].reshape(n, n), s[18:]
            if k not in open_ or gram[1, 1] ** 0.5 < SETTLED:
                open_.discard(k)
                continue
            size = np.sqrt(np.maximum(np.diag(gram), 1e-300))
            use = np.diag(gram) > 1e-28
            g, m = (gram / np.outer(size, size))[np.ix_(use, use)], (((prod + prod.T) / 2 - np.outer(lead, lead)) / np.outer(size, size))[np.ix_(use, use)]
            e, q = np.linalg.eigh(g)
            q = q[:, e > 1e-12] / np.sqrt(e[e > 1e-12])
            e, c = np.linalg.eigh(q.T @ m @ q)
            whole = np.zeros(n)
            whole[use] = (q @ c[:, -1]) / size[use]
            found[k], mix[k] = (float(e[-1]), float(whole @ lead)), tuple(whole)
        c = [F.col(f"c{i}") for i in range(n)]
        state = state.join(by_graph(mix, ["c0", "c1", "c2"]), "k")
        still = F.col("c1") == 0
        made = {m + z: F.when(still, F.col(m + z)).otherwise(v) for m in ("", "m") for z, v in (("x", sum(ci * F.col(m + b) for ci, b in zip(c, basis, strict=True))), ("p", c[1] * F.col(m + "r") + c[2] * F.col(m + "p")))}
        state = state.select("k", "v", "u", *[v.alias(z) for z, v in made.items()])
        if turn % 2:
            state = kept(state, "power")
    if not settled and open_:
        raise RuntimeError(f"lambda2 of {len(open_)} graphs has not settled in {rounds} rounds")
    lam = spark.createDataFrame([(int(k), float(max(0.0, 2 - 2 * v[0]))) for k, v in found.items()], "k long, lambda2 double")
    vector = kept(state.join(deg, ["k", "v"]).select("k", "v", "d", (F.col("x") / F.sqrt("d")).alias("x")), "vector")
    return lam.join(vol, "k").select("k", "lambda2", "vol"), vector


def sweep(sym: DataFrame, vector: DataFrame) -> DataFrame:
    """v, side of one graph: the prefix of the order of x of least conductance, the first of such; sums run over ranges of the order."""
    order = with_position(vector.select("v", "d", "x"), ["x", "v"], "rank")
    n = order.count()
    if n < 2:
        return order.select("v", F.lit(False).alias("side"))
    ra, rb = order.select(F.col("v").alias("a"), F.col("rank").alias("ra")), order.select(F.col("v").alias("b"), F.col("rank").alias("rb"))
    # Along the order a vertex opens its edges to later ones and closes those to earlier ones.
    turn = sym.join(ra, "a").join(rb, "b").groupBy(F.col("a").alias("v")).agg(F.sum(F.when(F.col("rb") > F.col("ra"), F.col("w")).otherwise(-F.col("w"))).alias("turn"))
    size = max(1, n // int(order.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    d = kept(order.join(turn, "v").select("v", "rank", F.expr(f"rank div {size}").alias("range"), "d", "turn"), "sweep")
    sums = d.groupBy("range").agg(F.sum("d").alias("sd"), F.sum("turn").alias("st"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    base = sums.select("range", *[F.coalesce(F.sum(x).over(before), F.lit(0)).alias(y) for x, y in (("sd", "bd"), ("st", "bt"))])
    w = Window.partitionBy("range").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    total = d.agg(F.sum("d")).first()[0]
    run = d.join(F.broadcast(base), "range").select("rank", (F.col("bd") + F.sum("d").over(w)).alias("vol"), (F.col("bt") + F.sum("turn").over(w)).alias("cut"))
    best = run.where(F.col("rank") < n - 1).agg(F.min(F.struct((F.col("cut") / F.least(F.col("vol"), F.lit(total) - F.col("vol"))).alias("c"), "rank")).alias("m")).first()["m"]
    return d.select("v", (F.col("rank") <= best["rank"]).alias("side"))


def conductance(sym: DataFrame, side: DataFrame) -> DataFrame:
    """cut, vol (of the lesser side), conductance of a bipartition (v, side): recounted from the edges."""
    x, y = side.select(F.col("v").alias("a"), F.col("side").alias("sa")), side.select(F.col("v").alias("b"), F.col("side").alias("sb"))
    j = sym.join(x, "a").join(y, "b")
    s = j.agg((F.sum(F.when(F.col("sa") != F.col("sb"), F.col("w")).otherwise(0)) / 2).cast("long").alias("cut"), F.sum(F.when(F.col("sa"), F.col("w")).otherwise(0)).alias("one"), F.sum("w").alias("all"))
    s = s.select("cut", F.least("one", F.col("all") - F.col("one")).alias("vol"))
    return s.select("cut", "vol", F.round(F.col("cut") / F.col("vol"), 9).alias("conductance"))


def fiedler(g: TemporalGraph, rounds: int = 200) -> tuple[float, DataFrame, DataFrame]:
    """lambda2, the bipartition (v, side) of the sweep along its vector, and its conductance; isolated vertices are in neither side."""
    sym = kept(weights(g.edges), "sym")
    lam, vector = gaps(sym.withColumn("k", F.lit(0).cast("long")), rounds)
    side = kept(sweep(sym, vector), "sides")
    row = lam.first()
    return row["lambda2"] if row else 0.0, side, conductance(sym, side)


def snapshot_gaps(g: TemporalGraph, snaps: int, rounds: int = 200) -> DataFrame:
    """snap, lambda2 (three digits), vol of each snapshot's graph."""
    lam, _ = gaps(weights(with_snap(g, snaps), "snap").withColumnRenamed("snap", "k"), rounds)
    return lam.select(F.col("k").alias("snap"), F.round("lambda2", 3).alias("lambda2"), "vol")


def lower_bound(g: TemporalGraph, snaps: int, parts: int, share: float = 0.5, rounds: int = 200) -> DataFrame:
    """spatial, temporal, total: what any placement on ``parts`` cuts at least, by each snapshot's lambda2 / 2 times half its volume times ``share``, the lesser side's part of it, and by vertices active in several time blocks."""
    from .supra import temporal_bound

    lam, _ = gaps(weights(with_snap(g, snaps), "snap").withColumnRenamed("snap", "k"), rounds)
    spatial = lam.agg(F.sum(F.col("lambda2") / 2 * F.col("vol") / 2 * share).alias("spatial"))
    t = temporal_bound(g, snaps, parts).select((F.col("numerator") / F.greatest(F.col("denominator"), F.lit(1))).alias("temporal"))
    return spatial.join(F.broadcast(t)).select(F.round("spatial", 3).alias("spatial"), F.round("temporal", 6).alias("temporal"), F.round(F.col("spatial") + F.col("temporal"), 3).alias("total"))
