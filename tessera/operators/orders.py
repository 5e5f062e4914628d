"""Orders and groups of vertices or cells, and placements that come from them."""

from __future__ import annotations

import heapq
import math

import numpy as np
from pyspark.ml.clustering import KMeans, PowerIterationClustering
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.position import with_position
from ..functions.scratch import kept
from ..sources.graphs import TemporalGraph
from . import supra as G
from .metrics import block_matrix
from .multilevel import exchanged
from .placement import split
from .stats import degree
from .supra import both_ways


def degeneracy_order(core: DataFrame) -> DataFrame:
    """v, rank in the order of (core, v)."""
    return with_position(core.select("core", "v"), ["core", "v"], "rank").select("v", "rank")


def hub_order(g: TemporalGraph, share: float = 0.001, rounds: int | None = None) -> DataFrame:
    """v, rank: in each round the ``share`` of all vertices with most edges to those left go to the front; what is left after the last, by its edges, behind them.

    To the end without ``rounds``, which is 1 / share of them.
    """
    sym = kept(both_ways(g.edges).where("a <> b").groupBy("a", "b").agg(F.count("*").alias("w")), "sym")
    k, left, out = max(1, int(g.num_nodes * share)), kept(g.vertices().select("v"), "left"), None
    count, done = g.num_nodes, 0

    def ranked(left: DataFrame) -> DataFrame:
        near = sym.join(left.withColumnRenamed("v", "a"), "a", "left_semi").join(left.withColumnRenamed("v", "b"), "b", "left_semi").groupBy(F.col("a").alias("v")).agg(F.sum("w").alias("d"))
        return with_position(left.join(near, "v", "left").fillna(0, ["d"]), [F.desc("d"), F.asc("v")], "i")

    while count and (rounds is None or rounds > 0):
        r = ranked(left)
        top = r.where(F.col("i") < k).select("v", (F.col("i") + done).alias("rank"))
        out = top if out is None else out.unionAll(top)
        left = kept(r.where(F.col("i") >= k).select("v"), "left")
        done, count, rounds = done + min(k, count), count - min(k, count), rounds if rounds is None else rounds - 1
    rest = ranked(left).select("v", (F.col("i") + done).alias("rank"))
    return rest if out is None else out.unionAll(rest)


def dense_labels(labels: DataFrame) -> DataFrame:
    """v, label with labels numbered from 0 in their order."""
    ids = with_position(labels.select("label").distinct(), ["label"], "new")
    return labels.join(ids, "label").select("v", F.col("new").alias("label"))


def rank_blocks(rank: DataFrame, n: int, parts: int, caps: list[int] | None = None) -> DataFrame:
    """v, part: a placement from scratch, the ranks (v, rank) cut into equal blocks, or blocks of ``caps`` vertices with the rest in the last."""
    if caps is None:
        return rank.select("v", F.expr(f"rank * {parts} div {max(1, n)}").alias("part"))
    ends = np.cumsum(caps)[:-1].tolist()
    return rank.select("v", sum((F.when(F.col("rank") >= e, 1).otherwise(0) for e in ends), F.lit(0)).cast("long").alias("part"))


def by_attribute(attr: DataFrame, n: int, parts: int) -> DataFrame:
    """v, part: vertices (v, attr) in the order of their attribute, cut into equal blocks."""
    per = max(1, math.ceil(n / parts))
    return with_position(attr.select("v", "attr"), ["attr", "v"], "r").select("v", F.least(F.expr(f"r div {per}"), F.lit(parts - 1)).cast("long").alias("part"))


def categorical(g: TemporalGraph, groups: DataFrame, values: int, rho: float, seed: int = 0) -> DataFrame:
    """v, attr: of ``values`` values, that of the vertex's group (v, grp) for a share |rho| of vertices, by a hash; negative rho shifts it away."""
    h = lambda k: F.pmod(F.xxhash64("v", F.lit(seed + k)), F.lit(1_000_000))
    base, other = F.col("grp") % values, h(1) % values
    own = base if rho >= 0 else (base + 1 + h(2) % max(1, values - 1)) % values
    return groups.select("v", F.when(h(0) < abs(rho) * 1_000_000, own).otherwise(other).cast("long").alias("attr"))


def by_memory(g: TemporalGraph, parts: int, shares: list[int] | None = None) -> DataFrame:
    """v, part, work: the order of degrees cut by the bytes that a vertex takes, its feature row's and 20 for each edge end."""
    work = degree(g).join(g.vertices(), "v").select("v", "deg", (F.col("fv") * 4 + 20 * F.col("deg")).alias("work"))
    return split(work, [F.desc("deg"), F.asc("v")], parts, shares)


def filled_by_time(sizes: list[tuple[int, int]], speeds: list[float]) -> list[list[int]]:
    """For each (size, count), in turn: how many each bin gets if every item goes to the bin that is free first, ties to the first bin.

    Per size in closed form: bins fill up to one time, and the few items around it are placed one by one. Times come
    from whole sums, so no order of adding decides; an item without size counts as 1e-9.
    """
    d, work, empty, out = len(speeds), [0] * len(speeds), [0] * len(speeds), []
    for size, count in sizes:
        at = lambda p, k: (work[p] + k * size + 1e-9 * empty[p] if size else work[p] + 1e-9 * (empty[p] + k)) / speeds[p]  # noqa: B023, E731
        got = [0] * d
        if count > 4 * d * d:
            # The time at which the bins, filled like water, have taken all.
            step, t = [(size or 1e-9) / s for s in speeds], [at(p, 0) for p in range(d)]
            order, rate, held, level = sorted(range(d), key=t.__getitem__), 0.0, 0.0, 0.0
            for i, p in enumerate(order):
                rate, held = rate + 1 / step[p], held + t[p] / step[p]
                level = (count + held) / rate
                if i + 1 == d or level <= t[order[i + 1]]:
                    break
            got = [max(0, int((level - t[p]) / step[p]) - d) for p in range(d)]
        heap = [(at(p, got[p]), p) for p in range(d)]
        heapq.heapify(heap)
        for _ in range(count - sum(got)):
            _, p = heapq.heappop(heap)
            got[p] += 1
            heapq.heappush(heap, (at(p, got[p]), p))
        for p in range(d):
            work[p], empty[p] = work[p] + got[p] * size, empty[p] + got[p] * (not size)
        out.append(got)
    return out


def packed_by_work(work: DataFrame, speeds: list[float]) -> DataFrame:
    """v, work, part: by falling work, each to the part that is free first; planned on the counts of equal work, one row of them each on the driver."""
    spark = work.sparkSession
    counts = work.groupBy("work").agg(F.count("*").alias("c")).orderBy(F.desc("work")).collect()
    spans, first, base = [], [], 0
    for r, got in zip(counts, filled_by_time([(r["work"], r["c"]) for r in counts], speeds), strict=True):
        first.append((r["work"], base))
        at, base = 0, base + r["c"]
        for p, k in enumerate(got):
            if k:
                spans.append((r["work"], at, at + k, p))
                at += k
    s = spark.createDataFrame(spans, "work long, lo long, hi long, part long")
    ranked = with_position(work.select("v", "work"), [F.desc("work"), F.asc("v")], "r").join(spark.createDataFrame(first, "work long, base long"), "work").withColumn("i", F.col("r") - F.col("base"))
    return ranked.join(s, "work").where((F.col("i") >= F.col("lo")) & (F.col("i") < F.col("hi"))).select("v", "work", "part")


def by_clusters(g: TemporalGraph, labels: DataFrame, parts: int) -> DataFrame:
    """v, part: whole clusters (v, label), by falling sum of degree times width, each to the part with the least of it."""
    w = degree(g).join(g.vertices(), "v").join(labels, "v").groupBy("label").agg(F.sum(F.col("deg") * F.col("fv")).alias("work"))
    home = packed_by_work(w.select(F.col("label").alias("v"), "work"), [1.0] * parts)
    return labels.join(home.select(F.col("v").alias("label"), "part"), "label").select("v", "part")


def merged_blocks(g: TemporalGraph, blocks: DataFrame, parts: int, slack: float = 1.1) -> DataFrame:
    """v, part: many small blocks (v, part) joined two by two, those with most edges between them first, under a cap, until ``parts`` are left.

    The driver gets the blocks' sizes and the edges between them: K and K * K numbers for K blocks, K being a small multiple of ``parts``.
    """
    spark = g.spark
    size = {r["part"]: r["c"] for r in blocks.groupBy("part").agg(F.count("*").alias("c")).collect()}
    cap, groups = slack * sum(size.values()) / parts, {k: [k] for k in sorted(size)}
    w = {(r["bi"], r["bj"]): r["w"] for r in block_matrix(g, blocks).where("bi <> bj").collect()}
    while len(groups) > parts:
        pairs = [(i, j) for i in groups for j in groups if i < j]
        fit = [p for p in pairs if size[p[0]] + size[p[1]] <= cap]
        i, j = max(fit, key=lambda p: (w.get(p, 0), -p[0], -p[1])) if fit else min(pairs, key=lambda p: (size[p[0]] + size[p[1]], p))
        groups[i] += groups.pop(j)
        size[i] += size.pop(j)
        for k in groups:
            if k != i:
                a, b = (min(i, k), max(i, k)), (min(j, k), max(j, k))
                w[a] = w.get(a, 0) + w.pop(b, 0)
    names = spark.createDataFrame([(k, at) for at, ks in enumerate(groups.values()) for k in ks], "part long, to long")
    return blocks.join(F.broadcast(names), "part").select("v", F.col("to").alias("part"))


def cell_pairs(g: TemporalGraph, cell: DataFrame, snaps: int, w_space: int, w_time: int) -> DataFrame:
    """a, b, w of cells, both ways."""
    p = G.spatial_pairs(g, cell, snaps).select("a", "b", F.lit(w_space).cast("long").alias("w")).unionAll(G.temporal_pairs(cell).select("a", "b", F.lit(w_time).cast("long").alias("w")))
    return p.unionAll(p.select(F.col("b").alias("a"), F.col("a").alias("b"), "w")).groupBy("a", "b").agg(F.sum("w").alias("w"))


def supra_chunks(g: TemporalGraph, snaps: int, w_space: int = 2, w_time: int = 1, rank: DataFrame | None = None, rounds: int = 2) -> DataFrame:
    """cell_id, v, snap, chunk: cells by the chunk of most weight around them, from runs of the rank (v, rank; ids without one), as many as the root of the cells' number."""
    cell = kept(G.cells(g, snaps), "cells")
    n = cell.count()
    chunks = max(1, int(n**0.5))
    ranked = cell.join(rank, "v") if rank is not None else cell.withColumn("rank", F.col("v"))
    now = ranked.select("cell_id", F.expr(f"rank * {chunks} div {max(1, g.num_nodes)}").alias("chunk"))
    near = kept(cell_pairs(g, cell, snaps, w_space, w_time), "pairs")
    for _ in range(rounds):
        votes = near.join(now.withColumnRenamed("cell_id", "b"), "b").groupBy("a", "chunk").agg(F.sum("w").alias("s"))
        best = votes.groupBy("a").agg(F.min(F.struct((-F.col("s")).alias("s"), "chunk")).alias("m")).select(F.col("a").alias("cell_id"), F.col("m.chunk").alias("to"))
        now = kept(now.join(best, "cell_id", "left").select("cell_id", F.coalesce("to", "chunk").alias("chunk")), "chunks")
    return cell.join(now, "cell_id").select("cell_id", "v", "snap", "chunk")


def by_chunks(g: TemporalGraph, snaps: int, speeds: list[float], w_space: int = 2, w_time: int = 1, tolerance: float = 1.10) -> DataFrame:
    """v, part: chunks of cells on parts by their speeds, exchanged while the weight between parts falls and no part is over ``tolerance`` times its share; a vertex follows most of its cells' weight.

    The chunks are the vertices of a graph of their own: they begin in runs of their order, cut at the parts' shares.
    """
    c = kept(supra_chunks(g, snaps, w_space, w_time), "chunks")
    pair = kept(cell_pairs(g, c.select("cell_id", "v", "snap"), snaps, w_space, w_time), "pairs")
    own = kept(c.join(pair.groupBy(F.col("a").alias("cell_id")).agg(F.sum("w").alias("w")), "cell_id", "left").fillna(0, ["w"]), "weights")
    work = kept(own.groupBy(F.col("chunk").alias("v")).agg(F.sum("w").alias("work")), "work")
    x, y = c.select(F.col("cell_id").alias("a"), F.col("chunk").alias("x")), c.select(F.col("cell_id").alias("b"), F.col("chunk").alias("y"))
    e = kept(pair.join(x, "a").join(y, "b").where("x < y").groupBy(F.col("x").alias("a"), F.col("y").alias("b")).agg(F.sum("w").alias("w")), "chunk-edges")
    total = work.agg(F.sum("work")).first()[0] or 0
    start = split(work, [F.asc("v")], len(speeds), [max(1, round(1000 * s / max(speeds))) for s in speeds]).select("v", F.col("work").alias("w"), "part")
    home = exchanged(e, start, len(speeds), [tolerance * total * s / sum(speeds) for s in speeds]).select(F.col("v").alias("chunk"), "part")
    votes = own.join(home, "chunk").groupBy("v", "part").agg(F.sum("w").alias("w"))
    best = votes.groupBy("v").agg(F.min(F.struct((-F.col("w")).alias("w"), "part")).alias("m")).select("v", F.col("m.part").alias("part"))
    return g.vertices().select("v").join(best, "v", "left").select("v", F.coalesce("part", F.pmod("v", F.lit(len(speeds)))).cast("long").alias("part"))


def feature_clusters(features: DataFrame, k: int, seed: int = 0, rounds: int = 25) -> DataFrame:
    """v, label: k-means of the vectors (v, c, x), each component once a vertex."""
    x = features.groupBy("v").agg(F.sort_array(F.collect_list(F.struct("c", "x"))).alias("r")).select("v", array_to_vector(F.col("r.x").cast("array<double>")).alias("features"))
    return KMeans(k=k, seed=seed, maxIter=rounds).fit(x).transform(x).select("v", F.col("prediction").cast("long").alias("label"))


def spectral_parts(g: TemporalGraph, parts: int, rounds: int = 20) -> DataFrame:
    """v, part by power iteration on the edges' weights and k-means of what it converges to; isolated vertices to the part with fewest."""
    e = g.edges.where("src <> dst").groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.count("*").cast("double").alias("weight"))
    pic = PowerIterationClustering(k=parts, maxIter=rounds, initMode="degree", srcCol="src", dstCol="dst", weightCol="weight")
    got = kept(pic.assignClusters(e).select(F.col("id").alias("v"), F.col("cluster").cast("long").alias("part")), "spectral")
    load = {r["part"]: r["c"] for r in got.groupBy("part").agg(F.count("*").alias("c")).collect()}
    least = min(range(parts), key=lambda p: (load.get(p, 0), p))
    return g.vertices().select("v").join(got, "v", "left").select("v", F.coalesce("part", F.lit(least)).cast("long").alias("part"))


def undirected(edges: DataFrame) -> DataFrame:
    """src < dst, each pair once; loops go."""
    return edges.where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()


def prefix_cut(g: TemporalGraph, snaps: int, parts: int, percents: tuple[int, ...], rank_of) -> DataFrame:
    """pct, seen, cut, peek_cut: vertices placed by an order of the first ``pct`` % of snapshots alone, unseen ones on part 0, against the order of all of it.

    ``rank_of`` gives (v, rank) of a graph; cuts are those of all edges.
    """
    from .metrics import placed

    def blocks(upto: int) -> DataFrame:
        e = g.edges.where(F.expr(f"least(pos * {snaps} div {max(1, g.num_edges)}, {snaps - 1})") < upto)
        some = TemporalGraph(e, g.num_nodes, g.num_edges, f"{g.name}-{upto}")
        seen = e.select(F.explode(F.array("src", "dst")).alias("v")).distinct()
        r = kept(with_position(rank_of(some).join(seen, "v", "left_semi"), ["rank", "v"], "i"), "seen")
        n = r.count()
        return g.vertices().select("v").join(r, "v", "left").select("v", F.coalesce(F.expr(f"i * {parts} div {max(1, n)}"), F.lit(0)).cast("long").alias("part"), F.col("i").isNotNull().alias("seen"))

    cut = lambda p: placed(g, p).agg(F.count_if(F.col("ps") != F.col("pd")).alias("cut")).first()["cut"]
    peek, rows = cut(blocks(snaps)), []
    for pct in percents:
        p = kept(blocks(min(snaps, max(1, round(snaps * pct / 100)))), "prefix")
        rows.append((pct, p.where("seen").count(), cut(p), peek))
    return g.spark.createDataFrame(rows, "pct long, seen long, cut long, peek_cut long")
