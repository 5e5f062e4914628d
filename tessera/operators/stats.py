"""Exact statistics of temporal graphs; the vertex domain counts, isolated vertices too."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.position import with_position
from ..functions.scratch import kept
from ..sources.graphs import TemporalGraph
from .supra import active, both_ways
from .temporal import with_snap

DIGITS = 9


def degree(g: TemporalGraph) -> DataFrame:
    """v, deg of every vertex; a loop counts twice."""
    d = both_ways(g.edges).groupBy(F.col("a").alias("v")).agg(F.count("*").alias("deg"))
    return g.vertices().select("v").join(d, "v", "left").select("v", F.coalesce("deg", F.lit(0)).alias("deg"))


def degree_stats(g: TemporalGraph) -> DataFrame:
    """avg_degree (E/N), max_degree, deg_p99 (interpolated, cut to a whole number), density E/(N(N-1))."""
    n, e = g.num_nodes, g.num_edges
    return degree(g).agg(
        F.round(F.lit(e / max(1, n)), DIGITS).alias("avg_degree"),
        F.max("deg").alias("max_degree"),
        F.floor(F.percentile("deg", 0.99)).cast("long").alias("deg_p99"),
        F.round(F.lit(e / max(1, n * (n - 1)) if n > 1 else 0.0), DIGITS).alias("density"),
    )


def snap_active_nodes(g: TemporalGraph, snaps: int) -> DataFrame:
    return active(g, snaps).groupBy("snap").agg(F.count("*").alias("nodes"))


def vertex_activity(g: TemporalGraph, snaps: int) -> DataFrame:
    """v, tv: snapshots that an active vertex is in."""
    return active(g, snaps).groupBy("v").agg(F.count("*").alias("tv"))


def persistence(g: TemporalGraph, snaps: int) -> DataFrame:
    """numerator / denominator is the mean over active vertices of (|T_v| - 1) / (S - 1)."""
    return vertex_activity(g, snaps).agg(F.coalesce(F.sum(F.col("tv") - 1), F.lit(0)).cast("long").alias("numerator"), (F.count("*") * (snaps - 1)).cast("long").alias("denominator"))


def feature_homophily(g: TemporalGraph) -> DataFrame:
    """homophily: (corr(F_src, F_dst) + 1) / 2; 1 where the widths don't vary."""
    f = g.vertices()
    e = g.edges.join(f.withColumnsRenamed({"v": "src", "fv": "fs"}), "src").join(f.withColumnsRenamed({"v": "dst", "fv": "fd"}), "dst")
    return e.agg(F.round(F.coalesce((F.corr(F.col("fs").cast("double"), F.col("fd").cast("double")) + 1) / 2, F.lit(1.0)), 6).alias("homophily"))


def graph_stats(g: TemporalGraph, snaps: int) -> DataFrame:
    """One row of the exact counts and ratios."""
    a = active(g, snaps)
    per_snap = a.groupBy("snap").agg(F.count("*").alias("c")).agg(F.round(F.avg("c"), DIGITS).alias("mean_snapshot_nodes"), F.max("c").alias("max_snapshot_nodes"))
    per_v = a.groupBy("v").agg(F.count("*").alias("c")).agg(F.round(F.avg((F.col("c") - 1) / max(1, snaps - 1)), DIGITS).alias("persistence"))
    widths = g.vertices().agg(F.round(F.avg("fv"), DIGITS).alias("feat_dim_mean"), F.max("fv").alias("feat_dim_max"))
    counts = g.spark.range(1).select(F.lit(g.num_nodes).cast("long").alias("num_nodes"), F.lit(g.num_edges).cast("long").alias("num_edges"), F.lit(snaps).cast("long").alias("num_snapshots"))
    out = counts
    for part in (degree_stats(g), per_snap, per_v, widths, feature_homophily(g)):  # one row each
        out = out.join(F.broadcast(part))
    return out


def ingest(g: TemporalGraph, snaps: int, mode: str = "dtdg", compute_stats: bool = True) -> DataFrame:
    """The row that a front end keeps of a graph, of snapshots (dtdg) or events (ctdg); without ``compute_stats`` only what counts give."""
    if mode not in ("dtdg", "ctdg"):
        raise ValueError(f"mode {mode!r}: dtdg or ctdg")
    if compute_stats:
        return graph_stats(g, snaps)
    n, e = g.num_nodes, g.num_edges
    return g.vertices().agg(F.round(F.avg("fv"), DIGITS).alias("feat_dim_mean"), F.max("fv").alias("feat_dim_max")).select(
        F.lit(n).cast("long").alias("num_nodes"), F.lit(e).cast("long").alias("num_edges"), F.round(F.lit(e / max(1, n)), DIGITS).alias("avg_degree"),
        F.round(F.lit(e / max(1, n * (n - 1)) if n > 1 else 0.0), DIGITS).alias("density"), "feat_dim_mean", "feat_dim_max",
    )


def gini(values: DataFrame, column: str) -> DataFrame:
    """gini of a column of non-negative numbers: 2 * sum(rank * x) / (n * sum(x)) - (n + 1) / n; 0 if all are 0.

    Ranks are taken on the counts of equal numbers, one row each, so no task has all vertices of a degree.
    """
    h = values.groupBy(F.col(column).alias("x")).agg(F.count("*").alias("c"))
    h = h.withColumn("before", F.sum("c").over(Window.orderBy("x").rowsBetween(Window.unboundedPreceding, 0)) - F.col("c"))
    ranks = F.col("c") * F.col("before") + F.expr("c * (c + 1) div 2")
    s = h.agg(F.sum(ranks * F.col("x")).alias("a"), F.sum(F.col("x") * F.col("c")).alias("b"), F.sum("c").alias("n"))
    return s.select(F.when(F.col("b") > 0, F.round(2 * F.col("a") / (F.col("n") * F.col("b")) - (F.col("n") + 1) / F.col("n"), 6)).otherwise(0.0).alias("gini"))


def cheap_stats(g: TemporalGraph, snaps: int) -> DataFrame:
    """gini of degrees, recurring (edges whose unordered pair comes again), attr_corr of a hashed attribute, burst counts."""
    deg = degree(g)
    pairs = g.edges.groupBy(F.least("src", "dst").alias("x"), F.greatest("src", "dst").alias("y")).agg(F.count("*").alias("c"))
    recurring = pairs.agg(F.coalesce(F.sum(F.when(F.col("c") > 1, F.col("c"))), F.lit(0)).cast("long").alias("recurring"))
    corr = deg.agg(F.round(F.abs(F.corr((F.col("v") * 2654435761 % 10007).cast("double"), F.col("deg").cast("double"))), 6).alias("attr_corr"))
    row = g.edges.agg(F.min("t").alias("a"), F.max("t").alias("b")).first()
    span = max(1, (row["b"] or 0) - (row["a"] or 0)) + 1
    bins = g.edges.groupBy(F.least(F.expr(f"(t - {row['a'] or 0}) * {snaps} div {span}"), F.lit(snaps - 1)).alias("bin")).agg(F.count("*").alias("c"))
    burst = bins.agg(F.round(F.stddev_pop("c") / (F.avg("c") + 1e-9), 6).alias("burstiness"))
    out = gini(deg, "deg")
    for part in (recurring, corr, burst):
        out = out.join(F.broadcast(part))
    return out


def clustering(edges: DataFrame, by: str) -> DataFrame:
    """``by``, clusterability: mean over vertices with k >= 2 neighbours (edges count singly, loops twice) of links / (k (k - 1)).

    links: for each neighbour, how many distinct vertices are neighbours of both. Triangles
    are found once each, along edges from the lower to the higher degree.
    """
    pair = kept(both_ways(edges, by).groupBy(by, "a", "b").agg(F.count("*").alias("m")), "pairs")
    v = pair.groupBy(by, "a").agg(F.sum("m").alias("k"), F.count("*").alias("n"), F.coalesce(F.sum(F.when(F.col("a") == F.col("b"), F.col("m"))), F.lit(0)).alias("loops"))
    end = v.select(by, F.col("a").alias("b"), F.col("n").alias("nb"), (F.col("loops") > 0).cast("long").alias("lb"))
    ranked = kept(pair.join(v, [by, "a"]).join(end, [by, "b"]), "ranked")
    up = kept(ranked.where("a <> b").where(F.struct("n", "a") < F.struct(F.col("nb").alias("n"), F.col("b").alias("a"))).select(by, "a", "b"), "up")
    wedge = up.select(by, F.col("a").alias("x"), F.col("b").alias("y")).join(up.select(by, F.col("a").alias("y"), F.col("b").alias("z")), [by, "y"])
    tri = wedge.join(up.select(by, F.col("a").alias("x"), F.col("b").alias("z")), [by, "x", "z"])
    sides = F.array(*[F.struct(F.col(p).alias("a"), F.col(q).alias("b")) for p, q in ("xy", "yx", "xz", "zx", "yz", "zy")])
    shared = tri.select(by, F.explode(sides).alias("s")).select(by, "s.a", "s.b").groupBy(by, "a", "b").agg(F.count("*").alias("tri"))
    both = F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(F.coalesce("tri", F.lit(0)) + (F.col("loops") > 0).cast("long") + F.col("lb"))
    links = ranked.join(shared, [by, "a", "b"], "left").groupBy(by, "a").agg(F.max("k").alias("k"), F.sum(F.col("m") * both).alias("links"))
    mean = F.avg(F.when(F.col("k") >= 2, F.col("links") / (F.col("k") * (F.col("k") - 1))))
    return links.groupBy(by).agg(F.round(F.coalesce(mean, F.lit(0.0)), DIGITS).alias("clusterability"))


def window_stats(g: TemporalGraph, windows: int, bins: int = 64, clustered: bool = False) -> DataFrame:
    """Per count window: avg_degree 2E/active, max_snapshot_nodes, persistence mean(k)/S over equal-width bins; where asked for, clusterability."""
    e = g.edges.withColumn("win", F.expr(f"least(pos * {windows} div {max(1, g.num_edges)}, {windows - 1})"))
    s = e.groupBy("win").agg(F.min("t").alias("a"), (F.max("t") - F.min("t") + 1).alias("span"), F.least(F.lit(bins), F.count_distinct("t")).alias("s"), F.count("*").alias("e"))
    b = e.join(F.broadcast(s), "win").withColumn("bin", F.expr("least((t - a) * s div span, s - 1)"))
    cell = both_ways(b, "win", "bin", "s").select("win", "bin", "s", F.col("a").alias("v")).distinct()
    per_bin = cell.groupBy("win", "bin").agg(F.count("*").alias("c")).groupBy("win").agg(F.max("c").alias("max_snapshot_nodes"))
    per_v = cell.groupBy("win").agg(F.count_distinct("v").alias("active"), F.count("*").alias("cells"))
    out = s.join(per_bin, "win").join(per_v, "win").select(
        "win", F.round(2 * F.col("e") / F.col("active"), DIGITS).alias("avg_degree"), "max_snapshot_nodes",
        F.round(F.col("cells") / F.col("active") / F.col("s"), DIGITS).alias("persistence"),
    )
    return out.join(clustering(e, "win"), "win") if clustered else out


def drift(stats: DataFrame, order: str = "win") -> DataFrame:
    """drift in [0, 1] of each window against the one before: weighted symmetric relative shifts; the first has 1."""
    w = Window.orderBy(order)  # one row a window
    total = None
    for name, weight in (("persistence", 0.30), ("avg_degree", 0.20), ("max_snapshot_nodes", 0.15), ("clusterability", 0.35)):
        if name not in stats.columns:
            continue
        now, before = F.col(name).cast("double"), F.lag(F.col(name).cast("double")).over(w)
        shift = F.least(F.lit(1.0), F.abs(now - before) / F.greatest(F.abs(now), F.abs(before), F.lit(1e-9))) * weight
        total = shift if total is None else total + shift
    return stats.select(order, F.round(F.coalesce(F.least(F.lit(1.0), total), F.lit(1.0)), 6).alias("drift"))


def _first_seen(g: TemporalGraph, snaps: int) -> DataFrame:
    return active(g, snaps).groupBy("v").agg(F.min("snap").alias("first"))


def reuse_1hop(g: TemporalGraph, snaps: int) -> DataFrame:
    """snap, before, hit: vertices active before a snapshot, and those of them that it touches (reuse is 1 - hit / before)."""
    first = _first_seen(g, snaps)
    born = first.groupBy(F.col("first").alias("snap")).agg(F.count("*").alias("c"))
    grid = g.spark.range(1, snaps).select(F.col("id").alias("snap"))
    before = grid.join(born.withColumnRenamed("snap", "s"), F.col("s") < F.col("snap"), "left").groupBy("snap").agg(F.coalesce(F.sum("c"), F.lit(0)).cast("long").alias("before"))
    hit = active(g, snaps).join(first, "v").where("first < snap").groupBy("snap").agg(F.count("*").alias("hit"))
    return before.join(hit, "snap", "left").select("snap", "before", F.coalesce("hit", F.lit(0)).alias("hit"))


def reuse_2hop(g: TemporalGraph, snaps: int) -> DataFrame:
    """As reuse_1hop, with a vertex hit also if a neighbour over the edges so far is touched."""
    first = _first_seen(g, snaps)
    act = active(g, snaps)
    pair = both_ways(with_snap(g, snaps), "snap").groupBy("a", "b").agg(F.min("snap").alias("since"))
    near = pair.join(act.withColumnRenamed("v", "b"), "b").where("since <= snap").select(F.col("a").alias("v"), "snap")
    hit = near.unionAll(act.select("v", "snap")).distinct().join(first, "v").where("first < snap").groupBy("snap").agg(F.count("*").alias("hit"))
    return reuse_1hop(g, snaps).select("snap", "before").join(hit, "snap", "left").select("snap", "before", F.coalesce("hit", F.lit(0)).alias("hit"))


def auc_rank(scored: DataFrame, label: str, score: str, key: str) -> DataFrame:
    """auc by ordinal ranks, ties by the key."""
    r = with_position(scored.select(label, score, key), [score, key], "r")
    s = r.agg(F.sum(F.when(F.col(label) == 1, F.col("r") + 1)).alias("s"), F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("n"))
    return s.select(F.round((F.col("s") - F.col("p") * (F.col("p") + 1) / 2) / (F.col("p") * F.col("n")), 6).alias("auc"))


def average_precision(scored: DataFrame, label: str, score: str, key: str) -> DataFrame:
    """ap: mean over positives of the precision at their rank, scores descending, ties by the key."""
    r = with_position(scored.select(label, score, key), [F.desc(score), F.asc(key)], "r").where(F.col(label) == 1)
    hits = with_position(r.select("r"), ["r"], "h")
    return hits.agg(F.round(F.avg((F.col("h") + 1) / (F.col("r") + 1)), 6).alias("ap"))


def latency_fit(points: DataFrame) -> DataFrame:
    """alpha, beta, r2 of ms = alpha * ceil(log2 w) + beta."""
    x = F.ceil(F.log2("w")).cast("double")
    return points.withColumn("x", x).agg(F.round(F.regr_slope("ms", "x"), 6).alias("alpha"), F.round(F.regr_intercept("ms", "x"), 6).alias("beta"), F.round(F.regr_r2("ms", "x"), 6).alias("r2"))


def edge_homophily(g: TemporalGraph, attr: DataFrame) -> DataFrame:
    """same, edges: edges whose ends have one attribute (v, attr)."""
    e = g.edges.join(attr.withColumnsRenamed({"v": "src", "attr": "x"}), "src").join(attr.withColumnsRenamed({"v": "dst", "attr": "y"}), "dst")
    return e.agg(F.count_if(F.col("x") == F.col("y")).alias("same"), F.count("*").alias("edges"))
