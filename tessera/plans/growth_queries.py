"""Queries on sliding windows, training samples, choices, orders and groups."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scratch import kept
from ..operators import batched as B
from ..operators import choice as X
from ..operators import cost as C
from ..operators import greedy as K
from ..operators import iterate as I
from ..operators import memory as R
from ..operators import metrics as M
from ..operators import orders as O
from ..operators import placement as P
from ..operators import signals as N
from ..operators import sliding as W
from ..operators import stats as S
from ..operators import supra as G
from ..operators import temporal as T
from ..sources import graphs
from . import arrange as A
from . import model_queries as Q
from .structure_queries import _EC, _HASH, _PE, D, SNAPS
from .structure_queries import ORACLE_SQL as _S
from .structure_queries import QUERIES as _QS
from .structure_queries import query as _query

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
LINK = 50.0


def registrar(queries: dict, sql: dict):
    """A ``query`` that registers in these tables."""

    def query(name, on, body=None):
        def add(fn):
            _query(name, on, body)(fn)
            queries[name] = _QS.pop(name)
            if body is not None:
                sql[name] = _S.pop(name)
            return fn

        return add

    return query


query = registrar(QUERIES, ORACLE_SQL)


def table(name, sql=None):
    def add(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(spark)
        if sql is not None:
            ORACLE_SQL[name] = sql
        return fn

    return add


# Sliding windows.
_WSN = 8
_BD = f", bd AS (SELECT s AS snap, s * (SELECT m FROM m) // {_WSN} AS hi FROM (SELECT unnest(range(1, {_WSN + 1})) AS s)), bw AS (SELECT snap, coalesce(lag(hi, 3) OVER (ORDER BY snap), 0) AS lo, hi FROM bd)"
_TB = f""", tt AS (SELECT min(t) AS a, max(t) AS b FROM edges), te AS (SELECT least((t - a) * {_WSN} // (b - a) + 1, {_WSN}) AS snap FROM edges, tt),
bt AS (SELECT s AS snap, (SELECT count(*) FROM te WHERE te.snap <= s)::BIGINT AS hi FROM (SELECT unnest(range(1, {_WSN + 1})) AS s))"""
_bounds = lambda g: W.snapshot_bounds(g, _WSN, window=3)
query("snapshot_bounds_edges", "O", _BD + " SELECT snap, lo::BIGINT AS lo, hi::BIGINT AS hi FROM bw")(lambda g, s: _bounds(g))
query("snapshot_bounds_time", "O", _TB + " SELECT snap, coalesce(lag(hi, 2) OVER (ORDER BY snap), 0)::BIGINT AS lo, hi FROM bt")(lambda g, s: W.snapshot_bounds(g, _WSN, "time", 2))
query("snapshot_bounds_growing", "E", _TB + " SELECT snap, 0::BIGINT AS lo, hi FROM bt")(lambda g, s: W.snapshot_bounds(g, _WSN, "time"))
_WE = _BD + ", we AS (SELECT snap, pos, src, dst FROM edges JOIN bw ON pos >= lo AND pos < hi), wa AS (SELECT snap, v, row_number() OVER (PARTITION BY snap ORDER BY v) - 1 AS local FROM (SELECT snap, src AS v FROM we UNION SELECT snap, dst FROM we))"
query("window_local_ids", "O", _WE + " SELECT snap, v, local FROM wa")(lambda g, s: W.window_active(g, _bounds(g)))
query("window_turnover", "O", _WE + """ SELECT x.snap, count(*) FILTER (n)::BIGINT AS active, count(*) FILTER (n AND NOT o)::BIGINT AS entered, count(*) FILTER (o AND NOT n)::BIGINT AS departed FROM
(SELECT snap, v, bool_or(n) AS n, bool_or(NOT n) AS o FROM (SELECT snap, v, true AS n FROM wa UNION ALL SELECT snap + 1, v, false FROM wa) GROUP BY 1, 2) x WHERE x.snap <= 8 GROUP BY 1""")(lambda g, s: W.turnover(W.window_active(g, _bounds(g))))  # fmt: skip
_WP = _WE + ", wn AS (SELECT snap, count(*) AS n FROM wa GROUP BY 1), wp AS (SELECT snap, v, local * 4 // n AS part FROM wa JOIN wn USING (snap))"


def _blocks(g):
    a = W.window_active(g, _bounds(g))
    n = a.groupBy("snap").agg(F.count("*").alias("n"))
    return a.join(F.broadcast(n), "snap").select("snap", "v", F.expr(f"local * {D} div n").alias("part"))


query("window_cut", "O", _WP + " SELECT we.snap, count(*) FILTER (x.part <> y.part)::BIGINT AS cut FROM we JOIN wp x ON x.snap = we.snap AND x.v = src JOIN wp y ON y.snap = we.snap AND y.v = dst GROUP BY 1")(
    lambda g, s: W.window_cut(g, _bounds(g), _blocks(g))
)
_WC = _WP + """, ct AS (SELECT snap, v, count(*) AS c FROM (SELECT snap, src AS v FROM we UNION ALL SELECT snap, dst FROM we) GROUP BY 1, 2), lim AS (SELECT snap, quantile_cont(c, 0.9) AS q FROM ct GROUP BY 1),
core AS (SELECT snap, v FROM ct JOIN lim USING (snap) WHERE c >= q), ho AS (SELECT * FROM wp ANTI JOIN core USING (snap, v))"""
query("window_cut_core", "O", _WC + """ SELECT bw.snap, coalesce(cut, 0)::BIGINT AS cut FROM bw LEFT JOIN
(SELECT we.snap, count(*) FILTER (x.part <> y.part) AS cut FROM we JOIN ho x ON x.snap = we.snap AND x.v = src JOIN ho y ON y.snap = we.snap AND y.v = dst GROUP BY 1) USING (snap)""")(
    lambda g, s: W.window_cut(g, _bounds(g), _blocks(g), W.window_core(g, _bounds(g)))
)
_PERMS = ", ".join(f"({i}, {q}, {p})" for i, t in enumerate(W.permutations(range(D))) for q, p in enumerate(t))
query("active_migration", "O", _WP + f""", perms(perm, q, p) AS (VALUES {_PERMS}), ov AS (SELECT x.snap, x.part AS q, y.part AS p, count(*) AS c FROM wp x JOIN wp y ON y.snap = x.snap - 1 AND y.v = x.v GROUP BY 1, 2, 3),
kp AS (SELECT snap, max(k) AS k FROM (SELECT snap, perm, sum(c) AS k FROM ov JOIN perms USING (q, p) GROUP BY 1, 2) GROUP BY 1)
SELECT snap, sum(c)::BIGINT AS "both", (sum(c) - max(k))::BIGINT AS moved FROM ov JOIN kp USING (snap) GROUP BY 1""")(lambda g, s: W.active_migration(_blocks(g), D))  # fmt: skip


@query("sliding_incremental", "F", _WE + f" SELECT snap, count(*)::BIGINT AS active, true AS covered, true AS within_cap FROM wa GROUP BY 1")  # noqa: F541
def _sliding(g, s):
    """Each window's active vertices have one part each, none over its cap."""
    b = _bounds(g)
    p = W.sliding_incremental(g, b, D)
    n = W.window_active(g, b).groupBy("snap").agg(F.count("*").alias("active"))
    most = p.groupBy("snap", "part").agg(F.count("*").alias("c")).groupBy("snap").agg(F.sum("c").alias("placed"), F.max("c").alias("most"), F.max("part").alias("top"))
    v = p.groupBy("snap").agg(F.count_distinct("v").alias("distinct"))
    ok = (F.col("placed") == F.col("active")) & (F.col("distinct") == F.col("active")) & (F.col("top") < D)
    return n.join(most, "snap").join(v, "snap").select("snap", "active", ok.alias("covered"), (F.col("most") <= F.floor(1.1 * F.col("active") / D) + 1).alias("within_cap"))


_FP = _HASH + _PE + ", fp AS (SELECT part, floor(count(*) + 0.25 * sum(deg) + 0.5)::BIGINT AS load FROM pl JOIN deg USING (v) GROUP BY 1)"
query("activity_footprint", "O", _FP + " SELECT part, load FROM fp")(lambda g, s: W.footprint(g, P.by_hash(g, D), D, 0.25))
_CAPS = [9000, 300_000, 40_000, 20_000]
query("footprint_feasible", "O", _FP + f""", cp(part, cap) AS (VALUES {", ".join(f"({i}, {c})" for i, c in enumerate(_CAPS))}),
a AS (SELECT load, row_number() OVER (ORDER BY load DESC, part) AS r FROM fp), b AS (SELECT cap, row_number() OVER (ORDER BY cap DESC, part) AS r FROM cp),
x AS (SELECT max(load - cap) AS x FROM a JOIN b USING (r)), y AS (SELECT max(load - cap) AS y FROM fp JOIN cp USING (part))
SELECT x <= 0 AS feasible, greatest(0, x)::BIGINT AS over, y <= 0 AS pinned_feasible, greatest(0, y)::BIGINT AS pinned_over FROM x, y""")(
    lambda g, s: W.feasibility(W.footprint(g, P.by_hash(g, D), D, 0.25), g.spark.createDataFrame(list(enumerate(_CAPS)), "part long, cap long"))
)


@query("rebalance_activity", "O", """, tot AS (SELECT count(*) + 0.25 * sum(deg) AS f FROM deg), fp0 AS (SELECT v % 4 AS part, count(*) + 0.25 * sum(deg) AS f FROM deg GROUP BY 1)
SELECT (SELECT n FROM n)::BIGINT AS nodes, true AS covered, (SELECT count(*) FROM fp0, tot WHERE fp0.part = 0 AND fp0.f > 0.2 * tot.f)::BIGINT AS over_before, 0::BIGINT AS over_after""")  # fmt: skip
def _rebalance(g, s):
    """Part 0 may hold a fifth of all and the others more than the rest: after it none is over, and all vertices have one part."""
    start = P.by_hash(g, D)
    fp = lambda p: {r["part"]: r["f"] for r in p.join(S.degree(g), "v").groupBy("part").agg((F.count("*") + 0.25 * F.sum("deg")).alias("f")).collect()}
    before = fp(start)
    caps = [0.2 * sum(before.values())] + [0.5 * sum(before.values())] * (D - 1)
    done = W.rebalanced(g, start, D, 0.25, caps, g.num_nodes)
    after = fp(done)
    n = done.agg(F.count("*").alias("n"), F.count_distinct("v").alias("d")).first()
    row = (n["n"], n["n"] == n["d"] == g.num_nodes, int(before[0] > caps[0]), sum(after[p] > caps[p] for p in range(D)))
    return g.spark.createDataFrame([row], "nodes long, covered boolean, over_before long, over_after long")


query("temporal_sync_cost", "O", f" SELECT count(*) FILTER (k > 1)::BIGINT AS cut, round(count(*) FILTER (k > 1) * 64 * 4 / ({LINK}::DOUBLE * 1e9) * 1e3, 9) AS per_snap_ms, round(count(*) FILTER (k > 1) * 64 * 4 / ({LINK}::DOUBLE * 1e9) * 16 * 1e3, 9) AS total_ms FROM (SELECT count(DISTINCT snap * 4 // 16) AS k FROM cells GROUP BY v)")(
    lambda g, s: W.temporal_sync(g, s, D, 64, LINK)
)

# Training samples.
query("vertex_features", "F", " SELECT v, c, avg(x)::DOUBLE AS x FROM (SELECT unnest([src, dst]) AS v, pos, src, dst FROM edges) e, LATERAL (VALUES (0::BIGINT, (pos % 7)::DOUBLE), (1, ((src + dst) % 5)::DOUBLE)) t(c, x) GROUP BY 1, 2")(
    lambda g, s: N.vertex_features(g.edges.withColumn("efeat", F.array((F.col("pos") % 7).cast("double"), ((F.col("src") + F.col("dst")) % 5).cast("double"))))
)
query("negative_samples", "O", """, d AS (SELECT pos, src, dst, (pos * 2654435761 + 12345) % 4294967296 % (SELECT n FROM n)::BIGINT AS x FROM edges)
SELECT label, count(*)::BIGINT AS rows, sum(dst)::BIGINT AS dst_sum, count(*) FILTER (dst = old)::BIGINT AS same FROM
(SELECT 1 AS label, dst, -1 AS old FROM edges UNION ALL SELECT 0, CASE WHEN x = dst THEN (x + 1) % (SELECT n FROM n) ELSE x END, dst FROM d) GROUP BY 1""")(
    lambda g, s: N.negatives(g).join(g.edges.select("pos", F.col("dst").alias("old")), "pos").groupBy("label").agg(F.count("*").alias("rows"), F.sum("dst").alias("dst_sum"), F.count_if((F.col("dst") == F.col("old")) & (F.col("label") == 0)).alias("same"))
)
query("message_means", "O", " SELECT snap, dst AS v, count(*)::BIGINT AS messages, avg(src % 11)::DOUBLE AS mean FROM es GROUP BY 1, 2")(lambda g, s: N.message_means(g, s, "src % 11"))
query("decayed_activity", "O", """, c AS (SELECT a AS v, snap, count(*) AS c FROM sym GROUP BY 1, 2), r AS (SELECT v, snap, c, unnest(range(snap, least(snap + 3, 15) + 1)) AS s FROM c)
SELECT s AS snap, v, sum(c * pow(0.5, s - snap))::DOUBLE AS x FROM r GROUP BY 1, 2""")(lambda g, s: N.decayed(g, s, 4, 0.5))  # fmt: skip
_QX = "SELECT id, ((id * 7919 % 2003) - 1001) / 3.0::DOUBLE * pow(10.0, id % 9 - 5) AS x FROM (SELECT unnest(range(0, 500)) AS id)"
table("half_precision", f"""WITH q AS ({_QX}), s AS (SELECT id, x, pow(2.0, greatest(-14.0, floor(log2(greatest(abs(x), pow(2.0, -24))))) - 10) AS step FROM q)
SELECT id, (sign(x) * CASE WHEN round_even(abs(x) / step, 0) * step > 65504 THEN 'inf'::DOUBLE ELSE round_even(abs(x) / step, 0) * step END)::DOUBLE AS q FROM s""")(
    lambda spark: spark.range(500).selectExpr("id", "((id * 7919 % 2003) - 1001) / 3.0D * pow(10.0D, id % 9 - 5) AS x").select("id", N.half_precision("x").alias("q"))
)
query("fake_quantised", "F", ", f AS (SELECT v, ((v * 7919 % 2003) - 1001) / 3.0::DOUBLE AS x FROM verts), s AS (SELECT max(abs(x)) / 127 AS s FROM f) SELECT v, (round_even(x / s, 0) * s)::DOUBLE AS q FROM f, s")(
    lambda g, s: T.fake_quantised(g.vertices().selectExpr("v", "((v * 7919 % 2003) - 1001) / 3.0D AS x"), "x").select("v", "q")
)

# Statistics of windows with their clustering.
_CL = """, wb AS (SELECT win, a, b, count(*) AS m FROM (SELECT win, src AS a, dst AS b FROM we UNION ALL SELECT win, dst, src FROM we) GROUP BY 1, 2, 3),
nb AS (SELECT win, a, sum(m) AS k FROM wb GROUP BY 1, 2), lk AS (SELECT x.win, x.a, sum(x.m * c) AS links FROM wb x JOIN
(SELECT x.win, x.a, x.b, count(*) AS c FROM wb x JOIN wb y ON y.win = x.win AND y.a = x.b JOIN wb z ON z.win = x.win AND z.a = x.a AND z.b = y.b GROUP BY 1, 2, 3) t ON t.win = x.win AND t.a = x.a AND t.b = x.b GROUP BY 1, 2),
wcl AS (SELECT nb.win, round(coalesce(avg(coalesce(links, 0) / (k * (k - 1))) FILTER (k >= 2), 0.0), 9) AS clusterability FROM nb LEFT JOIN lk USING (win, a) GROUP BY 1), wst AS (SELECT * FROM wstats JOIN wcl USING (win))
"""
from .structure_queries import _SHIFT, _WIN  # noqa: E402

_WF = _WIN
query("window_stats_clustered", "F", _WF + _CL + "SELECT * FROM wst")(lambda g, s: S.window_stats(g, 10, clustered=True))
query("drift_score_clustered", "F", _WF + _CL + f"""SELECT win, round(coalesce(least(1.0, {_SHIFT("persistence")} * 0.3 + {_SHIFT("avg_degree")} * 0.2 + {_SHIFT("max_snapshot_nodes")} * 0.15 + {_SHIFT("clusterability")} * 0.35), 1.0), 6) AS drift
FROM wst WINDOW w AS (ORDER BY win)""")(lambda g, s: S.drift(S.window_stats(g, 10, clustered=True)))  # fmt: skip

# Choices.
_JOBS = [(0, 1_000_000, 60_000_000, 128, 24.0e9, 50.0, 900.0), (1, 50_000_000, 2_000_000_000, 256, 80.0e9, 25.0, 1500.0), (2, 10_000, 50_000, 16, 8.0e9, 300.0, 600.0)]
table("best_k", f"""WITH j(job, n, e, feat, cap, link, bw) AS (VALUES {", ".join(f"({a}::BIGINT, {b}::BIGINT, {c}::BIGINT, {d}::BIGINT, {x}::DOUBLE, {y}::DOUBLE, {z}::DOUBLE)" for a, b, c, d, x, y, z in _JOBS)}),
k AS (SELECT *, greatest(1, ceil((n * feat * 4.0::DOUBLE + e * 20.0::DOUBLE) / cap))::BIGINT AS k_mem, greatest(1.0, greatest(2.0::DOUBLE * 4.0 * feat * e / (bw * 1e9) * 1e3, 2.0::DOUBLE * 4.0 * feat * e / (link * 1e9) * 1e3) * ln(2) / 0.0545) AS k_bal FROM j),
s AS (SELECT *, round_even(greatest(k_mem::DOUBLE, k_bal), 0)::BIGINT AS k_star FROM k)
SELECT job, k_mem, round(k_bal, 6) AS k_bal, k_star, round(0.0545::DOUBLE * ceil(log2(greatest(2, k_star))) + 0.045, 9) AS barrier_ms FROM s""")(
    lambda spark: X.best_k(spark.createDataFrame(_JOBS, "job long, n long, e long, feat long, cap double, link double, bw double"), 0.0545, 0.045).select("job", "k_mem", "k_bal", "k_star", "barrier_ms")
)
table("crossover_phi", "SELECT id, CASE WHEN id > 0 THEN round((10.0::DOUBLE - id) / id, 9) END AS phi FROM (SELECT unnest(range(0, 10)) AS id)")(
    lambda spark: spark.range(10).select("id", F.round(X.crossover_phi(F.col("id").cast("double"), 10.0 - F.col("id")), 9).alias("phi"))
)
_BV = _HASH + _PE + ", bv AS (SELECT b AS v, count(*) AS readers FROM hr GROUP BY 1), br AS (SELECT v, deg, readers, row_number() OVER (ORDER BY deg DESC, v) - 1 AS r FROM bv JOIN deg USING (v))"
query("replica_table", "O", _BV + """, x(pct) AS (VALUES (0.5::DOUBLE), (1), (2), (5), (10), (25), (50), (100)), t AS (SELECT pct, least(greatest(1, round_even(b * pct / 100, 0)), b)::BIGINT AS vertices FROM x, (SELECT count(*) AS b FROM br))
SELECT pct, vertices, sum(readers)::BIGINT AS rows, (sum(readers) * 128 * 4)::BIGINT AS bytes FROM br JOIN t ON r < vertices GROUP BY 1, 2""")(lambda g, s: X.replica_table(g, P.by_hash(g, D), 128))  # fmt: skip
_LINKS = {"fast": 300.0, "middle": 50.0, "slow": 1.25}
query("recompute_table", "O", _BV + f""", q AS (SELECT count(*) AS b, avg(deg) AS d FROM br), s AS (SELECT b * 128 * 4 AS bytes, greatest(((b * greatest(1.0, d) + b) * 128 * 4 + 128 * 128 * 4) / 1.5e12, (2.0::DOUBLE * (b * greatest(1.0, d)) * 128 + 2.0::DOUBLE * b * 128 * 128) / 1.5e13) AS again FROM q),
l(link, gbps) AS (VALUES {", ".join(f"('{k}', {v}::DOUBLE)" for k, v in _LINKS.items())})
SELECT link, gbps, round(bytes / (gbps * 1e9) * 1e3, 9) AS comm_ms, round(again * 1e3, 9) AS recompute_ms, again < bytes / (gbps * 1e9) AS recompute, round(bytes / (again * 1e9), 6) AS even_gbps FROM s, l""")(
    lambda g, s: X.recompute_table(g, P.by_hash(g, D), 128, _LINKS)
)
_STATS = [(f"g{i}", n, e, f, loc, b, hbm, link, 500.0, fam) for i, (n, e, f, loc, b, hbm, link, fam) in enumerate([
    (100_000, 400_000, 128, 0.2, 0.4, 80e9, 50.0, "STRUCTURE"), (50_000, 1_500_000, 256, 0.4, 0.9, 80e9, 1.0, "ATTRIBUTE"), (1_000_000, 3_000_000, 4096, 0.1, 0.2, 2.3e9, 50.0, "ATTRIBUTE"), (20_000, 100_000, 64, 0.7, 1.6, 80e9, 50.0, "TIME"),
    (30_000, 200_000, 64, 0.55, 0.8, 80e9, 50.0, "TIME"), (80_000, 900_000, 128, 0.3, 0.3, 80e9, 1.0, "ATTRIBUTE"), (200_000, 1_000_000, 32, 0.45, 1.2, 80e9, 100.0, "STRUCTURE")])]
_ST = "name string, n long, e long, feat long, local double, burst double, hbm double, link double, bw double, family string"
_GATES = ", ".join(f"({d}::DOUBLE, {t}::DOUBLE, {b}::DOUBLE, {abs(d - 25.0) + abs(t - 0.5) + abs(b - 1.0)}::DOUBLE)" for d in X.DENSE for t in X.LOCAL for b in X.BURST)
_RULE = """CASE WHEN (n / 8 * feat * 4.0::DOUBLE + 2.0::DOUBLE * e / 8 * 20 > hbm AND feat / 8 * n * 4.0::DOUBLE + e * 20.0::DOUBLE <= hbm) OR
(n / 8 * feat * 4.0::DOUBLE * 2 / (link * 1e9) * 1e3 > 2.0::DOUBLE * e / 8 * 4 * 2 / (bw * 1e9) * 1e3 AND 2.0::DOUBLE * e / greatest(1, n) >= dg) THEN 'ATTRIBUTE' WHEN local > lg AND burst > bg THEN 'TIME' ELSE 'STRUCTURE' END"""
table("axis_scorecard", f"""WITH s(name, n, e, feat, local, burst, hbm, link, bw, family) AS (VALUES {", ".join(f"('{r[0]}', {r[1]}::BIGINT, {r[2]}::BIGINT, {r[3]}::BIGINT, " + ", ".join(f"{x}::DOUBLE" for x in r[4:9]) + f", '{r[9]}')" for r in _STATS)}),
g(dg, lg, bg, far) AS (VALUES {_GATES}), p AS (SELECT s.*, dg, lg, bg, far, {_RULE} AS p FROM s, g), h AS (SELECT *, (p = family)::BIGINT AS hit, sum((p = family)::BIGINT) OVER (PARTITION BY dg, lg, bg) AS tot FROM p),
r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY tot - hit DESC, far, dg, lg, bg) AS r FROM h)
SELECT name, family, (SELECT p FROM p x WHERE x.name = r.name AND far = 0) AS predicted, p AS held_out FROM r WHERE r = 1""")(lambda spark: X.scorecard(spark.createDataFrame(_STATS, _ST)))  # fmt: skip
_plans = lambda spark: R.plan_memory(spark.createDataFrame(Q._LOADS, Q._LOAD), C.devices(spark, "het3"))
_PM = Q.ORACLE_SQL["plan_memory"]
table("tier_budgets", f"""WITH p AS ({_PM}), {C.devices_sql("het3")}
SELECT w, device, resident, streamed, peak AS resident_bytes, round_even(staging_sec * h2d_gbps * 1e9, 0)::BIGINT AS streamed_bytes, usable_mem::BIGINT AS capacity, feasible AND peak <= usable_mem AS fits FROM p JOIN devices ON id = device""")(
    lambda spark: X.budgets(_plans(spark), C.devices(spark, "het3"))
)
table("pool_plan")(lambda spark: X.pool_plan(_plans(spark), spark.createDataFrame([(r[0], r[5]) for r in Q._LOADS], "w long, window long"), 24, 1, 3))


def _candidates_sql(tail: str) -> str:
    return Q._DEV + f", cands AS ({Q._CANDS}) " + tail


_BEST = "best AS (SELECT * FROM cands ORDER BY NOT (feasible AND imbalance <= 2.5), CASE WHEN feasible AND imbalance <= 2.5 THEN makespan_ms ELSE imbalance END, cand LIMIT 1)"
_AX = _candidates_sql(f""", {_BEST}, k AS (SELECT (SELECT n FROM n)::DOUBLE AS n, (SELECT m FROM m)::DOUBLE AS e, (SELECT avg(hbm_bw_gbps) FROM devices) * 1e9 AS b, (SELECT min(usable_mem) FROM devices) AS least, 50e9 AS l),
ax AS (SELECT CASE WHEN cand LIKE 'temporal%' THEN 'time' ELSE 'structure' END AS axis, round(makespan_ms, 6) AS ms, feasible AS fits FROM best
UNION ALL SELECT 'feature', round(2 * 2 * (e / 4) * 512 * 4 / b * 1e3 + 2 * (2 * n * 512 * 4 / l * 1e3), 6), 512 / 4 * n * 4 + e * 20 <= least FROM k
UNION ALL SELECT 'hybrid', round(greatest(2 * 2 * (e / 2) * 512 * 4 / b * 1e3 + 2 * n / 2 * 1 / 2 * 512 * 4 / l * 1e3, 2 * 2 * (e / 2) * 256 * 4 / b * 1e3 + 2 * n * 256 * 4 / l * 1e3) + 2 * n * 256 * 4 / l * 1e3, 6), 512 / 2 * (n / 2) * 4 + e * 20 <= least FROM k)""")  # fmt: skip


def _axis_prices(g, s):
    return X.axis_prices(A.pick(A.candidates(g, s, Q._DEVS, LINK), D), g.num_nodes, g.num_edges, 512, Q._DEVS, LINK)


query("axis_prices", "F", _AX.replace(") , best", "), best") + " SELECT axis, ms, fits FROM ax")(_axis_prices)
query("choose_axis", "F", _AX.replace(") , best", "), best") + " SELECT axis, ms, fits FROM ax ORDER BY fits DESC, ms, axis LIMIT 1")(lambda g, s: X.choose_axis(_axis_prices(g, s)))


def _flights(g):
    dev = C.devices(g.spark, "het4")
    one = lambda name, p: C.preflight(M.edgecut(g, p, D).withColumnRenamed("incident", "edges"), dev, 128).select(F.lit(name).alias("cand"), "device", "headroom", "oom", "compute_sec")
    return one("hash", P.by_hash(g, D)).unionAll(one("caphash", P.by_capacity(g, [5, 3, 1, 1])))


_CAPH = ", pl AS (SELECT v, (CASE WHEN v >= (SELECT n FROM n) * 5 // 10 THEN 1 ELSE 0 END + CASE WHEN v >= (SELECT n FROM n) * 8 // 10 THEN 1 ELSE 0 END + CASE WHEN v >= (SELECT n FROM n) * 9 // 10 THEN 1 ELSE 0 END)::BIGINT AS part FROM verts)"
_FL = lambda name, body: f"SELECT '{name}' AS cand, max(sec) AS makespan_sec, min(headroom)::BIGINT AS headroom, NOT bool_or(headroom < 0) AS feasible FROM (WITH {body.removeprefix(', ')}{_PE}, mt AS ({_EC}) SELECT round(incident * 5e-9 / throughput, 12) AS sec, usable_mem - ((nodes + halo) * 128 * 4 + incident * 20)::BIGINT AS headroom FROM mt JOIN devices ON id = part)"
for _intent, _order in (("min_time", "makespan_sec"), ("fit_memory", "headroom DESC")):
    query(f"resolve_{_intent}", "F", Q._DEV + f" SELECT * FROM ({_FL('hash', _HASH)} UNION ALL {_FL('caphash', _CAPH)}) ORDER BY feasible DESC, {_order}, cand LIMIT 1")(lambda g, s, i=_intent: X.resolved(_flights(g), i))

@query("allocate", "F", """, bl AS (SELECT cell_id, (dense_rank() OVER (ORDER BY v) - 1) * 4 // (SELECT count(DISTINCT v) FROM cells) AS dv, (dense_rank() OVER (ORDER BY snap) - 1) * 4 // (SELECT count(DISTINCT snap) FROM cells) AS dt FROM cells),
sp AS (SELECT x.cell_id AS a, y.cell_id AS b, 2 AS w FROM es e JOIN cells x ON x.v = src AND x.snap = e.snap JOIN cells y ON y.v = dst AND y.snap = e.snap WHERE src <> dst),
tp AS (SELECT a, b, 1 AS w FROM (SELECT lag(cell_id) OVER (PARTITION BY v ORDER BY snap) AS a, cell_id AS b FROM cells) WHERE a IS NOT NULL), pr AS (SELECT * FROM sp UNION ALL SELECT * FROM tp)
SELECT (SELECT count(*) FROM cells)::BIGINT AS cells, 4::BIGINT AS devices, true AS vertices_held, true AS no_worse,
least((SELECT sum(w) FROM pr JOIN bl x ON x.cell_id = a JOIN bl y ON y.cell_id = b WHERE x.dv <> y.dv), (SELECT sum(w) FROM pr JOIN bl x ON x.cell_id = a JOIN bl y ON y.cell_id = b WHERE x.dt <> y.dt))::BIGINT AS best_corner""")  # fmt: skip
def _allocate(g, s):
    """All cells are on a device, every active vertex is held, and the cost is no more than that of the better corner."""
    a = kept(A.allocate(g, s, Q._DEVS, LINK), "allocation")
    c = kept(G.cells(g, s), "cells")
    sp, tp = G.spatial_pairs(g, c, s), G.temporal_pairs(c)
    corner = min((lambda r: 2 * r["spatial"] + r["temporal"])(G.cuts(sp, tp, G.blocks_of(c, column, D)).first()) for column in ("v", "snap"))
    t = a.agg(F.sum("cells").alias("cells"), F.count("*").alias("devices"), F.sum("vertices").alias("v"), F.max("cost").alias("cost")).first()
    row = (t["cells"], t["devices"], t["v"] >= c.select("v").distinct().count(), t["cost"] <= corner, corner)
    return g.spark.createDataFrame([row], "cells long, devices long, vertices_held boolean, no_worse boolean, best_corner long")


@query("part_heterogeneous", "F", " SELECT (SELECT n FROM n)::BIGINT AS nodes, true AS covered, true AS within_cap, true AS grown_keeps")
def _heterogeneous(g, s):
    """Each vertex once within the devices' caps; from a prior placement without a budget, vertices that nothing new touches stay."""
    caps, link = [50, 30, 20, 20], [[0.0 if i == j else 50.0 / (1 + abs(i - j)) for j in range(D)] for i in range(D)]
    p = kept(B.heterogeneous(g, caps, link), "hetero")
    n, most = p.agg(F.count("*").alias("n"), F.count_distinct("v").alias("d")).first(), {r["part"]: r["count"] for r in p.groupBy("part").count().collect()}
    whole = B.heterogeneous(g, caps, link, prior=p)
    row = (n["n"], n["n"] == n["d"] == g.num_nodes, all(most.get(k, 0) <= c for k, c in enumerate(B.fitted_caps(caps, g.num_nodes))), whole.exceptAll(p).count() == 0)
    return g.spark.createDataFrame([row], "nodes long, covered boolean, within_cap boolean, grown_keeps boolean")


# Orders and groups.
query("degeneracy_order", "F", Q._H + ", o AS (SELECT v, row_number() OVER (ORDER BY core, v) - 1 AS rank FROM h6) SELECT v, rank FROM o")(lambda g, s: O.degeneracy_order(I.coreness(g, 6)))
_SB = ", wsy AS (SELECT a, b, count(*) AS w FROM sym WHERE a <> b GROUP BY 1, 2), left0 AS (SELECT v FROM verts)" + "".join(
    f""", d{k} AS (SELECT v, row_number() OVER (ORDER BY coalesce(d, 0) DESC, v) - 1 AS i FROM left{k} LEFT JOIN (SELECT a AS v, sum(w) AS d FROM wsy SEMI JOIN (SELECT v AS a FROM left{k}) USING (a) WHERE b IN (SELECT v FROM left{k}) GROUP BY 1) USING (v)),
left{k + 1} AS (SELECT v FROM d{k} WHERE i >= 5)""" for k in range(3))  # fmt: skip
query("hub_order", "F", _SB + """, d3 AS (SELECT v, row_number() OVER (ORDER BY coalesce(d, 0) DESC, v) - 1 AS i FROM left3 LEFT JOIN (SELECT a AS v, sum(w) AS d FROM wsy WHERE a IN (SELECT v FROM left3) AND b IN (SELECT v FROM left3) GROUP BY 1) USING (v))
SELECT v, i AS rank FROM d0 WHERE i < 5 UNION ALL SELECT v, i + 5 FROM d1 WHERE i < 5 UNION ALL SELECT v, i + 10 FROM d2 WHERE i < 5 UNION ALL SELECT v, i + 15 FROM d3""")(lambda g, s: O.hub_order(g, 0.05, 3))  # fmt: skip
query("dense_labels", "O", Q._LPA + " SELECT v, dense_rank() OVER (ORDER BY label) - 1 AS label FROM l5")(lambda g, s: O.dense_labels(I.label_propagation(g, 5)))
_SC = Q._LPA + ", o AS (SELECT v, row_number() OVER (ORDER BY label, v) - 1 AS r FROM l5)"
query("part_scratch", "O", _SC + " SELECT r * 4 // (SELECT n FROM n) AS part, count(*)::BIGINT AS nodes, sum(v)::BIGINT AS v_sum FROM o GROUP BY 1")(
    lambda g, s: O.rank_blocks(I.label_rank(I.label_propagation(g, 5)), g.num_nodes, D).groupBy("part").agg(F.count("*").alias("nodes"), F.sum("v").alias("v_sum"))
)
query("part_scratch_caps", "O", _SC + """ SELECT (CASE WHEN r >= 900 THEN 1 ELSE 0 END + CASE WHEN r >= 1500 THEN 1 ELSE 0 END + CASE WHEN r >= 1700 THEN 1 ELSE 0 END)::BIGINT AS part, count(*)::BIGINT AS nodes, sum(v)::BIGINT AS v_sum FROM o GROUP BY 1""")(
    lambda g, s: O.rank_blocks(I.label_rank(I.label_propagation(g, 5)), g.num_nodes, D, [900, 600, 200, 10**9]).groupBy("part").agg(F.count("*").alias("nodes"), F.sum("v").alias("v_sum"))
)
query("part_attribute", "O", ", o AS (SELECT v, row_number() OVER (ORDER BY v * 7 % 13, v) - 1 AS r FROM verts) SELECT v, least(r // ceil((SELECT n FROM n) / 4.0)::BIGINT, 3)::BIGINT AS part FROM o")(
    lambda g, s: O.by_attribute(g.vertices().select("v", (F.col("v") * 7 % 13).alias("attr")), g.num_nodes, D)
)
_MEM = """, o AS (SELECT v, fv * 4 + 20 * deg AS work, row_number() OVER (ORDER BY deg DESC, v) - 1 AS r, sum(fv * 4 + 20 * deg) OVER (ORDER BY deg DESC, v) AS p, sum(fv * 4 + 20 * deg) OVER () AS tot FROM deg JOIN verts USING (v)),
ct AS (SELECT k, count(*) FILTER (p * 4 < k * tot) AS c FROM o, (VALUES (1), (2), (3)) x(k) GROUP BY k), pl AS (SELECT v, work, (SELECT count(*) FROM ct WHERE c <= r)::BIGINT AS part FROM o)"""
query("part_memory", "F", _MEM + " SELECT part, count(*)::BIGINT AS nodes, sum(work)::BIGINT AS work FROM pl GROUP BY 1")(lambda g, s: O.by_memory(g, D).groupBy("part").agg(F.count("*").alias("nodes"), F.sum("work").alias("work")))


@query("part_memory_polish", "F", " SELECT (SELECT n FROM n)::BIGINT AS nodes, true AS covered, true AS no_worse, true AS within_cap")
def _polished(g, s):
    """Polishing a placement by memory keeps every vertex once and the cap, and the cut is no worse."""
    e = g.edges.where("src <> dst").groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.count("*").alias("w"))
    start = O.by_memory(g, D).select("v", F.col("work").alias("w"), "part")
    load = lambda p: p.groupBy("part").agg(F.sum("w").alias("s")).agg(F.max("s")).first()[0]
    cap = max(load(start), 1.1 * start.agg(F.sum("w")).first()[0] / D)
    done = K.refined(e, start, D, cap)
    n = done.agg(F.count("*").alias("n"), F.count_distinct("v").alias("d")).first()
    row = (n["n"], n["n"] == n["d"], K.cut_of(e, done) <= K.cut_of(e, start), load(done) <= cap)
    return g.spark.createDataFrame([row], "nodes long, covered boolean, no_worse boolean, within_cap boolean")


_LOADS_SQL = " SELECT (SELECT n FROM n)::BIGINT AS nodes, true AS covered, {0}::BOOLEAN AS balanced"


def _cover(g, p, balanced):
    n = p.agg(F.count("*").alias("n"), F.count_distinct("v").alias("d"), F.min("part").alias("a"), F.max("part").alias("b")).first()
    return g.spark.createDataFrame([(n["n"], n["n"] == n["d"] == g.num_nodes and n["a"] >= 0 and n["b"] < D, bool(balanced))], "nodes long, covered boolean, balanced boolean")


@query("part_clusters", "O", _LOADS_SQL.format("true"))
def _clusters(g, s):
    """Whole clusters, every vertex once; longest first is within 4/3 of the best, so of the greater of the mean and the largest cluster."""
    labels = I.label_propagation(g, 3)
    p = O.by_clusters(g, labels, D)
    w = S.degree(g).join(g.vertices(), "v").select("v", (F.col("deg") * F.col("fv")).alias("w"))
    load = w.join(p, "v").groupBy("part").agg(F.sum("w").alias("s")).agg(F.max("s"), F.sum("s")).first()
    largest = w.join(labels, "v").groupBy("label").agg(F.sum("w").alias("s")).agg(F.max("s")).first()[0]
    whole = labels.join(p, "v").groupBy("label").agg(F.count_distinct("part").alias("k")).where("k > 1").count() == 0
    return _cover(g, p, whole and load[0] <= 4 / 3 * max(load[1] / D, largest) + largest / 3)


@query("part_merged", "F", _LOADS_SQL.format("true"))
def _merged(g, s):
    """Sixteen blocks joined to four, whole ones, no more cut than the blocks' own."""
    b = P.by_locality(g, 16).select("v", "part")
    p = O.merged_blocks(g, b, D)
    cut = lambda x: M.placed(g, x).where("ps <> pd").count()
    whole = b.withColumnRenamed("part", "blk").join(p, "v").groupBy("blk").agg(F.count_distinct("part").alias("k")).where("k > 1").count() == 0
    return _cover(g, p, whole and cut(p) <= cut(b))


_CH = (
    ", ca AS (SELECT count(*) AS c FROM cells), k AS (SELECT greatest(1, floor(sqrt(c)))::BIGINT AS k FROM ca), sp AS (SELECT x.cell_id AS a, y.cell_id AS b FROM es e JOIN cells x ON x.v = src AND x.snap = e.snap JOIN cells y ON y.v = dst AND y.snap = e.snap WHERE src <> dst),"
    " tp AS (SELECT * FROM (SELECT lag(cell_id) OVER (PARTITION BY v ORDER BY snap) AS a, cell_id AS b FROM cells) WHERE a IS NOT NULL), pw AS (SELECT a, b, 2 AS w FROM sp UNION ALL SELECT b, a, 2 FROM sp UNION ALL SELECT a, b, 1 FROM tp UNION ALL SELECT b, a, 1 FROM tp),"
    " c0 AS (SELECT cell_id, v * (SELECT k FROM k) // (SELECT n FROM n) AS chunk FROM cells)"
    + "".join(f", c{i + 1} AS (SELECT c{i}.cell_id, coalesce(t.chunk, c{i}.chunk) AS chunk FROM c{i} LEFT JOIN (SELECT a, chunk FROM (SELECT a, chunk, row_number() OVER (PARTITION BY a ORDER BY sum(w) DESC, chunk) AS r FROM pw JOIN c{i} ON c{i}.cell_id = b GROUP BY a, chunk) WHERE r = 1) t ON t.a = c{i}.cell_id)" for i in range(2))
)
query("supra_chunks", "F", _CH + " SELECT cell_id, chunk FROM c2")(lambda g, s: O.supra_chunks(g, s).select("cell_id", "chunk"))
# Parts of these differ in size, so they cut less than even, unrelated ones do, or what they are for is lost; the hash's cut is a value.
_CUT_SQL = _HASH + " SELECT (SELECT n FROM n)::BIGINT AS nodes, true AS covered, count(*) FILTER (x.part <> y.part)::BIGINT AS hash_cut, true AS cuts_less FROM edges JOIN pl x ON x.v = src JOIN pl y ON y.v = dst"


def _cuts_less(g, p):
    p = kept(p.select("v", "part"), "parts")
    n = p.agg(F.count("*").alias("n"), F.count_distinct("v").alias("d"), F.min("part").alias("a"), F.max("part").alias("b")).first()
    cut = lambda x: M.placed(g, x).where("ps <> pd").count()
    base = cut(P.by_hash(g, D))
    return g.spark.createDataFrame([(n["n"], n["n"] == n["d"] == g.num_nodes and n["a"] >= 0 and n["b"] < D, base, cut(p) <= base)], "nodes long, covered boolean, hash_cut long, cuts_less boolean")


query("part_chunks", "F", _CUT_SQL)(lambda g, s: _cuts_less(g, O.by_chunks(g, s, [d[4] for d in Q._DEVS])))
query("feature_clusters", "F", _CUT_SQL)(lambda g, s: _cuts_less(g, O.feature_clusters(Q.X.features(g), D).withColumnRenamed("label", "part")))
query("spectral_parts", "F", _CUT_SQL)(lambda g, s: _cuts_less(g, O.spectral_parts(g, D)))


def _peek_sql(upto: int) -> str:
    """Blocks and cut of the label-propagation order of the first snapshots."""
    lpa = Q._LPA.replace("FROM sym GROUP BY 1, 2)", f"FROM sym WHERE snap < {upto} GROUP BY 1, 2)", 1).removeprefix(", ")
    return f"""(WITH {lpa}, sn AS (SELECT DISTINCT a AS v FROM sym WHERE snap < {upto}), lr AS (SELECT v, row_number() OVER (ORDER BY label, v) - 1 AS rank FROM l5), ir AS (SELECT v, row_number() OVER (ORDER BY rank, v) - 1 AS i FROM lr JOIN sn USING (v)),
pl AS (SELECT v, coalesce(i * 4 // (SELECT count(*) FROM sn), 0) AS part FROM verts LEFT JOIN ir USING (v)) SELECT (SELECT count(*) FROM sn)::BIGINT AS seen, count(*) FILTER (x.part <> y.part)::BIGINT AS cut FROM edges JOIN pl x ON x.v = src JOIN pl y ON y.v = dst)"""


query("peek_ahead", "F", " SELECT pct, p.seen, p.cut, q.cut AS peek_cut FROM (" + " UNION ALL ".join(f"SELECT {pct}::BIGINT AS pct, * FROM {_peek_sql(max(1, round(8 * pct / 100)))}" for pct in (25, 50)) + f") p, {_peek_sql(8)} q")(
    lambda g, s: O.prefix_cut(g, s, D, (25, 50), lambda x: I.label_rank(I.label_propagation(x, 5)))
)
query("undirected_pairs", "O", " SELECT count(*)::BIGINT AS pairs, sum(a)::BIGINT AS a_sum, sum(b)::BIGINT AS b_sum FROM (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM edges WHERE src <> dst)")(
    lambda g, s: O.undirected(g.edges).agg(F.count("*").alias("pairs"), F.sum("src").alias("a_sum"), F.sum("dst").alias("b_sum"))
)
