"""Queries on prices, memory, iterations, aggregation, arrangement and growth."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.scratch import kept
from ..operators import aggregate as X
from ..operators import cost as C
from ..operators import greedy as K
from ..operators import iterate as I
from ..operators import memory as R
from ..operators import metrics as M
from ..operators import placement as P
from ..operators import stats as S
from ..sources import graphs
from ..streaming import online as O
from . import arrange as A
from .structure_queries import _EC, _HASH, _PE, D, query as _query, QUERIES as _Q, ORACLE_SQL as _S

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
LINK = 50.0


def query(name, on, body=None):
    def add(fn):
        _query(name, on, body)(fn)
        QUERIES[name] = _Q.pop(name)
        if body is not None:
            ORACLE_SQL[name] = _S.pop(name)
        return fn

    return add


def table(name: str, sql: str | None = None):
    """Register a query that needs no graph."""

    def add(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(spark)
        if sql is not None:
            ORACLE_SQL[name] = sql
        return fn

    return add


_HET4 = C.devices_sql("het4")
_DEV = ", " + _HET4
_WORK = _PE + """, fw AS (SELECT dom.part, coalesce(inc_fw, 0) AS inc_fw, coalesce(comm_fw, 0) AS comm_fw FROM dom
LEFT JOIN (SELECT part, sum(fv) AS inc_fw FROM sym JOIN pl ON pl.v = a JOIN verts w ON w.v = b GROUP BY 1) USING (part) LEFT JOIN (SELECT part, sum(fv) AS comm_fw FROM hr JOIN verts ON v = b GROUP BY 1) USING (part))"""
_MS = "inc_fw * 8.0 / (hbm_bw_gbps * 1e9) * 1e3"
_SHIP = f"comm_fw * 8.0 / ({LINK} * 1e9) * 1e3"
query("predict_ms", "F", _HASH + _WORK + _DEV + f" SELECT part AS device, round({_MS}, 9) AS comp_ms, round({_SHIP}, 9) AS comm_ms, round({_MS} + {_SHIP}, 9) AS total_ms FROM fw JOIN devices ON id = part")(
    lambda g, s: C.predict_ms(M.feature_work(g, P.by_hash(g, D), D), C.devices(g.spark, "het4"), LINK)
)
query("preflight", "F", _HASH + _PE + _DEV + f""", mt AS ({_EC}), f AS (SELECT part AS device, ((nodes + halo) * 128 * 4 + incident * 20)::BIGINT AS footprint, usable_mem, incident * 5e-9 / throughput AS sec FROM mt JOIN devices ON id = part)
SELECT device, footprint, usable_mem - footprint AS headroom, usable_mem < footprint AS oom, round(sec, 12) AS compute_sec, sec = (SELECT max(sec) FROM f) AS straggler FROM f""")(
    lambda g, s: C.preflight(M.edgecut(g, P.by_hash(g, D), D).withColumnRenamed("incident", "edges"), C.devices(g.spark, "het4"), 128)
)
query("calibrate_weights", "O", _DEV + f""", p AS (SELECT sum(tv - 1) / (count(*) * 15) AS rho FROM (SELECT v, count(*) AS tv FROM cells GROUP BY v)), c AS (SELECT 128 * 2 * 4.0 / (min(hbm_bw_gbps) * 1e9) AS spe FROM devices)
SELECT round(spe * 1e9, 9) AS ns_per_edge, {round(4.0 * 128 * 2 / (LINK * 1e9) * 1e9, 9)}::DOUBLE AS w_s_ns, round(CASE WHEN rho > 0 THEN least({4.0 * 128 / (LINK * 1e9)}, spe * 2 * (1 - rho)) ELSE {4.0 * 128 / (LINK * 1e9)} END * 1e9, 9) AS w_t_ns FROM p, c""")(
    lambda g, s: C.calibrate(C.devices(g.spark, "het4"), S.persistence(g, s), LINK)
)


@query("decide_axis", "F", _DEV + """, k AS (SELECT (SELECT n FROM n)::DOUBLE AS n, (SELECT m FROM m)::DOUBLE AS e, 430e9 AS b, 50e9 AS l, 512.0 AS f),
c AS (SELECT 2 * 2 * (e / 4) * f * 4 / b * 1e3 + 2 * n * 3 / 4 * f * 4 / l * 1e3 AS node, 2 * 2 * e * (f / 4) * 4 / b * 1e3 + 2 * n * f * 4 / l * 1e3 AS feature,
2 * (2 * e / 2) * (f * 2 / 4) * 4 / b * 1e3 + 2 * (n / 2 / 2 + n / 2) * (f * 2 / 4) * 4 / l * 1e3 AS hybrid, 5 * (e / n) * 3 / 4 AS threshold FROM k)
SELECT round(node, 6) AS node_ms, round(feature, 6) AS feature_ms, round(hybrid, 6) AS hybrid_ms, round(threshold, 6) AS threshold, 512.0 > threshold AS relief,
CASE WHEN node <= feature AND node <= hybrid THEN 'node' WHEN feature <= hybrid THEN 'feature' ELSE 'hybrid' END AS axis FROM c""")  # fmt: skip
def _axis(g, s):
    a = C.decide_axis(g.num_nodes, g.num_edges, C.cluster_rows("het4"), 512, LINK)
    row = (round(a["node"], 6), round(a["feature"], 6), round(a["hybrid"], 6), round(a["threshold"], 6), a["relief"], a["axis"])
    return g.spark.createDataFrame([row], "node_ms double, feature_ms double, hybrid_ms double, threshold double, relief boolean, axis string")


query("feature_parallel_plan", "F", _DEV + """, w AS (SELECT *, sum(hbm_bw_gbps) OVER () AS tot, row_number() OVER (ORDER BY hbm_bw_gbps DESC, id) - 1 AS i FROM devices), b AS (SELECT *, floor(hbm_bw_gbps / tot * 130) AS base FROM w),
c AS (SELECT *, (base + CASE WHEN i < 130 - sum(base) OVER () THEN 1 ELSE 0 END)::BIGINT AS cols FROM b)
SELECT id, cols, round(2 * (SELECT m FROM m) * 8.0 * cols / (hbm_bw_gbps * 1e9) * 1e3, 9) AS compute_ms, round((SELECT n FROM n) * cols * 8.0 / 50e9 * 1e3, 9) AS integ_ms,
(cols * (SELECT n FROM n) * 4 + (SELECT m FROM m) * 20)::BIGINT AS resident, true AS fits FROM c""")(lambda g, s: C.feature_plan(g.num_nodes, g.num_edges, C.devices(g.spark, "het4"), 130, LINK))  # fmt: skip
query("hybrid_grids", "F", _DEV + """ SELECT 2::BIGINT AS dn, 2::BIGINT AS df, round(max(2.0 * (SELECT m FROM m) / 2 * 8.0 * 65 / (hbm_bw_gbps * 1e9) * 1e3 + ((SELECT n FROM n) // 2) * 65 * 8.0 / 50e9 * 1e3), 9) AS makespan_ms, true AS fits FROM devices""")(
    lambda g, s: C.grid_plans(g.num_nodes, g.num_edges, C.devices(g.spark, "het4"), 130, LINK)
)


def _ladder(k_mem: int) -> list[int]:
    ks, k = {k_mem * 64}, k_mem
    while k <= k_mem * 64:
        ks.add(k)
        k = max(k + 1, int(k * 1.4))
    return sorted(ks)


table("select_k", f"""WITH l(k) AS (VALUES {", ".join(f"({k}::BIGINT)" for k in _ladder(4))}), c AS (SELECT k, 100.0::DOUBLE / k + 0.05 * k + 0.0545 * log2(greatest(2, k)) + 0.045 AS ms FROM l)
SELECT k, round(ms, 9) AS ms, k = (SELECT arg_min(k, ms) FROM c) AS best FROM c""")(lambda spark: C.k_curve(spark, 100.0, 300 * C.GB, 80 * C.GB))  # fmt: skip
_LOADS = [(0, 2_000_000, 16_000_000, 128, 2, 2, 0.0), (1, 4_000_000, 40_000_000, 256, 2, 16, 0.0), (2, 4_000_000, 40_000_000, 256, 2, 16, 0.7), (3, 60_000_000, 600_000_000, 1024, 2, 1, 0.0)]
_LOAD = "w long, num_nodes long, num_edges long, feat_dim long, layers long, window long, reuse_frac double"
table("plan_memory", f"""WITH {C.devices_sql("het3")}, wl(w, num_nodes, num_edges, feat_dim, layers, wnd, reuse) AS (VALUES {", ".join(f"({a}::BIGINT, {b}::BIGINT, {c}::BIGINT, {d}::BIGINT, {e}::BIGINT, {f}::BIGINT, {h}::DOUBLE)" for a, b, c, d, e, f, h in _LOADS)}),
a AS (SELECT *, greatest(1, round_even(hbm_bw_gbps / (SELECT sum(hbm_bw_gbps) FROM devices) * num_nodes, 0)::BIGINT) AS n0 FROM wl, devices),
b AS (SELECT *, n0 + CASE WHEN id = 2 THEN num_nodes - sum(n0) OVER (PARTITION BY w) ELSE 0 END AS nodes FROM a),
c AS (SELECT *, round_even(num_edges * nodes / num_nodes, 0)::BIGINT AS edges, nodes * feat_dim * 4 AS one FROM b), d AS (SELECT *, one * (1 + layers) + edges * 12 AS per FROM c),
e AS (SELECT *, one * (3 + CASE WHEN 1.25 * (wnd * per + 3 * one) > usable_mem THEN 1 ELSE 0 END) AS ovh FROM d), f AS (SELECT *, floor((usable_mem / 1.25 - ovh) / per) AS fit FROM e),
g AS (SELECT *, fit >= 1 AS ok, CASE WHEN fit < 1 THEN 0 WHEN wnd > fit THEN least(greatest(1, fit - 1), wnd) ELSE wnd END::BIGINT AS resident FROM f), h AS (SELECT *, wnd - resident AS streamed FROM g),
i AS (SELECT *, CASE WHEN ok THEN (1 + (wnd - 1) * (1 - reuse)) * layers * 2 * edges * feat_dim * 4 / (hbm_bw_gbps * 1e9) ELSE 0 END AS cs, CASE WHEN ok THEN streamed * (1 - reuse) * one / (h2d_gbps * 1e9) ELSE 0 END AS ss FROM h)
SELECT w, id::BIGINT AS device, nodes::BIGINT AS nodes, edges, resident, streamed::BIGINT AS streamed, CASE WHEN ok THEN floor(1.25 * (least(resident + CASE WHEN streamed > 0 THEN 1 ELSE 0 END, wnd) * per + ovh)) ELSE per END::BIGINT AS peak, ok AS feasible,
round(cs, 9) AS compute_sec, round(ss, 9) AS staging_sec, round(greatest(0.0, ss - cs), 9) AS exposed_sec FROM i""")(lambda spark: R.plan_memory(spark.createDataFrame(_LOADS, _LOAD), C.devices(spark, "het3")))  # fmt: skip
_CAPS = [(0, 50_000), (1, 400_000), (2, 10_000_000), (3, 100)]
query("fv_spill", "F", _HASH + f""", caps(part, cap) AS (VALUES {", ".join(f"({a}, {b})" for a, b in _CAPS)}), r AS (SELECT part, v, fv * 12 AS b FROM pl JOIN verts USING (v)),
x AS (SELECT part, b, sum(b) OVER (PARTITION BY part ORDER BY b DESC, v) - b AS before, sum(b) OVER (PARTITION BY part) - cap AS need FROM r JOIN caps USING (part))
SELECT part, count(*)::BIGINT AS spilled, sum(b)::BIGINT AS spilled_bytes FROM x WHERE before < need OR before = 0 GROUP BY 1""")(
    lambda g, s: R.fv_spill(P.by_hash(g, D).join(g.vertices(), "v"), g.spark.createDataFrame(_CAPS, "part long, cap long"))
)
_SEQ = "seq AS (SELECT ((p % 30) // 3 * 1 + p % 3)::BIGINT AS unit, p AS pos FROM (SELECT unnest(range(0, 90)) AS p))"
table("access_sequence", f"WITH {_SEQ} SELECT pos, unit FROM seq")(lambda spark: R.access_sequence(spark, 12, 3, 1, 3))
table("next_use", f"WITH {_SEQ} SELECT pos, unit, lead(pos) OVER (PARTITION BY unit ORDER BY pos) AS next FROM seq")(lambda spark: R.next_use(R.access_sequence(spark, 12, 3, 1, 3)))
table("naive_misses", f"WITH {_SEQ} SELECT count(*) FILTER (r <= 4)::BIGINT AS pinned, sum(CASE WHEN r <= 4 THEN 1 ELSE c END)::BIGINT AS misses FROM (SELECT count(*) AS c, row_number() OVER (ORDER BY min(pos)) AS r FROM seq GROUP BY unit)")(
    lambda spark: R.naive_misses(R.access_sequence(spark, 12, 3, 1, 3), 4)
)
#: The state is the list of (value, unit) that a cache holds, in the order in which they came; the greatest value goes, the first of equals.
_CACHE = """WITH RECURSIVE {seq}, ac AS (SELECT pos, unit, coalesce(lead(pos) OVER w, 1000000)::DOUBLE AS nxt, (pos - lag(pos) OVER w)::DOUBLE AS gap FROM seq WINDOW w AS (PARTITION BY unit ORDER BY pos)),
vl AS (SELECT pos::BIGINT AS pos, unit, {value} AS val FROM ac), dv AS (SELECT unnest(range(0, 4)) AS device),
st(device, slots, pos, units, vals, hits, misses, evictions) AS (SELECT device, device + 2, 0::BIGINT, []::BIGINT[], []::DOUBLE[], 0::BIGINT, 0::BIGINT, 0::BIGINT FROM dv UNION ALL
SELECT device, slots, st.pos + 1,
CASE WHEN list_contains(units, unit) THEN units WHEN len(units) < slots THEN list_append(units, unit) ELSE list_append(units[: list_position(vals, list_max(vals)) - 1] || units[list_position(vals, list_max(vals)) + 1 :], unit) END,
CASE WHEN list_contains(units, unit) THEN vals[: list_position(units, unit) - 1] || [val] || vals[list_position(units, unit) + 1 :] WHEN len(units) < slots THEN list_append(vals, val) ELSE list_append(vals[: list_position(vals, list_max(vals)) - 1] || vals[list_position(vals, list_max(vals)) + 1 :], val) END,
hits + list_contains(units, unit)::BIGINT, misses + (NOT list_contains(units, unit))::BIGINT, evictions + (NOT list_contains(units, unit) AND len(units) >= slots)::BIGINT FROM st JOIN vl ON vl.pos = st.pos)
SELECT device::BIGINT AS device, slots::BIGINT AS slots, hits, misses, evictions FROM st WHERE pos = 90"""
for _p, _v in (("belady", "nxt"), ("mrd", "coalesce(gap, 90)")):
    table(f"{_p}_misses", _CACHE.format(seq=_SEQ, value=_v))(lambda spark, p=_p: R.cache_misses(R.next_use(R.access_sequence(spark, 12, 3, 1, 3)).withColumn("device", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long")))).withColumn("slots", F.col("device") + 2), p))
_REQ = [(0, 80e9, 3.81e9, 47.7, 50.1, 60e9, 3.81e9), (1, 80e9, 3.81e9, 120.0, 50.0, 74e9, 3.81e9), (2, 10e9, 1e9, 47.7, 50.1, 8e9, 4e9), (3, 10e9, 1e9, 120.0, 50.0, 8e9, 4e9), (4, 80e9, 1e9, 47.7, 50.1, 67e9, 3e9), (5, 80e9, 1e9, 47.7, 50.1, 71e9, 3e9)]
table("watermark_admit", f"""WITH q(id, cap, increment, fill, evict, resident, alloc) AS (VALUES {", ".join("(" + ", ".join(f"{x}::{t}" for x, t in zip(map(lambda y: int(y) if float(y).is_integer() and y > 1000 else y, r), ("BIGINT", "BIGINT", "BIGINT", "DOUBLE", "DOUBLE", "BIGINT", "BIGINT"), strict=True)) + ")" for r in _REQ)})
SELECT *, CASE WHEN alloc > cap - resident OR resident + alloc > floor(0.9 * cap) THEN evict >= fill ELSE true END AS admit,
(CASE WHEN alloc > cap - resident THEN alloc - (cap - resident) WHEN resident + alloc > floor(0.85 * cap) THEN greatest(0, resident + alloc - floor(0.70 * cap)) ELSE 0 END)::BIGINT AS spill FROM q""")(
    lambda spark: R.admission(spark.createDataFrame([(i, int(a), int(b), c, d, int(e), int(f)) for i, a, b, c, d, e, f in _REQ], "id long, cap long, increment long, fill double, evict double, resident long, alloc long"))
)
table("control_loop", """WITH RECURSIVE inc AS (SELECT id % 3 AS device, 20e9::DOUBLE AS cap, id // 3 AS step, ((1 + id % 3) * 1.5e9)::DOUBLE AS bytes FROM (SELECT unnest(range(0, 60)) AS id)),
s0 AS (SELECT DISTINCT device, -1::BIGINT AS step, 0.0::DOUBLE AS admitted, 0.0::DOUBLE AS carry, 0.0::DOUBLE AS evicted, 0.0::DOUBLE AS resident FROM inc),
st AS (SELECT * FROM s0 UNION ALL SELECT device, step, adm, more - adm, ev + ex, mid + adm - ex FROM (
SELECT *, CASE WHEN more - adm > 0 AND ev < 50.1e9 * 0.08 THEN least(50.1e9 * 0.08 - ev, greatest(0.0, mid + adm - 0.7 * cap)) ELSE 0.0 END AS ex FROM (
SELECT *, least(more, greatest(0.0, 0.92 * cap - mid)) AS adm FROM (
SELECT inc.device, inc.step, cap, bytes + carry AS more, resident - e AS mid, e AS ev FROM (
SELECT inc.*, carry, resident, CASE WHEN resident > 0.9 * cap THEN least(resident - 0.7 * cap, 50.1e9 * 0.08) ELSE 0.0 END AS e FROM st JOIN inc ON inc.device = st.device AND inc.step = st.step + 1) inc)))),
last AS (SELECT max(step) AS s FROM inc),
dr AS (SELECT device, step, admitted, carry, evicted, resident FROM st WHERE step >= 0)
SELECT device::BIGINT AS device, step::BIGINT AS step, round(admitted, 3) AS admitted, round(carry, 3) AS deferred, round(evicted, 3) AS evicted, round(resident, 3) AS resident, carry > 0 AS backpressure FROM dr""")(lambda spark: R.control_loop(spark.range(60).selectExpr("id % 3 AS device", "cast(20e9 AS double) AS cap", "id div 3 AS step", "cast((1 + id % 3) * 1.5e9 AS double) AS bytes"), drain=False).select("device", "step", *[F.round(c, 3).alias(c) for c in ("admitted", "deferred", "evicted", "resident")], "backpressure"))
table("control_loop_drained", "SELECT device::BIGINT AS device, round(20 * (1 + device) * 1.5e9, 0)::DOUBLE AS asked, true AS all_admitted, true AS nothing_left FROM (SELECT unnest(range(0, 3)) AS device)")(
    lambda spark: R.control_loop(spark.range(60).selectExpr("id % 3 AS device", "cast(20e9 AS double) AS cap", "id div 3 AS step", "cast((1 + id % 3) * 1.5e9 AS double) AS bytes"))
    .groupBy("device").agg(F.round(F.sum("admitted"), 0).alias("got"), F.max_by("deferred", "step").alias("rest"))
    .select("device", F.round(20 * (1 + F.col("device")) * 1.5e9, 0).alias("asked"), (F.abs(F.col("got") - 20 * (1 + F.col("device")) * 1.5e9) < 1).alias("all_admitted"), (F.col("rest") == 0).alias("nothing_left"))
)
table("latency_fit", """WITH p AS (SELECT w, ceil(log2(w))::DOUBLE AS x, (0.05 * ceil(log2(w)) + 0.04 + (w % 3) * 0.001)::DOUBLE AS ms FROM (SELECT unnest([2, 4, 8, 16, 32, 64]) AS w))
SELECT round(regr_slope(ms, x), 6) AS alpha, round(regr_intercept(ms, x), 6) AS beta, round(regr_r2(ms, x), 6) AS r2 FROM p""")(lambda spark: S.latency_fit(spark.createDataFrame([(w,) for w in (2, 4, 8, 16, 32, 64)], "w long").selectExpr("w", "0.05D * ceil(log2(w)) + 0.04D + (w % 3) * 0.001D AS ms")))  # fmt: skip
table("exposed_comm", "SELECT id AS comm, round(10.0::DOUBLE + greatest(0.0::DOUBLE, id - 0.5 * 10), 6) AS ms FROM (SELECT unnest(range(0, 20)) AS id)")(
    lambda spark: spark.range(20).select(F.col("id").alias("comm"), F.round(C.exposed_ms(F.lit(10.0), F.col("id").cast("double"), F.lit(0.5)), 6).alias("ms"))
)

# Iterations, unrolled in SQL.
_W = ", wsym AS (SELECT a, b, count(*) AS w FROM sym GROUP BY 1, 2), l0 AS (SELECT v, v AS label FROM verts)"
_LPA = _W + "".join(f""", v{k} AS (SELECT a, label, sum(w) AS c FROM wsym JOIN l{k} ON l{k}.v = b GROUP BY 1, 2), b{k} AS (SELECT a, label FROM (SELECT a, label, row_number() OVER (PARTITION BY a ORDER BY c DESC, label) AS r FROM v{k}) WHERE r = 1),
l{k + 1} AS (SELECT l{k}.v, coalesce(b{k}.label, l{k}.label) AS label FROM l{k} LEFT JOIN b{k} ON a = l{k}.v)""" for k in range(5))  # fmt: skip
query("lpa_labels_r5", "O", _LPA + " SELECT label, count(*)::BIGINT AS size FROM l5 GROUP BY 1")(lambda g, s: I.label_propagation(g, 5).groupBy("label").agg(F.count("*").alias("size")))
query("clusterability", "O", _LPA + """, bd AS (SELECT v, (row_number() OVER (ORDER BY label, v) - 1) * round(sqrt((SELECT n FROM n)))::BIGINT // (SELECT n FROM n) AS band FROM l5),
e2 AS (SELECT x.band AS x, y.band AS y FROM edges JOIN bd x ON x.v = src JOIN bd y ON y.v = dst), q AS (SELECT count(*) FILTER (x = y) / count(*) AS w, count(*) AS m FROM e2),
z AS (SELECT sum(c * c) AS sq FROM (SELECT band, count(*) AS c FROM (SELECT unnest([x, y]) AS band FROM e2) GROUP BY 1))
SELECT round(greatest(0.0, least(1.0, (w - sq / (4 * m * m)) / (1 - sq / (4 * m * m)))), 6) AS score FROM q, z""")(lambda g, s: I.clusterability(g, I.label_rank(I.label_propagation(g, 5))))  # fmt: skip
_H = ", ssym AS (SELECT DISTINCT a, b FROM sym WHERE a <> b), h0 AS (SELECT v, count(b)::BIGINT AS core FROM verts LEFT JOIN ssym ON a = v GROUP BY v)" + "".join(
    f", h{k + 1} AS (SELECT h{k}.v, coalesce(h, core) AS core FROM h{k} LEFT JOIN (SELECT a, max(least(core, r))::BIGINT AS h FROM (SELECT a, core, row_number() OVER (PARTITION BY a ORDER BY core DESC, b) AS r FROM ssym JOIN h{k} ON h{k}.v = b) GROUP BY a) ON a = h{k}.v)" for k in range(6)
)
query("coreness", "F", _H + " SELECT core, count(*)::BIGINT AS vertices FROM h6 GROUP BY 1")(lambda g, s: I.coreness(g, 6).groupBy("core").agg(F.count("*").alias("vertices")))
query("coreness_fixpoint", "O")(lambda g, s: I.coreness(g).groupBy("core").agg(F.count("*").alias("vertices")))
_EAR = ", ends AS (SELECT DISTINCT pos, unnest([src, dst]) AS v FROM edges), ear AS (SELECT pos, coalesce(max(l), -1)::BIGINT AS ear FROM (SELECT pos, lag(pos) OVER (PARTITION BY v ORDER BY pos) AS l FROM ends) GROUP BY pos)"
query("event_ear", "F", _EAR + " SELECT pos, ear FROM ear")(lambda g, s: I.event_ears(g.edges))
query("event_depth", "F", _EAR.replace(", ends", ", RECURSIVE_MARK ends", 1) + " SELECT 1")(lambda g, s: I.event_depth(I.event_ears(g.edges)))
ORACLE_SQL["event_depth"] = graphs.sql_prefix("F", 8).replace("WITH n AS", "WITH RECURSIVE n AS", 1) + _EAR + ", dp(pos, depth) AS (SELECT pos, 0::BIGINT FROM ear WHERE ear < 0 UNION ALL SELECT ear.pos, depth + 1 FROM dp JOIN ear ON ear.ear = dp.pos) SELECT pos, depth FROM dp"
query("changed_cone", "O", "SELECT DISTINCT unnest([src, dst]) AS v FROM edges WHERE pos >= (SELECT m FROM m) * 99 // 100")(lambda g, s: I.changed_cone(g.edges, g.num_edges * 99 // 100))
query("breadth_first", "O", ", ssym AS (SELECT DISTINCT a, b FROM sym WHERE a <> b) SELECT 1")(lambda g, s: I.breadth_first(g).groupBy("level").agg(F.count("*").alias("vertices")))
ORACLE_SQL["breadth_first"] = graphs.sql_prefix("O", 16).replace("WITH n AS", "WITH RECURSIVE n AS", 1) + """, ssym AS (SELECT DISTINCT a, b FROM sym WHERE a <> b), root AS (SELECT a FROM ssym GROUP BY a ORDER BY count(*) DESC, a LIMIT 1),
bf(v, level) AS (SELECT a, 0::BIGINT FROM root UNION SELECT b, level + 1 FROM bf JOIN ssym ON a = v WHERE level < (SELECT n FROM n)) SELECT level, count(*)::BIGINT AS vertices FROM (SELECT v, min(level) AS level FROM bf GROUP BY v) GROUP BY 1"""
query("spectral_gap", "F")(lambda g, s: I.spectral_gap(g))

# Aggregation.
_FEAT = ", x0 AS (SELECT v, c, ((v * 7 + c * 13) % 11)::BIGINT AS x FROM verts, (SELECT unnest(range(0, 8)) AS c))"
query("agg_sum_1layer", "F", _FEAT + " SELECT x0.v, x0.c, coalesce(s, 0)::BIGINT AS x FROM x0 LEFT JOIN (SELECT a AS v, c, sum(x) AS s FROM sym JOIN x0 ON x0.v = b GROUP BY 1, 2) USING (v, c)")(lambda g, s: X.neighbour_sum(g, X.features(g)))
for _name, _loops in (("agg_mean_2layer", False), ("agg_mean_loops_2layer", True)):
    _e = "(SELECT a, b FROM sym UNION ALL SELECT v, v FROM verts)" if _loops else "(SELECT a, b FROM sym)"
    query(
        _name,
        "F",
        _FEAT + f", e1 AS {_e}, dg AS (SELECT a AS v, count(*) AS d FROM e1 GROUP BY 1)" + "".join(f", x{k + 1} AS (SELECT x{k}.v, x{k}.c, greatest(0.0, coalesce(s / d, 0.0)) AS x FROM x{k} LEFT JOIN (SELECT a AS v, c, sum(x) AS s FROM e1 JOIN x{k} ON x{k}.v = b GROUP BY 1, 2) USING (v, c) LEFT JOIN dg USING (v))" for k in range(2)) + " SELECT v, c, round(x, 6) AS x FROM x2",
    )(lambda g, s, loops=_loops: X.neighbour_mean(g, X.features(g), 2, loops).withColumn("x", F.round("x", 6)))


def _matrix(g):
    return g.spark.range(64).selectExpr("id div 8 AS i", "id % 8 AS j", "(id * 5) % 7 - 3 AS w")


query("sharded_equals_reference", "F", "SELECT ((SELECT n FROM n) * 8)::BIGINT AS rows, 0::BIGINT AS max_abs_diff")(lambda g, s: X.largest_difference(X.sharded_layer(g, X.features(g), _matrix(g), 3), X.dense(X.neighbour_sum(g, X.features(g)), _matrix(g))))
query("placement_equals_reference", "F", "SELECT ((SELECT n FROM n) * 8)::BIGINT AS rows, 0::BIGINT AS max_abs_diff")(lambda g, s: X.largest_difference(X.partitioned_sum(g, X.features(g), P.by_hash(g, D)), X.neighbour_sum(g, X.features(g))))

# Arrangement.
_SHARE = lambda ws: " + ".join(f"CASE WHEN r >= (SELECT count(*) FROM o WHERE p * {sum(ws)} < {sum(ws[:k])} * tot) THEN 1 ELSE 0 END" for k in range(1, len(ws)))
_DEVS = C.cluster_rows("het4")
_O = ", o AS (SELECT deg.v, fv, row_number() OVER (ORDER BY deg DESC, deg.v) - 1 AS r, sum({w}) OVER (ORDER BY deg DESC, deg.v) AS p, sum({w}) OVER () AS tot FROM deg JOIN verts USING (v))"
_OT = ", o AS (SELECT v, fv, row_number() OVER (ORDER BY f, v) - 1 AS r, sum(deg) OVER (ORDER BY f, v) AS p, sum(deg) OVER () AS tot FROM (SELECT deg.v, deg, fv, coalesce(f, 9) AS f FROM deg JOIN verts USING (v) LEFT JOIN (SELECT v, min(snap) AS f FROM cells GROUP BY v) USING (v)))"


def _cand(name: str, order: str, ws: list[int]) -> str:
    body = order + f", pl AS (SELECT v, ({_SHARE(ws)})::BIGINT AS part FROM o)" + _WORK + f""", m AS ({_EC}), mem AS (SELECT part, sum(fv) * 4 AS bytes FROM pl JOIN verts USING (v) GROUP BY 1)
SELECT '{name}' AS cand, max(cut)::BIGINT AS cut, max(round({_MS} + {_SHIP}, 9)) AS makespan_ms, round(max(incident) / avg(incident), 6) AS imbalance, min(bytes + incident * 20.0 <= usable_mem) AS feasible
FROM m JOIN fw USING (part) JOIN mem USING (part) JOIN devices ON id = part"""
    return "SELECT * FROM (WITH " + body.removeprefix(", ").replace(", m AS (", ", mm AS (").replace("FROM m JOIN fw", "FROM mm JOIN fw") + ")"


_CANDS = " UNION ALL ".join(
    [
        _cand("edge-cut(hetero)", _O.format(w="deg"), A.shares(_DEVS, 7)),
        _cand("edge-cut(feat-aware)", _O.format(w="fv"), A.shares(_DEVS, 3)),
        _cand("spatial(PSS)", _O.format(w="deg"), [1] * 4),
        _cand("temporal(PTS)", _OT, [1] * 4),
    ]
)
query("arrange_candidates", "F", _DEV + f", cands AS ({_CANDS}) SELECT * FROM cands")(lambda g, s: A.candidates(g, s, _DEVS, LINK))
query("arrange_pick", "F", _DEV + f", cands AS ({_CANDS}) SELECT * FROM cands ORDER BY NOT (feasible AND imbalance <= 2.5), CASE WHEN feasible AND imbalance <= 2.5 THEN makespan_ms ELSE imbalance END, cand LIMIT 1")(lambda g, s: A.pick(A.candidates(g, s, _DEVS, LINK), D))
def _arranged(g, s):
    """Of all candidates, the winner is feasible, and none that is feasible and balanced is cheaper."""
    a = A.arrange(g, s, _DEVS, LINK)
    c = {r["cand"]: r for r in a.candidates.collect()}
    own = [n for n in c if not n.startswith("vertex-cut") and "floor" not in n]
    rivals = [r["makespan_ms"] for r in c.values() if r["feasible"] and (r["imbalance"] <= 0.5 * D + 0.5 or "floor" in r["cand"])]
    homes = a.place.agg(F.count("*").alias("n"), F.count_distinct("v").alias("d")).first()
    whole = homes["n"] == homes["d"] == g.num_nodes - (a.core.count() if a.core is not None else 0)
    row = (len(own), A.FLOOR in c, c[a.name]["feasible"], c[a.name]["makespan_ms"] <= min(rivals, default=float("inf")), whole)
    return g.spark.createDataFrame([row], "edge_cuts long, floor boolean, feasible boolean, cheapest boolean, covered boolean")


query("arrange_all", "F", " SELECT 4::BIGINT AS edge_cuts, true AS floor, true AS feasible, true AS cheapest, true AS covered")(_arranged)
query("plan_devices", "F", _DEV + " SELECT id AS part, true AS fits, true AS one_winner, true AS priced FROM devices")(
    lambda g, s: A.plan(g, s, "het4", LINK).withColumn("k", F.count("*").over(Window.partitionBy("winner"))).select("part", (F.col("headroom") > 0).alias("fits"), (F.col("k") == D).alias("one_winner"), (F.col("total_ms") > 0).alias("priced"))
)
query("schedule", "F", _DEV + f""", k AS (SELECT (SELECT n FROM n)::DOUBLE AS n, (SELECT m FROM m)::DOUBLE AS e, 430e9 AS b, 50e9 AS l, 128.0 AS f),
c AS (SELECT 2 * 2 * (e / 4) * f * 4 / b * 1e3 + 2 * n * 3 / 4 * f * 4 / l * 1e3 AS node, 2 * 2 * e * (f / 4) * 4 / b * 1e3 + 2 * n * f * 4 / l * 1e3 AS feature, 2 * (2 * e / 2) * (f * 2 / 4) * 4 / b * 1e3 + 2 * (n / 2 / 2 + n / 2) * (f * 2 / 4) * 4 / l * 1e3 AS hybrid FROM k),
p AS (SELECT sum(tv - 1) / (count(*) * 7) AS rho FROM (SELECT v, count(*) AS tv FROM cells GROUP BY v)), w AS (SELECT 128 * 2 * 4.0 / (min(hbm_bw_gbps) * 1e9) AS spe FROM devices)
SELECT CASE WHEN node <= feature AND node <= hybrid THEN 'node' WHEN feature <= hybrid THEN 'feature' ELSE 'hybrid' END AS axis, true AS feasible, {round(4.0 * 128 * 2 / (LINK * 1e9) * 1e9, 9)}::DOUBLE AS w_s_ns,
round(CASE WHEN rho > 0 THEN least({4.0 * 128 / (LINK * 1e9)}, spe * 2 * (1 - rho)) ELSE {4.0 * 128 / (LINK * 1e9)} END * 1e9, 9) AS w_t_ns, true AS job_is_epochs FROM c, p, w""")(
    lambda g, s: A.schedule(g, s, "het4", LINK).select("axis", "feasible", "w_s_ns", "w_t_ns", (F.abs(F.col("job_ms") - 10 * F.col("makespan_ms")) < 1e-5).alias("job_is_epochs"))
)
_LPA3 = _LPA.split(", v3 AS (")[0]
query("part_locality_split_lpa", "O", _LPA3 + """, rk AS (SELECT v, row_number() OVER (ORDER BY label, v) AS rank FROM l3), o AS (SELECT v, deg AS work, row_number() OVER (ORDER BY rank) - 1 AS r, sum(deg) OVER (ORDER BY rank) AS p, sum(deg) OVER () AS tot FROM deg JOIN rk USING (v)),
ct AS (SELECT k, count(*) FILTER (p * 4 < k * tot) AS c FROM o, (VALUES (1), (2), (3)) x(k) GROUP BY k) SELECT (SELECT count(*) FROM ct WHERE c <= r)::BIGINT AS part, count(*)::BIGINT AS nodes, sum(work)::BIGINT AS work FROM o GROUP BY 1""")(lambda g, s: P.by_locality(g, D, I.label_rank(I.label_propagation(g, 3))).groupBy("part").agg(F.count("*").alias("nodes"), F.sum("work").alias("work")))


# Growth and order.
def _since(g):
    return g.num_edges * 95 // 100


query("incremental_touch_set", "O", _HASH + _PE + """, tc AS (SELECT DISTINCT unnest([src, dst]) AS v FROM edges WHERE pos >= (SELECT m FROM m) * 95 // 100), cd AS (SELECT v, count(*) AS c FROM (SELECT unnest([src, dst]) AS v FROM pe WHERE ps <> pd) GROUP BY 1)
SELECT v FROM tc LEFT JOIN cd USING (v) ORDER BY coalesce(c, 0) DESC, v LIMIT (SELECT (n * 5 // 100)::BIGINT FROM n)""")(lambda g, s: K.touch_set(g, P.by_hash(g, D), _since(g), 0.05))  # fmt: skip
_count = lambda p: p.groupBy("part").agg(F.count("*").alias("nodes"))
_SOUND = "SELECT (SELECT n FROM n)::BIGINT AS nodes, true AS covered, true AS within_cap, true AS no_worse"


def _sound(g, place, parts, cap, against=None):
    """nodes, covered (each vertex once, on a part), within_cap, no_worse: its cut at most that of another placement."""
    p = place.select("v", "part")
    n = p.agg(F.count("*").alias("n"), F.count_distinct("v").alias("d"), F.min("part").alias("a"), F.max("part").alias("b")).first()
    cut = lambda x: M.placed(g, x).where("ps <> pd").count()
    most = _count(p).agg(F.max("nodes")).first()[0]
    row = (n["n"], n["n"] == n["d"] == g.num_nodes and n["a"] >= 0 and n["b"] < parts, most <= cap, against is None or cut(p) <= cut(against))
    return g.spark.createDataFrame([row], "nodes long, covered boolean, within_cap boolean, no_worse boolean")


@query("incremental_plan", "O", " SELECT true AS few_moved, 0::BIGINT AS added, true AS bytes_follow, true AS covered, true AS within_cap")
def _incremental(g, s):
    """At most the budget and the spilled vertices move, none is new, and parts stay within their cap."""
    prior = P.by_hash(g, D)
    p = kept(K.incremental(g, prior, _since(g), D), "incremental")
    m, n = K.migration(prior, p, 128).first(), _sound(g, p, D, g.num_nodes // D + 1).first()
    row = (m["moved"] <= 2 * int(0.05 * g.num_nodes) + D, m["added"], m["bytes"] == m["moved"] * 128 * 4, n["covered"], n["within_cap"])
    return g.spark.createDataFrame([row], "few_moved boolean, added long, bytes_follow boolean, covered boolean, within_cap boolean")


query("online_assign_batches", "O", _SOUND)(lambda g, s: _sound(g, kept(K.online(g, D, batches=8), "online"), D, g.num_nodes, P.by_hash(g, D)))


@query("run_stream_trace", "E", ", z AS (SELECT ceil((SELECT m FROM m) / 5.0)::BIGINT AS z) SELECT k::BIGINT AS step, k = 0 AS cold, least((k + 1) * z, (SELECT m FROM m)) - k * z AS edges, true AS rule FROM z, (SELECT unnest(range(0, 5)) AS k)")
def _trace(g, s):
    """The first step is cold and places all; later ones refresh when the drift is over its limit or the placement is stale."""
    r = O.run_stream(g, 5, D)
    before = F.lag("reason", 1, "none").over(Window.orderBy("step"))  # one row a window
    late = (F.col("reason") == "drift") & (F.col("drift") > O.DRIFT) | (F.col("reason") == "stale") & (before == "reuse") & (F.col("drift") <= O.DRIFT) | (F.col("reason") == "reuse") & (before != "reuse") & (F.col("drift") <= O.DRIFT)
    rule = F.when(F.col("step") == 0, (F.col("reason") == "cold") & (F.col("added") == g.num_nodes)).otherwise(late)
    return r.select("step", (F.col("reason") == "cold").alias("cold"), "edges", rule.alias("rule"))


query("arrange_blocks", "F", _SOUND)(lambda g, s: _sound(g, O.blockwise(g, 3, D), D, g.num_nodes))
#: One vertex a step, in order of id: its votes by part, the scores, and the first of the best.
_STREAM = """, nb AS (SELECT a AS v, list(b) AS near FROM sym WHERE a <> b GROUP BY 1), k AS (SELECT (SELECT n FROM n)::DOUBLE AS n, (SELECT m FROM m)::DOUBLE AS m),
st AS (SELECT mode, 0::BIGINT AS v, []::BIGINT[] AS part, [0, 0, 0, 0]::DOUBLE[] AS load FROM (VALUES ('fennel'), ('ldg')) x(mode) UNION ALL
SELECT mode, v + 1, list_append(part, best - 1), list_transform(range(1, 5), lambda p: load[p] + CASE WHEN p = best THEN 1 ELSE 0 END) FROM
(SELECT mode, v, part, load, list_position(score, list_max(score)) AS best FROM (SELECT mode, v, part, load, list_transform(range(1, 5), lambda p: CASE WHEN mode = 'fennel' THEN
CASE WHEN p > 1 AND load[p] >= 1.1 * (n / 4) THEN -1e300 ELSE votes[p] - (m * pow(4, 0.5) / pow(n, 1.5) * 1.5) * pow(load[p], 0.5) END ELSE votes[p] * greatest(0, 1 - load[p] / (n / 4)) - 1e-9 * load[p] END) AS score
FROM (SELECT st.*, list_transform(range(0, 4), lambda p: len(list_filter(coalesce(near, []), lambda x: x < st.v AND part[x + 1] = p))::DOUBLE) AS votes FROM st LEFT JOIN nb ON nb.v = st.v WHERE st.v < (SELECT n FROM n)) q, k) q) q)
SELECT mode, unnest(range(0, 4))::BIGINT AS part, unnest(list_transform(range(0, 4), lambda p: len(list_filter(part, lambda x: x = p))))::BIGINT AS nodes FROM st WHERE v = (SELECT n FROM n)"""
query("fennel_ldg_stream", "F", _STREAM)(
    lambda g, s: K.streamed(g, D).groupBy("mode", "part").agg(F.count("*").alias("nodes")).join(g.spark.createDataFrame([(m, p) for m in ("fennel", "ldg") for p in range(D)], "mode string, part long"), ["mode", "part"], "right").fillna(0)
)
ORACLE_SQL["fennel_ldg_stream"] = ORACLE_SQL["fennel_ldg_stream"].replace("WITH n AS", "WITH RECURSIVE n AS", 1)


@query("hdrf_stream", "F", "SELECT b::DOUBLE AS balance, (SELECT m FROM m) AS edges, true AS covered, true AS even, true AS fewer_copies FROM (VALUES (0.5), (1.0), (2.0)) x(b)")
def _hdrf(g, s):
    """Every edge on one part; sizes even where balance counts, and fewer copies of vertices than dealing edges out gives."""
    e = K.edge_streamed(g, D, (0.5, 1.0, 2.0))
    size = e.groupBy("balance", "part").agg(F.count("*").alias("c")).groupBy("balance").agg(F.sum("c").alias("edges"), F.max("c").alias("most"), F.min("part").alias("a"), F.max("part").alias("b"))
    copies = e.select("balance", "part", F.explode(F.array("src", "dst")).alias("v")).distinct().groupBy("balance").agg(F.count("*").alias("copies"))
    dealt = g.edges.select((F.col("pos") % D).alias("part"), F.explode(F.array("src", "dst")).alias("v")).distinct().count()
    covered = (F.col("edges") == g.num_edges) & (F.col("a") >= 0) & (F.col("b") < D)
    return size.join(copies, "balance").select("balance", "edges", covered.alias("covered"), ((F.col("balance") <= 1) | (F.col("most") <= 1.1 * F.col("edges") / D + 1)).alias("even"), (F.col("copies") <= dealt).alias("fewer_copies"))


query("multilevel_part", "O", _SOUND)(lambda g, s: _sound(g, kept(K.multilevel(g, D), "multilevel"), D, 1.03 * g.num_nodes / D + 20, K.streamed(g, D, ("ldg",))))


@query("polish_part", "F", _SOUND)
def _polish(g, s):
    e = g.edges.where("src <> dst").groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.count("*").alias("w"))
    start, cap = P.by_hash(g, D), 1.05 * g.num_nodes / D
    return _sound(g, K.refined(e, start.withColumn("w", F.lit(1).cast("long")), D, cap), D, cap, start)


@query("two_level_part", "F", "SELECT (SELECT n FROM n)::BIGINT AS nodes, true AS covered, true AS within_cap, true AS no_worse")
def _two(g, s):
    """Groups by parts: 2 by 2, each vertex once, a part within a few per cent of a quarter."""
    p = kept(K.two_level(g, 2, 2).select("v", (F.col("grp") * 2 + F.col("part")).alias("part")), "two-level")
    return _sound(g, p, D, 1.03 * 1.05 * g.num_nodes / D + 3)


#: One vertex a step, in the order of degree: the part that is free first, by lists of times, counts and sums.
_LPT = """, o AS (SELECT deg, row_number() OVER (ORDER BY deg DESC, v)::BIGINT AS r FROM deg), sp AS (SELECT [2.13, 1.47, 1.47, 1.0]::DOUBLE[] AS s),
st AS (SELECT 0::BIGINT AS r, [0, 0, 0, 0]::BIGINT[] AS c, [0, 0, 0, 0]::BIGINT[] AS w, [0, 0, 0, 0]::BIGINT[] AS z UNION ALL
SELECT r, list_transform(range(1, 5), lambda p: c[p] + CASE WHEN p = b THEN 1 ELSE 0 END), list_transform(range(1, 5), lambda p: w[p] + CASE WHEN p = b THEN deg ELSE 0 END), list_transform(range(1, 5), lambda p: z[p] + CASE WHEN p = b AND deg = 0 THEN 1 ELSE 0 END)
FROM (SELECT r, deg, c, w, z, list_position(t, list_min(t)) AS b FROM (SELECT o.r, o.deg, c, w, z, list_transform(range(1, 5), lambda p: (w[p] + 1e-9 * z[p]) / s[p]) AS t FROM st JOIN o ON o.r = st.r + 1, sp) q) q)
SELECT unnest(range(0, 4))::BIGINT AS part, unnest(c) AS nodes, unnest(w) AS work FROM st WHERE r = (SELECT n FROM n)"""
query("lpt_packing", "O", _LPT)(lambda g, s: K.lpt(g, [2.13, 1.47, 1.47, 1.0]).groupBy("part").agg(F.count("*").alias("nodes"), F.sum("work").alias("work")))
ORACLE_SQL["lpt_packing"] = ORACLE_SQL["lpt_packing"].replace("WITH n AS", "WITH RECURSIVE n AS", 1)


@query("supra_solver", "F", """, bl AS (SELECT cell_id, (dense_rank() OVER (ORDER BY v) - 1) * 4 // (SELECT count(DISTINCT v) FROM cells) AS dv, (dense_rank() OVER (ORDER BY snap) - 1) * 4 // (SELECT count(DISTINCT snap) FROM cells) AS dt FROM cells),
sp AS (SELECT x.cell_id AS a, y.cell_id AS b, 2 AS w FROM es e JOIN cells x ON x.v = src AND x.snap = e.snap JOIN cells y ON y.v = dst AND y.snap = e.snap WHERE src <> dst),
tp AS (SELECT a, b, 1 AS w FROM (SELECT lag(cell_id) OVER (PARTITION BY v ORDER BY snap) AS a, cell_id AS b FROM cells) WHERE a IS NOT NULL), pr AS (SELECT * FROM sp UNION ALL SELECT * FROM tp)
SELECT (SELECT count(*) FROM cells)::BIGINT AS cells, true AS covered, true AS within_cap, true AS no_worse,
least((SELECT sum(w) FROM pr JOIN bl x ON x.cell_id = a JOIN bl y ON y.cell_id = b WHERE x.dv <> y.dv), (SELECT sum(w) FROM pr JOIN bl x ON x.cell_id = a JOIN bl y ON y.cell_id = b WHERE x.dt <> y.dt))::BIGINT AS best_corner""")  # fmt: skip
def _solver(g, s):
    """Each cell on one device within the cap; the cost is no more than that of the better corner, which SQL works out."""
    from ..operators import supra as G

    c = kept(G.cells(g, s), "cells")
    sp, tp = G.spatial_pairs(g, c, s), G.temporal_pairs(c)
    price = lambda d: (lambda r: 2 * r["spatial"] + r["temporal"])(G.cuts(sp, tp, d).first())
    corner = min(price(G.blocks_of(c, column, D)) for column in ("v", "snap"))
    got = kept(K.supra_solve(g, s, D), "supra")
    n, most = got.agg(F.count("*").alias("n"), F.count_distinct("cell_id").alias("d"), F.first("cost").alias("cost")).first(), got.groupBy("dev").count().agg(F.max("count")).first()[0]
    cells = c.count()
    row = (cells, n["n"] == n["d"] == cells, most <= max(1.10 * cells / D, -(-cells // D)), n["cost"] <= corner and n["cost"] == price(got.select("cell_id", "dev")), corner)
    return g.spark.createDataFrame([row], "cells long, covered boolean, within_cap boolean, no_worse boolean, best_corner long")
