"""Queries on order, snapshots, cells, statistics and placements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import metrics as M
from ..operators import placement as P
from ..operators import stats as S
from ..operators import supra as G
from ..operators import temporal as T
from ..sources.graphs import graph, sql_prefix
from ..sources.readers import parse_jodie

D = 4
SNAPS = {"E": 8, "F": 8, "O": 16}
SHARES = [5, 3, 1, 1]
FACTORS = [(1, 8), (2, 4), (4, 2), (8, 1)]
QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, on: str, body: str | None = None, prefix: bool = True):
    """Register ``fn(g, snaps)`` on a graph, with the SQL that follows the graph's WITH clause."""

    def add(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(graph(spark, sf_dir, on), SNAPS[on])

        QUERIES[name] = run
        if body is not None:
            ORACLE_SQL[name] = (sql_prefix(on, SNAPS[on]) if prefix else "") + body
        return fn

    return add


query("edges_sorted_head", "O", "SELECT pos, src, dst, t FROM edges WHERE pos < 100")(lambda g, s: g.edges.where("pos < 100").select("pos", "src", "dst", "t"))
query("graph_summary", "E", "SELECT (SELECT n FROM n)::BIGINT AS n, count(*)::BIGINT AS e, min(t) AS tmin, max(t) AS tmax, max(t) - min(t) AS span FROM edges")(lambda g, s: T.summary(g))
_WIDTH = """, w AS (SELECT min(t) AS a, greatest(1, (max(t) - min(t) + 1 + 31) // 32) AS step FROM edges),
wb AS (SELECT (t - a) // step AS bucket, min(pos) AS lo, max(pos) + 1 AS hi FROM edges, w GROUP BY 1),
width AS (SELECT row_number() OVER (ORDER BY bucket) - 1 AS index, a + bucket * step AS t_start, a + (bucket + 1) * step AS t_end, lo, hi FROM wb, w)
"""
query("snap_width", "O", _WIDTH + "SELECT * FROM width")(lambda g, s: T.snap_width(g, 32))
query("snap_count", "O", "SELECT snap, count(*)::BIGINT AS edges FROM es GROUP BY snap")(lambda g, s: T.snap_count(g, s))
for _name, _stride in (("snap_windows_tumbling", 4), ("snap_windows_sliding", 1)):
    query(
        _name,
        "O",
        _WIDTH + f""", wins AS (SELECT unnest(range(0, (SELECT greatest(0, max(index) + 1 - 4) + 1 FROM width)::BIGINT, {_stride})) AS window_id)
SELECT window_id, sum(hi - lo)::BIGINT AS edges FROM wins JOIN width ON index >= window_id AND index < window_id + 4 GROUP BY 1""",
    )(lambda g, s, stride=_stride: T.windows(T.snap_width(g, 32), 4, stride))


@query("time_slice", "E", """, b AS (SELECT min(t) AS a, max(t) - min(t) AS span FROM edges)
SELECT count(*)::BIGINT AS edges, sum(src)::BIGINT AS src_sum, sum(dst)::BIGINT AS dst_sum FROM edges, b WHERE t >= a + span // 4 AND t < a + span * 3 // 4""")  # fmt: skip
def _time_slice(g, s):
    r = g.edges.agg(F.min("t").alias("a"), F.max("t").alias("b")).first()
    span = r["b"] - r["a"]
    return T.time_slice(g.edges, r["a"] + span // 4, r["a"] + span * 3 // 4).agg(F.count("*").alias("edges"), F.sum("src").alias("src_sum"), F.sum("dst").alias("dst_sum"))


query("remap_dense", "O", "SELECT a AS old_id, row_number() OVER (ORDER BY a) - 1 AS new_id FROM (SELECT DISTINCT a FROM sym)")(lambda g, s: T.remap_dense(g.edges))


@query("jodie_parse", "E", """, j AS (SELECT user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, epoch_us(ts) // 1000000 AS t FROM events)
SELECT dense_rank() OVER (ORDER BY user_id) - 1 AS "user", (SELECT count(DISTINCT user_id) FROM j) + dense_rank() OVER (ORDER BY k) - 1 AS item, t, 2::BIGINT AS nfeat FROM j""")  # fmt: skip
def _jodie(g, s):
    users = g.num_nodes - 100
    line = F.concat_ws(",", "src", F.col("dst") - users, F.concat(F.expr("t div 1000000"), F.lit(".5")), F.lit("0"), F.lit("0.25"), "value")
    lines = g.edges.select(line.alias("value")).unionAll(g.spark.createDataFrame([("user_id,item_id,timestamp,state_label,features",)], "value string"))
    return parse_jodie(lines).select("user", "item", "t", F.size("efeat").cast("long").alias("nfeat"))


query("degree", "F", "SELECT v, deg FROM deg")(lambda g, s: S.degree(g))
_DEG = "round((SELECT m FROM m) / (SELECT n FROM n), 9) AS avg_degree, max(deg)::BIGINT AS max_degree, floor(quantile_cont(deg, 0.99))::BIGINT AS deg_p99, round((SELECT m FROM m) / ((SELECT n FROM n) * ((SELECT n FROM n) - 1.0)), 9) AS density"
query("degree_stats", "F", f"SELECT {_DEG} FROM deg")(lambda g, s: S.degree_stats(g))
query("snap_active_nodes", "O", "SELECT snap, count(*)::BIGINT AS nodes FROM cells GROUP BY snap")(lambda g, s: S.snap_active_nodes(g, s))
query("vertex_activity", "O", "SELECT v, count(*)::BIGINT AS tv FROM cells GROUP BY v")(lambda g, s: S.vertex_activity(g, s))
query("persistence", "O", "SELECT sum(tv - 1)::BIGINT AS numerator, (count(*) * 15)::BIGINT AS denominator FROM (SELECT v, count(*) AS tv FROM cells GROUP BY v)")(lambda g, s: S.persistence(g, s))
_HOM = "SELECT round(coalesce((corr(x.fv::DOUBLE, y.fv::DOUBLE) + 1) / 2, 1.0), 6) AS homophily FROM edges JOIN verts x ON x.v = src JOIN verts y ON y.v = dst"
query("feature_homophily", "F", _HOM)(lambda g, s: S.feature_homophily(g))
query("graph_stats_exact", "E", f"""SELECT (SELECT n FROM n)::BIGINT AS num_nodes, (SELECT m FROM m) AS num_edges, 8::BIGINT AS num_snapshots, d.*, p.*, q.*, f.*, h.*
FROM (SELECT {_DEG} FROM deg) d, (SELECT round(avg(c), 9) AS mean_snapshot_nodes, max(c)::BIGINT AS max_snapshot_nodes FROM (SELECT snap, count(*) AS c FROM cells GROUP BY 1)) p,
(SELECT round(avg((c - 1) / 7), 9) AS persistence FROM (SELECT v, count(*) AS c FROM cells GROUP BY 1)) q,
(SELECT round(avg(fv), 9) AS feat_dim_mean, max(fv)::BIGINT AS feat_dim_max FROM verts) f, ({_HOM}) h""")(lambda g, s: S.graph_stats(g, s))  # fmt: skip
_GINI = "SELECT round(2 * sum(r * deg) / (count(*) * sum(deg)) - (count(*) + 1) / count(*), 6) AS gini FROM (SELECT deg, row_number() OVER (ORDER BY deg) AS r FROM deg)"
query("cheap_stats", "F", f""", b AS (SELECT min(t) AS a, greatest(1, max(t) - min(t)) + 1 AS span FROM edges)
SELECT g.*, r.*, c.*, u.* FROM ({_GINI}) g,
(SELECT coalesce(sum(c) FILTER (c > 1), 0)::BIGINT AS recurring FROM (SELECT least(src, dst) AS x, greatest(src, dst) AS y, count(*) AS c FROM edges GROUP BY 1, 2)) r,
(SELECT round(abs(corr((v * 2654435761 % 10007)::DOUBLE, deg::DOUBLE)), 6) AS attr_corr FROM deg) c,
(SELECT round(stddev_pop(c) / (avg(c) + 1e-9), 6) AS burstiness FROM (SELECT least((t - a) * 8 // span, 7) AS bin, count(*) AS c FROM edges, b GROUP BY 1)) u""")(lambda g, s: S.cheap_stats(g, s))  # fmt: skip
_WIN = """, we AS (SELECT *, least(pos * 10 // (SELECT m FROM m), 9) AS win FROM edges),
ws AS (SELECT win, min(t) AS a0, max(t) - min(t) + 1 AS span, least(64, count(DISTINCT t)) AS s, count(*) AS e FROM we GROUP BY win),
wc AS (SELECT DISTINCT win, least((t - a0) * s // span, s - 1) AS bin, unnest([src, dst]) AS v FROM we JOIN ws USING (win)),
wstats AS (SELECT ws.win, round(2 * e / act, 9) AS avg_degree, mx::BIGINT AS max_snapshot_nodes, round(cells / act / s, 9) AS persistence
           FROM ws JOIN (SELECT win, max(c) AS mx FROM (SELECT win, bin, count(*) AS c FROM wc GROUP BY 1, 2) GROUP BY 1) USING (win)
           JOIN (SELECT win, count(DISTINCT v) AS act, count(*) AS cells FROM wc GROUP BY 1) USING (win))
"""
query("window_stats", "E", _WIN + "SELECT * FROM wstats")(lambda g, s: S.window_stats(g, 10))
_SHIFT = lambda c: f"least(1.0, abs({c}::DOUBLE - lag({c}) OVER w) / greatest(abs({c}::DOUBLE), abs(lag({c}) OVER w), 1e-9))"
query("drift_score", "E", _WIN + f"""SELECT win, round(coalesce(least(1.0, {_SHIFT("persistence")} * 0.3 + {_SHIFT("avg_degree")} * 0.2 + {_SHIFT("max_snapshot_nodes")} * 0.15), 1.0), 6) AS drift
FROM wstats WINDOW w AS (ORDER BY win)""")(lambda g, s: S.drift(S.window_stats(g, 10)))  # fmt: skip
_REUSE = """, first AS (SELECT v, min(snap) AS f FROM cells GROUP BY v), grid AS (SELECT unnest(range(1, 16)) AS snap),
bef AS (SELECT grid.snap, count(v)::BIGINT AS before FROM grid LEFT JOIN first ON f < grid.snap GROUP BY 1)
"""
query("temporal_reuse_1hop", "O", _REUSE + """SELECT snap, before, coalesce(hit, 0)::BIGINT AS hit FROM bef
LEFT JOIN (SELECT snap, count(*) AS hit FROM cells JOIN first USING (v) WHERE f < snap GROUP BY 1) USING (snap)""")(lambda g, s: S.reuse_1hop(g, s))  # fmt: skip
query("temporal_reuse_2hop", "O", _REUSE + """, pr AS (SELECT a, b, min(snap) AS since FROM sym GROUP BY 1, 2),
near AS (SELECT a AS v, cells.snap FROM pr JOIN cells ON cells.v = b WHERE since <= cells.snap UNION SELECT v, snap FROM cells)
SELECT snap, before, coalesce(hit, 0)::BIGINT AS hit FROM bef LEFT JOIN (SELECT snap, count(*) AS hit FROM near JOIN first USING (v) WHERE f < snap GROUP BY 1) USING (snap)""")(lambda g, s: S.reuse_2hop(g, s))  # fmt: skip
query("cells", "O", "SELECT cell_id, v, snap FROM cells")(lambda g, s: G.cells(g, s))
_SP = ", sp AS (SELECT e.pos, e.snap, x.cell_id AS a, y.cell_id AS b FROM es e JOIN cells x ON x.v = src AND x.snap = e.snap JOIN cells y ON y.v = dst AND y.snap = e.snap WHERE src <> dst)"
_TP = ", tp AS (SELECT * FROM (SELECT v, lag(cell_id) OVER (PARTITION BY v ORDER BY snap) AS a, cell_id AS b FROM cells) WHERE a IS NOT NULL)"
query("spatial_pairs", "O", _SP + " SELECT snap, count(*)::BIGINT AS pairs, sum(a)::BIGINT AS a_sum, sum(b)::BIGINT AS b_sum FROM sp GROUP BY snap")(
    lambda g, s: G.spatial_pairs(g, G.cells(g, s), s).groupBy("snap").agg(F.count("*").alias("pairs"), F.sum("a").alias("a_sum"), F.sum("b").alias("b_sum"))
)
query("temporal_pairs", "O", _TP + " SELECT v, a, b FROM tp")(lambda g, s: G.temporal_pairs(G.cells(g, s)))
_CUT = " SELECT (SELECT count(*) FILTER (x.dev <> y.dev) FROM sp JOIN dv x ON x.cell_id = a JOIN dv y ON y.cell_id = b)::BIGINT AS spatial, (SELECT count(*) FILTER (x.dev <> y.dev) FROM tp JOIN dv x ON x.cell_id = a JOIN dv y ON y.cell_id = b)::BIGINT AS temporal"


def _cut(g, s, dev):
    c = G.cells(g, s)
    return G.cuts(G.spatial_pairs(g, c, s), G.temporal_pairs(c), dev(c))


query("supra_cut_hash", "O", _SP + _TP + ", dv AS (SELECT cell_id, (v + snap) % 4 AS dev FROM cells)" + _CUT)(lambda g, s: _cut(g, s, lambda c: c.select("cell_id", ((F.col("v") + F.col("snap")) % D).alias("dev"))))
for _name, _col in (("supra_cut_pss", "v"), ("supra_cut_pts", "snap")):
    query(_name, "O", _SP + _TP + f", dv AS (SELECT cell_id, (dense_rank() OVER (ORDER BY {_col}) - 1) * 4 // (SELECT count(DISTINCT {_col}) FROM cells) AS dev FROM cells)" + _CUT)(
        lambda g, s, col=_col: _cut(g, s, lambda c: G.blocks_of(c, col, D))
    )
query("cells_majority_fold", "O", """SELECT v, coalesce(part, 0)::BIGINT AS part FROM verts LEFT JOIN
(SELECT v, dev AS part FROM (SELECT v, dev, row_number() OVER (PARTITION BY v ORDER BY count(*) DESC, dev) AS r FROM (SELECT v, snap * 4 // 16 AS dev FROM cells) GROUP BY v, dev) WHERE r = 1) USING (v)""")(
    lambda g, s: G.majority_fold(g, G.active(g, s).select("v", F.expr(f"snap * {D} div {s}").alias("dev")))
)
query("duality_frontier", "O", f""", f(dv, dt) AS (VALUES {", ".join(f"({a}::BIGINT, {b}::BIGINT)" for a, b in FACTORS)})
SELECT dv, dt, (SELECT count(*) FROM edges WHERE src * dv // (SELECT n FROM n) <> dst * dv // (SELECT n FROM n))::BIGINT AS sc,
(SELECT sum(x) FROM (SELECT count(DISTINCT snap * dt // 16) - 1 AS x FROM cells GROUP BY v))::BIGINT AS tc FROM f""")(lambda g, s: G.factor_cuts(g, s, FACTORS))  # fmt: skip
query("mixed_cut", "O", """, core AS (SELECT v FROM deg WHERE deg >= 40), pe AS (SELECT pos, (src IN (SELECT v FROM core)) AS cs, (dst IN (SELECT v FROM core)) AS cd, src * 4 // (SELECT n FROM n) AS ss, dst * 4 // (SELECT n FROM n) AS dd, 4 + snap * 4 // 16 AS tt FROM es),
pc AS (SELECT v, CASE WHEN v IN (SELECT v FROM core) THEN v * 4 // (SELECT n FROM n) ELSE 4 + snap * 4 // 16 END AS p FROM cells)
SELECT (SELECT count(*) FROM pe WHERE (CASE WHEN cs THEN ss ELSE tt END) <> (CASE WHEN cd THEN dd ELSE tt END))::BIGINT AS sc, (SELECT sum(x) FROM (SELECT count(DISTINCT p) - 1 AS x FROM pc GROUP BY v))::BIGINT AS tc""")(
    lambda g, s: G.mixed_cut(g, s, 4, 4, S.degree(g).where("deg >= 40").select("v"))
)
query("temporal_lower_bound", "O", "SELECT sum((tv - 1) * (k - 1))::BIGINT AS numerator, 15::BIGINT AS denominator FROM (SELECT v, count(*) AS tv, count(DISTINCT snap * 4 // 16) AS k FROM cells GROUP BY v)")(lambda g, s: G.temporal_bound(g, s, D))

_HASH = ", pl AS (SELECT v, v % 4 AS part FROM verts)"
_LOC = """, o AS (SELECT v, deg AS work, row_number() OVER (ORDER BY deg DESC, v) - 1 AS r, sum(deg) OVER (ORDER BY deg DESC, v) AS p, sum(deg) OVER () AS tot FROM deg),
ct AS (SELECT k, count(*) FILTER (p * 4 < k * tot) AS c FROM o, (VALUES (1), (2), (3)) x(k) GROUP BY k),
pl AS (SELECT v, work, (SELECT count(*) FROM ct WHERE c <= r)::BIGINT AS part FROM o)"""
_PE = ", pe AS (SELECT pos, src, dst, x.part AS ps, y.part AS pd FROM edges JOIN pl x ON x.v = src JOIN pl y ON y.v = dst), dom AS (SELECT unnest(range(0, 4)) AS part), hr AS (SELECT ps AS part, dst AS b FROM pe WHERE ps <> pd UNION SELECT pd, src FROM pe WHERE ps <> pd)"
_SUM = _PE + " SELECT part, coalesce(nodes, 0)::BIGINT AS nodes, coalesce(edges, 0)::BIGINT AS edges FROM dom LEFT JOIN (SELECT part, count(*) AS nodes FROM pl GROUP BY 1) USING (part) LEFT JOIN (SELECT ps AS part, count(*) AS edges FROM pe WHERE ps = pd GROUP BY 1) USING (part)"
_CAP = f", pl AS (SELECT v, (CASE WHEN v >= (SELECT n FROM n) * 5 // 10 THEN 1 ELSE 0 END + CASE WHEN v >= (SELECT n FROM n) * 8 // 10 THEN 1 ELSE 0 END + CASE WHEN v >= (SELECT n FROM n) * 9 // 10 THEN 1 ELSE 0 END)::BIGINT AS part FROM verts)"  # noqa: F541
query("part_hash", "F", _HASH + _SUM)(lambda g, s: M.part_summary(g, P.by_hash(g, D), D))
query("part_caprange", "F", _CAP + _SUM)(lambda g, s: M.part_summary(g, P.by_capacity(g, SHARES), D))
query("cross_matrix", "F", _HASH + _PE + " SELECT ps, pd, count(*)::BIGINT AS cnt FROM pe GROUP BY 1, 2")(lambda g, s: M.cross_matrix(g, P.by_hash(g, D)))
_EC = """SELECT part, coalesce(incident, 0)::BIGINT AS incident, coalesce(halo, 0)::BIGINT AS halo, coalesce(nodes, 0)::BIGINT AS nodes, (SELECT count(*) FROM pe WHERE ps <> pd)::BIGINT AS cut FROM dom
LEFT JOIN (SELECT part, sum(deg) AS incident, count(*) AS nodes FROM pl JOIN deg USING (v) GROUP BY 1) USING (part) LEFT JOIN (SELECT part, count(*) AS halo FROM hr GROUP BY 1) USING (part)"""
query("edgecut_metrics", "F", _HASH + _PE + _EC)(lambda g, s: M.edgecut(g, P.by_hash(g, D), D))


def _core(g):
    return S.degree(g).where(f"deg * {g.num_nodes} >= {4 * g.num_edges}").select("v")


_VC = """, core AS (SELECT v FROM deg WHERE deg * (SELECT n FROM n) >= 4 * (SELECT m FROM m)), home AS (SELECT v, part FROM pl WHERE v NOT IN (SELECT v FROM core)),
dbl AS (SELECT pos, src AS a, dst AS b, 0 AS way FROM edges UNION ALL SELECT pos, dst, src, 1 FROM edges), de AS (SELECT dbl.*, x.part AS pa, y.part AS pb FROM dbl LEFT JOIN home x ON x.v = a LEFT JOIN home y ON y.v = b)
SELECT part, coalesce(incident, 0)::BIGINT AS incident, coalesce(rows, 0) + (SELECT count(*) FROM core) * 3 / 4 AS halo, (coalesce(own, 0) + (SELECT count(*) FROM core))::BIGINT AS nodes, (SELECT count(*) FROM de WHERE way = 0 AND pa <> pb)::BIGINT AS cut
FROM (SELECT unnest(range(0, 4)) AS part) LEFT JOIN (SELECT coalesce(pa, pb, (pos * 2 + way) % 4) AS part, count(*) AS incident FROM de GROUP BY 1) USING (part)
LEFT JOIN (SELECT pa AS part, count(DISTINCT b) AS rows FROM de WHERE pa <> pb GROUP BY 1) USING (part) LEFT JOIN (SELECT part, count(*) AS own FROM home GROUP BY 1) USING (part)"""
query("vertexcut_metrics", "F", _HASH + _VC)(lambda g, s: M.vertexcut(g, P.by_hash(g, D), _core(g), D))
query("feat_bytes_per_part", "F", _HASH + " SELECT part, (sum(fv) * 4)::BIGINT AS bytes FROM pl JOIN verts USING (v) GROUP BY 1")(lambda g, s: M.feature_bytes(g, P.by_hash(g, D), D))
query("feat_work", "F", _HASH + _PE + """ SELECT part, coalesce(inc_fw, 0)::BIGINT AS inc_fw, coalesce(comm_fw, 0)::BIGINT AS comm_fw FROM dom
LEFT JOIN (SELECT part, sum(fv) AS inc_fw FROM sym JOIN pl ON pl.v = a JOIN verts w ON w.v = b GROUP BY 1) USING (part) LEFT JOIN (SELECT part, sum(fv) AS comm_fw FROM hr JOIN verts ON v = b GROUP BY 1) USING (part)""")(lambda g, s: M.feature_work(g, P.by_hash(g, D), D))  # fmt: skip
query("partition_report", "O", _HASH + _PE + """ SELECT (SELECT count(*) FROM pe WHERE ps <> pd)::BIGINT AS cut, (SELECT round(max(c) / avg(c), 6) FROM (SELECT count(*) AS c FROM pl GROUP BY part)) AS balance_count,
round(max(bytes) / avg(bytes), 6) AS balance_featmem, max(bytes)::BIGINT AS peak_bytes, (SELECT sum(fv) * 4 FROM pe JOIN verts ON v = dst WHERE ps <> pd)::BIGINT AS comm_bytes FROM (SELECT part, sum(fv) * 4 AS bytes FROM pl JOIN verts USING (v) GROUP BY 1)""")(lambda g, s: M.report(g, P.by_hash(g, D), D))  # fmt: skip
query("edge_partition_report", "F", """, ep AS (SELECT src, dst, (src * 31 + dst) % 4 AS part FROM edges)
SELECT (SELECT count(*) FROM (SELECT src, part FROM ep UNION SELECT dst, part FROM ep))::BIGINT AS copies, (SELECT n FROM n)::BIGINT AS nodes, (SELECT round(max(c) / avg(c), 6) FROM (SELECT count(*) AS c FROM ep GROUP BY part)) AS edge_balance""")(
    lambda g, s: M.edge_partition_report(g, g.edges.select("src", "dst", ((F.col("src") * 31 + F.col("dst")) % D).alias("part")), D)
)
query("boundary_accounting", "F", _HASH + _PE + " SELECT pl.part AS owner, count(*)::BIGINT AS k FROM hr JOIN pl ON v = b GROUP BY 1")(lambda g, s: M.boundary(g, P.by_hash(g, D), D))
query("block_matrix", "F", _HASH + _PE + " SELECT least(ps, pd) AS bi, greatest(ps, pd) AS bj, count(*)::BIGINT AS w FROM pe GROUP BY 1, 2")(lambda g, s: M.block_matrix(g, P.by_hash(g, D)))
query("cut_vertex_count", "O", _HASH + _PE + " SELECT count(DISTINCT dst)::BIGINT AS cut_vertices FROM pe WHERE ps <> pd")(lambda g, s: M.cut_vertices(g, P.by_hash(g, D)))
_WORK = " SELECT part, count(*)::BIGINT AS nodes, sum(work)::BIGINT AS work FROM pl GROUP BY 1"
_by = lambda p: p.groupBy("part").agg(F.count("*").alias("nodes"), F.sum("work").alias("work"))
query("part_locality_split", "O", _LOC + _WORK)(lambda g, s: _by(P.by_locality(g, D)))
_PTS = _LOC.replace("ORDER BY deg DESC, v", "ORDER BY f, v").replace("FROM deg)", "FROM (SELECT v, deg, coalesce(f, 17) AS f FROM deg LEFT JOIN (SELECT v, min(snap) AS f FROM cells GROUP BY v) USING (v)))", 1)
query("part_pts", "O", _PTS + _WORK)(lambda g, s: _by(P.by_first_activity(g, s, D)))
query("hotspot_replication", "O", """, k AS (SELECT greatest(1, (SELECT n FROM n) * 2 // 100)::BIGINT AS k), core AS (SELECT v FROM deg WHERE deg >= (SELECT min(deg) FROM (SELECT deg FROM deg ORDER BY deg DESC, v LIMIT (SELECT k FROM k)))),
pl AS (SELECT v, v % 4 AS part FROM verts WHERE v NOT IN (SELECT v FROM core))
SELECT (SELECT count(*) FROM core)::BIGINT AS core, count(*) FILTER (x.part <> y.part)::BIGINT AS cut FROM edges JOIN pl x ON x.v = src JOIN pl y ON y.v = dst""")(
    lambda g, s: M.placed(g, P.by_hash(g, D).join(P.hubs(g, 2), "v", "left_anti")).agg(F.count_if(F.col("ps") != F.col("pd")).alias("cut")).join(P.hubs(g, 2).agg(F.count("*").alias("core")))
)
query("halo_intra_inter", "F", _HASH + _PE + """ SELECT part AS rank, coalesce(intra, 0)::BIGINT AS intra, coalesce(inter, 0)::BIGINT AS inter FROM dom LEFT JOIN
(SELECT hr.part, count(*) FILTER (hr.part // 2 = pl.part // 2) AS intra, count(*) FILTER (hr.part // 2 <> pl.part // 2) AS inter FROM hr JOIN pl ON v = b GROUP BY 1) USING (part)""")(lambda g, s: M.intra_inter(g, P.by_hash(g, D), 2, D))  # fmt: skip
query("warm_edge_split", "O", """, tr AS (SELECT * FROM edges WHERE pos < (SELECT m FROM m) * 7 // 10), seen AS (SELECT src AS v FROM tr UNION SELECT dst FROM tr)
SELECT part, count(*)::BIGINT AS edges FROM (SELECT 'train' AS part FROM tr UNION ALL SELECT 'test' FROM edges WHERE pos >= (SELECT m FROM m) * 7 // 10 AND src IN (SELECT v FROM seen) AND dst IN (SELECT v FROM seen)) GROUP BY 1""")(
    lambda g, s: T.warm_split(g).groupBy("part").agg(F.count("*").alias("edges"))
)
query("top_degree", "O", "SELECT v, deg FROM deg ORDER BY deg DESC, v LIMIT 50")(lambda g, s: T.top_k(S.degree(g), 50, "deg"))
query("edge_homophily", "F", "SELECT count(*) FILTER (src % 5 = dst % 5)::BIGINT AS same, count(*)::BIGINT AS edges FROM edges")(lambda g, s: S.edge_homophily(g, g.vertices().select("v", (F.col("v") % 5).alias("attr"))))


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    return read("labels").join(read("documents").select("doc_id", "n_chars"), "doc_id")


QUERIES["auc_rank"] = lambda spark, sf: S.auc_rank(_scored(spark, sf), "quality", "n_chars", "doc_id")
ORACLE_SQL["auc_rank"] = """SELECT round((sum(r) FILTER (quality = 1) - count(*) FILTER (quality = 1) * (count(*) FILTER (quality = 1) + 1) / 2) / (count(*) FILTER (quality = 1) * count(*) FILTER (quality = 0)), 6) AS auc
FROM (SELECT quality, row_number() OVER (ORDER BY n_chars, doc_id) AS r FROM labels JOIN documents USING (doc_id))"""
QUERIES["average_precision"] = lambda spark, sf: S.average_precision(_scored(spark, sf), "quality", "n_chars", "doc_id")
ORACLE_SQL["average_precision"] = """SELECT round(avg(h / r), 6) AS ap FROM (SELECT quality, r, sum(quality) OVER (ORDER BY r) AS h FROM (SELECT quality, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS r FROM labels JOIN documents USING (doc_id))) WHERE quality = 1"""
