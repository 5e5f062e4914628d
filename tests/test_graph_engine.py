"""Hand-made graphs: loops, multi-edges, isolated vertices, ties in time, more snapshots than edges, nothing at all."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import aggregate as X
from tessera.operators import cost as C
from tessera.operators import greedy as K
from tessera.operators import iterate as I
from tessera.operators import memory as R
from tessera.operators import metrics as M
from tessera.operators import placement as P
from tessera.operators import stats as S
from tessera.operators import supra as G
from tessera.operators import temporal as T
from tessera.sources import readers
from tessera.sources.graphs import from_edges


def make(spark, rows, n):
    e = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "eid long, src long, dst long, t long")
    return from_edges(e, ["t", "eid"], n, "toy")


@pytest.fixture(scope="module")
def toy(spark):
    return make(spark, list(zip([0, 1, 2, 3, 4, 5, 0, 2], [1, 2, 3, 4, 5, 0, 2, 4], [10, 20, 20, 30, 40, 40, 50, 60])), 6)


def col(df, key, value):
    return {r[key]: r[value] for r in df.collect()}


def test_degrees_and_snapshots(toy):
    assert col(S.degree(toy), "v", "deg") == {0: 3, 1: 2, 2: 4, 3: 2, 4: 3, 5: 2}
    assert col(T.snap_count(toy, 4), "snap", "edges") == {0: 2, 1: 2, 2: 2, 3: 2}
    w = sorted(tuple(r) for r in T.snap_width(toy, 4).collect())
    assert [(a, b, hi - lo) for _, a, b, lo, hi in w] == [(10, 23, 3), (23, 36, 1), (36, 49, 2), (49, 62, 2)]


def test_remainder_and_more_snapshots_than_edges(spark):
    g = make(spark, [(0, 1, i) for i in range(10)], 2)
    assert col(T.snap_count(g, 4), "snap", "edges") == {0: 3, 1: 2, 2: 3, 3: 2}
    assert set(col(T.snap_count(make(spark, [(0, 1, 1), (1, 0, 2)], 2), 4), "snap", "edges")) == {0, 2}


def test_cut_and_halo(toy):
    rows = {r.part: r for r in M.edgecut(toy, P.by_hash(toy, 2), 2).collect()}
    assert rows[0].cut == 6 and rows[0].halo == 3 and rows[1].halo == 3
    assert sum(r.incident for r in rows.values()) == 16


def test_loops_multi_edges_isolated(spark):
    g = make(spark, [(5, 5, 1), (1, 2, 2), (1, 2, 3)], 8)
    deg = col(S.degree(g), "v", "deg")
    assert deg[5] == 2 and deg[1] == deg[2] == 2 and deg[7] == 0
    m = {r.part: r for r in M.edgecut(g, P.by_hash(g, 2), 4).collect()}
    assert m[0].cut == 2 and m[0].halo == m[1].halo == 1 and m[3].nodes == 0
    cell = G.cells(g, 3)
    assert G.spatial_pairs(g, cell, 3).count() == 2
    assert [r.ear for r in I.event_ears(g.edges).orderBy("pos").collect()] == [-1, -1, 1]


def test_event_forest(spark):
    g = make(spark, [(0, 1, 1), (1, 2, 2), (3, 4, 3), (2, 3, 4)], 5)
    ears = I.event_ears(g.edges)
    assert [r.ear for r in ears.orderBy("pos").collect()] == [-1, 0, -1, 2]
    assert [r.depth for r in I.event_depth(ears).orderBy("pos").collect()] == [0, 1, 0, 1]
    assert {r.v for r in I.changed_cone(g.edges, 0).collect()} == {0, 1, 2, 3, 4}


def test_coreness_is_peeling(spark):
    tri = [(0, 1), (1, 2), (2, 0), (2, 3)]
    g = make(spark, [(a, b, i) for i, (a, b) in enumerate(tri + [(b, a) for a, b in tri])], 5)
    assert col(I.coreness(g), "v", "core") == {0: 2, 1: 2, 2: 2, 3: 1, 4: 0}


def test_temporal_pairs(spark):
    g = make(spark, [(0, 1, 0), (2, 3, 1), (2, 3, 2), (0, 4, 3), (0, 5, 4)], 6)
    pairs = G.temporal_pairs(G.cells(g, 5)).where("v = 0")
    assert pairs.count() == 2


def test_empty(spark):
    g = make(spark, [], 0)
    assert T.summary(g).first().asDict() == {"n": 0, "e": 0, "tmin": 0, "tmax": 0, "span": 0}
    assert T.snap_width(g).count() == 0 and S.degree(g).count() == 0
    assert S.persistence(g, 4).first()["numerator"] == 0


def test_windows(spark):
    snaps = spark.createDataFrame([(i, i, i + 1) for i in range(5)], "index long, lo long, hi long")
    assert sorted(r.window_id for r in T.windows(snaps, 2, 2).collect()) == [0, 2]
    assert sorted(r.window_id for r in T.windows(snaps, 2, 1).collect()) == [0, 1, 2, 3]
    assert T.windows(snaps.where("index = 0"), 3, 1).collect()[0].edges == 1


def test_split_rule(spark):
    g = make(spark, [(0, i, i) for i in range(1, 9)], 9)
    p = P.by_locality(g, 4)
    assert {r.part for r in p.collect()} <= {0, 1, 2, 3}
    assert p.agg(F.sum("work")).first()[0] == 16


def test_caches(spark):
    a = spark.createDataFrame([(i, u) for i, u in enumerate([0, 1, 2, 0, 1])], "pos long, unit long")
    one = R.next_use(a).withColumns({"device": F.lit(0).cast("long"), "slots": F.lit(2).cast("long")})
    r = R.cache_misses(one, "belady").first()
    assert (r.misses, r.evictions) == (4, 2)
    assert [r.unit for r in R.access_sequence(spark, 4, 2, 1).orderBy("pos").collect()] == [0, 1, 1, 2, 2, 3]


def test_placement_keeps_results_and_dropping_a_row_shows(toy):
    x = X.features(toy)
    assert X.largest_difference(X.partitioned_sum(toy, x, P.by_hash(toy, 3)), X.neighbour_sum(toy, x)).first()["max_abs_diff"] == 0
    less = make(toy.spark, [tuple(r) for r in toy.edges.where("pos < 7").select("src", "dst", "t").collect()], 6)
    assert X.largest_difference(X.neighbour_sum(less, x), X.neighbour_sum(toy, x)).first()["max_abs_diff"] > 0


def test_greedy_placements_cover_and_respect_caps(spark):
    blocks = [(b * 20 + i, b * 20 + (i * 7 + 3) % 20, b * 400 + i) for b in range(4) for i in range(20)] * 2
    g = make(spark, blocks, 80)
    for place in (K.multilevel(g, 4), K.online(g, 4, batches=4), K.streamed(g, 4, ("ldg",)).select("v", "part")):
        rows = place.collect()
        assert sorted(r.v for r in rows) == list(range(80)) and all(0 <= r.part < 4 for r in rows)
    e = g.edges.where("src <> dst").groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.count("*").alias("w"))
    start = P.by_hash(g, 4).withColumn("w", F.lit(1).cast("long"))
    better = K.refined(e, start, 4, 1.1 * 20)
    assert K.cut_of(e, better) <= K.cut_of(e, start)
    assert better.groupBy("part").count().agg(F.max("count")).first()[0] <= 22


def test_incremental_moves_within_budget(spark):
    g = make(spark, [(i % 40, (i * 3 + 1) % 40, i) for i in range(200)], 44)
    prior = P.by_hash(g, 4).where("v < 40")
    now = K.incremental(g, prior, 190, 4, 0.1)
    assert now.count() == 44
    moved = now.select("v", F.col("part").alias("q")).join(prior, "v").where("q <> part").count()
    assert moved <= int(0.1 * 44)
    same = K.matched(prior, prior.select("v", ((F.col("part") + 1) % 4).alias("part")), 4)
    assert same.join(prior.withColumnRenamed("part", "p"), "v").where("p <> part").count() == 0


def test_supra_cost_is_no_worse_than_its_corners(toy):
    cell = G.cells(toy, 4)
    cost = K.supra_solve(toy, 4, 2).first()["cost"]
    for c in ("v", "snap"):
        r = G.cuts(G.spatial_pairs(toy, cell, 4), G.temporal_pairs(cell), G.blocks_of(cell, c, 2)).first()
        assert cost <= 2 * r.spatial + r.temporal


def test_memory_and_columns(spark):
    d = C.devices(spark, "het3")
    w = spark.createDataFrame([(0, 2_000_000, 16_000_000, 128, 2, 2, 0.0), (1, 60_000_000, 600_000_000, 1024, 2, 1, 0.0)], "w long, num_nodes long, num_edges long, feat_dim long, layers long, window long, reuse_frac double")
    rows = R.plan_memory(w, d).collect()
    assert all(r.feasible and r.streamed == 0 for r in rows if r.w == 0)
    assert not all(r.feasible for r in rows if r.w == 1)
    assert sum(r.cols for r in C.columns_by_weight(d, 130, "hbm_bw_gbps").collect()) == 130


def test_readers(spark, tmp_path):
    lines = spark.createDataFrame([("# c",), ("1 2 3.9",), ("7 8",), (" 5\t6 7 ",)], "value string")
    assert sorted(tuple(r) for r in readers.parse_edge_list(lines).collect()) == [(1, 2, 3), (5, 6, 7)]
    ragged = spark.createDataFrame([("user,item,ts,l,f",), ("3,9,1.5,0,0.5",), ("1,9,2,1,0.5,0.6",)], "value string")
    rows = sorted(tuple(r) for r in readers.parse_jodie(ragged).collect())
    assert [r[:3] for r in rows] == [(0, 2, 2), (1, 2, 1)] and all(r[4] is None for r in rows)
    e = spark.createDataFrame([(0, 1, 5), (1, 0, 6), (1, 1, 7), (1, 2, 86_400_000_001)], "src long, dst long, t long")
    readers.write_metis(e, 4, str(tmp_path / "m"))
    assert [r.value for r in spark.read.text(str(tmp_path / "m")).collect() if r.value][0] == "4 2"
    store = readers.EdgeStore(spark, str(tmp_path / "s"))
    store.ingest(e.where("t < 7"))
    store.ingest(e.where("t >= 7"))
    assert store.load().count() == 4 and store.range(6, 86_400_000_001).count() == 2


def test_binary_edges(spark, tmp_path):
    import numpy as np

    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "g.bin").write_bytes(np.array([4, 2], "<i8").tobytes() + np.array([0, 1, 2, 3], "<i4").tobytes())
    assert sorted((r.src, r.dst) for r in readers.read_binary_edges(spark, str(tmp_path / "b")).collect()) == [(0, 2), (1, 3)]


def test_stream_replays_to_one_trace(spark, tmp_path):
    from tessera.streaming import online as O

    src = str(tmp_path / "in")
    for k in range(3):
        spark.createDataFrame([(k * 50 + i, (i * 3) % 20, (i * 7 + k) % 20, k * 50 + i) for i in range(50)], "eid long, src long, dst long, t long").coalesce(1).write.mode("append").parquet(src)
    O.stream_files(spark, src, str(tmp_path / "out"), 20, 2, str(tmp_path / "chk"))
    rows = spark.read.parquet(str(tmp_path / "out" / "state")).orderBy("batch").collect()
    assert [r.batch for r in rows] == [0, 1, 2] and rows[0].reason == "cold"
    assert spark.read.parquet(str(tmp_path / "out" / "place" / "batch=2")).count() == 20


def test_clustering_is_part_of_drift(spark):
    from tessera.streaming import online as O

    edges = [(0, 1), (1, 2), (2, 0), (2, 0), (2, 3), (3, 3), (3, 4), (4, 2), (5, 6), (7, 7)]
    near = {v: [b for x, y in edges for a, b in ((x, y), (y, x)) if a == v] for v in range(8)}
    each = [sum(len(set(nb) & set(near[u])) for u in nb) / (len(nb) * (len(nb) - 1)) for nb in near.values() if len(nb) > 1]
    g = make(spark, [(a, b, i) for i, (a, b) in enumerate(edges)], 8)
    assert S.window_stats(g, 1, clustered=True).first()["clusterability"] == pytest.approx(sum(each) / len(each), abs=1e-8)
    # Two triangles against a ring of six: the same degrees, persistence and vertices.
    rows = [O.window_row(make(spark, [(a, b, 5) for a, b in e], 6)) for e in ([(0, 1), (1, 2), (2, 0), (3, 4), (4, 5), (5, 3)], [(i, (i + 1) % 6) for i in range(6)])]
    assert O.shift(*rows) == 0.35


def test_spectral_gap_of_clusters(spark):
    import numpy as np

    edges = [(c * 6 + i, c * 6 + j) for c in range(3) for i in range(6) for j in range(i)] + [(0, 6), (7, 12), (7, 12)]
    a = np.zeros((18, 18))
    for x, y in edges:
        a[x, y] += 1
        a[y, x] += 1
    d = a.sum(1)
    want = np.linalg.eigvalsh(np.eye(18) - a / np.sqrt(np.outer(d, d)))[1]
    g = make(spark, [(x, y, i) for i, (x, y) in enumerate(edges)], 18)
    assert I.spectral_gap(g).first()["lambda2"] == round(want, 3)
    with pytest.raises(RuntimeError):
        I.spectral_gap(g, 1)


def test_breadth_first_restarts_and_has_no_last_level(spark):
    chain = [(i, i + 1) for i in range(104)]
    g = make(spark, [(a, b, i) for i, (a, b) in enumerate(chain)], 105)
    assert col(I.breadth_first(g, 0), "v", "level") == {i: i for i in range(105)}
    g = make(spark, [(a, b, i) for i, (a, b) in enumerate([(3, 4), (4, 5), (0, 1), (7, 7)])], 8)
    got = {r.v: (r.root, r.level) for r in I.breadth_first(g, restart=True).collect()}
    assert got == {4: (4, 0), 3: (4, 1), 5: (4, 1), 6: (6, 0), 7: (7, 0), 0: (0, 0), 1: (0, 1), 2: (2, 0)}
