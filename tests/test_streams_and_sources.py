"""The sliding stream with departures against its batch version, and binary edges read by ranges."""

import numpy as np
import pytest

from tessera.sources import binary, readers, registry
from tessera.streaming import departures as W
from tessera.streaming import online as O

STEP, WIDTH, POSITIONS = 100, 3, 9


def edges_of(spark, n=400, last=POSITIONS * STEP):
    """Edges over nine steps: none in the sixth, a hub, self-loops, and vertices that come once."""
    rng = np.random.default_rng(3)
    clock = np.sort(rng.integers(0, last, n))
    clock = clock[(clock < 600) | (clock >= 700)]
    src = np.where(rng.random(len(clock)) < 0.3, 0, rng.integers(0, 40, len(clock)))
    dst = np.where(rng.random(len(clock)) < 0.1, src, rng.integers(0, 60, len(clock)))
    return [(i, int(a), int(b), int(c)) for i, (a, b, c) in enumerate(zip(src, dst, clock, strict=True))]


def fed(spark, path, batches):
    for rows in batches:
        spark.createDataFrame(rows, W.EDGES).coalesce(1).write.mode("append").parquet(path)


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_departures_equal_the_batch_version_through_replays(spark, tmp_path):
    rows = edges_of(spark)
    cut = [0, 90, 91, 250, len(rows)]
    batches = [rows[a:b] for a, b in zip(cut, cut[1:], strict=False)]
    batches[2] = batches[2] + batches[1] + rows[80:85]  # its source delivers edges again
    src, out, checkpoint = (f"file://{tmp_path}/{x}" for x in ("in", "out", "checkpoint"))
    late = STEP  # what is delivered again is up to a step old
    fed(spark, src, batches[:3])
    W.follow(spark, src, out, checkpoint, STEP, WIDTH, late)
    # The last batch is taken for one that failed before its commit: it runs again from the state before it.
    last = max((tmp_path / "checkpoint/commits").glob("[0-9]*"), key=lambda p: int(p.name))
    for p in (tmp_path / "checkpoint/commits").glob(f"*{last.name}*"):
        p.unlink()
    fed(spark, src, batches[3:] + [[(-1, W.TICK, W.TICK, (POSITIONS + WIDTH + 2) * STEP)]])
    W.follow(spark, src, out, checkpoint, STEP, WIDTH, late)
    changed = spark.read.parquet(out)
    want = W.windowed(spark.createDataFrame(rows, W.EDGES), STEP, WIDTH, POSITIONS)
    assert rows_of(W.turnover(changed, POSITIONS)) == rows_of(want)
    # Against plain sets.
    got = {r.position: (r.active, r.entered, r.left, r.ends) for r in want.collect()}
    alive = [{v for _, a, b, c in rows if p - WIDTH < c // STEP <= p for v in (a, b)} for p in range(POSITIONS)]
    before = [set(), *alive]
    ends = [2 * sum(p - WIDTH < c // STEP <= p for *_, c in rows) for p in range(POSITIONS)]
    assert got == {p: (len(alive[p]), len(alive[p] - before[p]), len(before[p] - alive[p]), ends[p]) for p in range(POSITIONS)}
    degree = {(r.v, r.position): r.degree for r in W.degrees(changed, POSITIONS + WIDTH).collect()}
    assert degree[0, 4] == sum((a == 0) + (b == 0) for _, a, b, c in rows if 1 < c // STEP <= 4)
    assert max(p for v, p in degree if v == 0) < POSITIONS + WIDTH and all(degree[v, max(p for x, p in degree if x == v)] == 0 for v, _ in degree)


def test_departures_of_nothing(spark, tmp_path):
    src = f"file://{tmp_path}/in"
    fed(spark, src, [[(-1, W.TICK, W.TICK, 1000)]])
    W.follow(spark, src, f"file://{tmp_path}/out", f"file://{tmp_path}/checkpoint", STEP, WIDTH)
    assert [r[1:] for r in rows_of(W.turnover(spark.read.schema(W.CHANGES).parquet(f"file://{tmp_path}/out"), 3))] == [(0,) * 6] * 3


def test_placed_stream_runs_a_batch_again(spark, tmp_path):
    src, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))
    for k in range(2):
        spark.createDataFrame([(k * 50 + i, (i * 3) % 20, (i * 7 + k) % 20, (k * 50 + i) // 3) for i in range(50)], "eid long, src long, dst long, t long").coalesce(1).write.mode("append").parquet(src)
    O.stream_files(spark, src, out, 20, 2, checkpoint)
    read = lambda name: sorted(map(tuple, spark.read.parquet(f"{out}/{name}").select("batch", *sorted(c for c in spark.read.parquet(f"{out}/{name}").columns if c != "batch")).collect()))
    first = {name: read(name) for name in ("edges", "state", "place")}
    for p in (tmp_path / "checkpoint/commits").glob("*1*"):
        p.unlink()
    O.stream_files(spark, src, out, 20, 2, checkpoint)
    assert {name: read(name) for name in first} == first
    assert sorted(r.pos for r in spark.read.parquet(f"{out}/edges").collect()) == list(range(100))


def arrays(m, seed=0):
    rng = np.random.default_rng(seed)
    return rng.integers(0, 1000, m), rng.integers(0, 1000, m), np.cumsum(rng.integers(0, 9, m))


def test_binary_edges_by_ranges(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(binary, "BATCH", 64)
    folder = tmp_path / "b"
    folder.mkdir()
    want = []
    for k, m in enumerate((1000, 0, 7)):
        a, b, t = arrays(m, k)
        (folder / f"{k}.bin").write_bytes(np.array([1000, m], "<i8").tobytes() + a.astype("<i4").tobytes() + b.astype("<i4").tobytes())
        want += [(f"{k}.bin", i, *x, i) for i, x in enumerate(zip(a.tolist(), b.tolist(), strict=True))]
        for save, name, with_t in ((np.savez, f"{k}s.npz", True), (np.savez_compressed, f"{k}c.npz", False)):
            save(folder / name, src=a.astype(np.int32), dst=b, **({"t": t.astype(np.uint32)} if with_t else {}))
            want += [(name, i, *x[:2], x[2] if with_t else i) for i, x in enumerate(zip(a.tolist(), b.tolist(), t.tolist(), strict=True))]
    (folder / "_SUCCESS").write_bytes(b"")
    df = binary.read_edge_arrays(spark, str(folder), 150)
    assert sorted((r.file.rsplit("/", 1)[1], r.pos, r.src, r.dst, r.t) for r in df.collect()) == sorted(want)
    # One file is many tasks' work where it can be entered anywhere.
    assert binary.read_edge_arrays(spark, str(folder / "0.bin"), 150).rdd.getNumPartitions() == 7
    assert binary.read_edge_arrays(spark, str(folder / "0s.npz"), 150).rdd.getNumPartitions() == 7
    assert binary.read_edge_arrays(spark, str(folder / "0c.npz"), 150).rdd.getNumPartitions() == 1
    g = registry.open_edges(spark, f"file://{folder}/0s.npz", "npz")
    assert g.num_edges == 1000 and [r.t for r in g.edges.orderBy("pos").limit(5).collect()] == arrays(1000)[2][:5].tolist()


def test_binary_edges_that_are_cut_short(spark, tmp_path):
    (tmp_path / "x.bin").write_bytes(np.array([9, 100], "<i8").tobytes() + bytes(799))
    with pytest.raises(Exception, match="799|815"):
        binary.read_edge_arrays(spark, str(tmp_path / "x.bin")).collect()
    np.savez(tmp_path / "y.npz", src=np.arange(3), dst=np.arange(4))
    with pytest.raises(Exception, match="'dst': 4"):
        binary.read_edge_arrays(spark, str(tmp_path / "y.npz")).collect()


def test_graph_of_any_storage(spark, tmp_path):
    store = readers.EdgeStore(spark, str(tmp_path / "s"))
    store.ingest(spark.createDataFrame([(0, 1, 5), (2, 3, 86_400_000_001), (1, 0, 2)], "src long, dst long, t long"))
    assert [(r.pos, r.src) for r in registry.open_storage(store).edges.orderBy("pos").collect()] == [(0, 1), (1, 0), (2, 2)]
    assert registry.open_storage(store, 3, 6).num_edges == 1


def test_departures_run_in_spark_alone(spark, tmp_path):
    """Counts are kept by Spark's own aggregation, in part before they are dealt out; Python isn't asked for each vertex and step."""
    fed(spark, f"file://{tmp_path}/in", [edges_of(spark)])
    d = W.changes(spark.readStream.schema(W.EDGES).parquet(f"file://{tmp_path}/in"), STEP, WIDTH)
    q = d.writeStream.format("memory").queryName("changed").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    plan = q._jsq.explainInternal(True)
    assert "Python" not in plan and "Pandas" not in plan and "partial_count" in plan
    assert {o["operatorName"] for o in q.lastProgress["stateOperators"]} == {"dedupeWithinWatermark", "stateStoreSave"}


@pytest.mark.parametrize("edges", [2, 4])
def test_sums_of_products_beyond_64_bits(spark, edges):
    """Two products of the largest ids that 32 bits hold add up to less than 2^63, four don't: then the sum is a decimal, as exact."""
    from tessera.plans import stream_queries
    from tessera.sources.graphs import from_edges

    big = (1 << 31) - 8  # 0 modulo 8
    g = from_edges(spark.createDataFrame([(i, big, big, i) for i in range(edges)], "eid long, src long, dst long, t long"), ["t", "eid"], 1 << 31, "big")
    out = stream_queries.binary_sums(g)
    assert [tuple(map(int, r)) for r in out.collect()] == [(0, edges, edges * big, edges * big, edges * big * big)]
    assert dict(out.dtypes)["products"] == ("bigint" if edges == 2 else "decimal(38,0)")
