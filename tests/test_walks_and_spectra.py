"""Visit orders against sequential walks, sweeps and lambda2 against numpy."""

import numpy as np
import pytest

from tessera.operators import spectra as P
from tessera.operators import walks as W
from tessera.sources.graphs import from_edges


def make(spark, rows, n):
    e = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "eid long, src long, dst long, t long")
    return from_edges(e, ["t", "eid"], n, "toy")


def walked(edges, n, root):
    near = {v: sorted({b for x, y in edges for a, b in ((x, y), (y, x)) if a == v and b != v}) for v in range(n)}
    order, parent = [], {}
    for start in [(root + i) % n for i in range(n)]:
        if start in parent:
            continue
        parent[start] = None
        queue = [start]
        for v in queue:
            for b in near[v]:
                if b not in parent:
                    parent[b] = v
                    queue.append(b)
        order += queue
    kids = {v: [b for b in order if parent[b] == v] for v in order}
    pre, stack = [], [v for v in reversed(order) if parent[v] is None]
    while stack:
        v = stack.pop()
        pre.append(v)
        stack += reversed(kids[v])
    return order, parent, pre


CASES = {
    "chain": ([(i, i + 1) for i in range(14)], 15),
    "forest": ([(3, 4), (4, 5), (0, 1), (7, 7), (1, 6), (6, 2)], 9),
    "random": ([tuple(map(int, x)) for x in np.random.default_rng(1).integers(0, 60, (110, 2))], 60),
    "star": ([(0, i) for i in range(1, 40)] + [(39, 40)], 41),
    "none": ([], 4),
}


@pytest.mark.parametrize("case", CASES)
def test_visit_orders(spark, case):
    edges, n = CASES[case]
    g = make(spark, [(a, b, i) for i, (a, b) in enumerate(edges)], n)
    degree = [len({b for x, y in edges for a, b in ((x, y), (y, x)) if a == v and b != v}) for v in range(n)]
    root = max(range(n), key=lambda v: (degree[v], -v)) if edges else 0
    order, parent, pre = walked(edges, n, root)
    got = W.queue_order(g)
    rows = sorted(got.collect(), key=lambda r: r.rank)
    assert [r.rank for r in rows] == list(range(n)) and [r.v for r in rows] == order
    assert {r.v: r.parent for r in rows} == parent
    assert [r.v for r in sorted(W.preorder(got).collect(), key=lambda r: r.rank)] == pre


def laplacian(edges, n):
    a = np.zeros((n, n))
    for x, y in edges:
        if x != y:
            a[x, y] += 1
            a[y, x] += 1
    use = a.sum(1) > 0
    a = a[np.ix_(use, use)]
    d = a.sum(1)
    return a, d, np.eye(len(d)) - a / np.sqrt(np.outer(d, d)), np.flatnonzero(use)


CLUSTERS = [(c * 6 + i, c * 6 + j) for c in range(3) for i in range(6) for j in range(i)] + [(0, 6), (7, 12), (7, 12), (3, 3)]


def test_fiedler_sweep(spark):
    rng = np.random.default_rng(2)
    for edges, n in ((CLUSTERS, 19), ([tuple(map(int, x)) for x in rng.integers(0, 30, (90, 2))], 30), ([(i, i + 1) for i in range(11)], 12)):
        a, d, lap, ids = laplacian(edges, n)
        e, q = np.linalg.eigh(lap)
        lam, side, row = P.fiedler(make(spark, [(x, y, i) for i, (x, y) in enumerate(edges)], n))
        assert lam == pytest.approx(e[1], abs=1e-4)
        # The least conductance of a prefix of numpy's vector, either way round.
        order = np.argsort(q[:, 1] / np.sqrt(d), kind="stable")
        best = min(a[np.ix_(s, np.setdiff1d(order, s))].sum() / min(d[s].sum(), d.sum() - d[s].sum()) for s in (order[:k] for k in range(1, len(order))))
        got = row.first()
        assert got["conductance"] == pytest.approx(best, abs=1e-6)
        s = np.searchsorted(ids, sorted(r.v for r in side.collect() if r.side))
        assert got["cut"] == a[np.ix_(s, np.setdiff1d(np.arange(len(d)), s))].sum() and got["vol"] == min(d[s].sum(), d.sum() - d[s].sum())
        assert e[1] / 2 - 1e-9 <= got["conductance"] <= (2 * e[1]) ** 0.5 + 1e-9


def test_lambda2_of_all_snapshots(spark):
    rng = np.random.default_rng(4)
    edges = [tuple(map(int, x)) for x in rng.integers(0, 14, (160, 2))] + CLUSTERS[:40]
    g = make(spark, [(a, b, i) for i, (a, b) in enumerate(edges)], 20)
    got = {r.snap: (r.lambda2, r.vol) for r in P.snapshot_gaps(g, 5).collect()}
    spatial = 0.0
    for k in range(5):
        own = [e for i, e in enumerate(edges) if i * 5 // 200 == k]
        a, d, lap, _ = laplacian(own, 20)
        e = np.linalg.eigvalsh(lap)
        assert got[k] == (pytest.approx(e[1], abs=1.1e-3), d.sum())
        spatial += e[1] / 2 * d.sum() / 4
    assert P.lower_bound(g, 5, 2).first()["spatial"] == pytest.approx(spatial, abs=0.02)


def test_lambda2_of_pieces_and_of_nothing(spark):
    assert P.fiedler(make(spark, [(0, 1, 1), (2, 3, 2)], 5))[0] == pytest.approx(0, abs=1e-6)
    lam, side, _ = P.fiedler(make(spark, [(1, 1, 1)], 3))
    assert lam == 0 and side.count() == 0
