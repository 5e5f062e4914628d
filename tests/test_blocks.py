"""Streams of vertices and of edges, decided block by block, against the plain loop over all of them."""

import numpy as np
import pytest

from tessera.operators import greedy as K
from tessera.sources.graphs import from_edges


@pytest.fixture(scope="module")
def case(spark):
    rng = np.random.default_rng(11)
    edges = [tuple(map(int, x)) for x in rng.integers(0, 60, (500, 2))] + [(3, i) for i in range(4, 40)] + [(5, 5), (59, 0), (59, 0)]
    e = spark.createDataFrame([(i, a, b, i) for i, (a, b) in enumerate(edges)], "eid long, src long, dst long, t long")
    return from_edges(e, ["t", "eid"], 64, "toy"), edges


def plain(edges, n, parts, mode, gamma=1.5):
    near = [[b for a, b in [*edges, *((b, a) for a, b in edges)] if a == v != b] for v in range(n)]
    part, load, mean = np.full(n, -1), np.zeros(parts), n / parts
    weight = len(edges) * parts ** (gamma - 1) / n**gamma * gamma
    for v in range(n):
        homes = part[near[v]] if near[v] else np.array([], int)
        votes = np.bincount(homes[homes >= 0], minlength=parts)
        if mode == "fennel":
            score = votes - weight * load ** (gamma - 1)
            score[1:][load[1:] >= 1.1 * mean] = -np.inf
        else:
            score = votes * np.maximum(0, 1 - load / mean) - 1e-9 * load
        part[v] = k = int(score.argmax())
        load[k] += 1
    return part.tolist()


@pytest.mark.parametrize("pairs", [1, 150, 1 << 21])
def test_vertices_in_blocks_equal_the_plain_stream(spark, case, monkeypatch, pairs):
    g, edges = case
    monkeypatch.setattr(K, "ONE_TASK_EDGES", 100, raising=False)  # what once was the most of a stream
    monkeypatch.setattr(K, "BLOCK_PAIRS", pairs, raising=False)
    monkeypatch.setattr(K, "RANGES", 5, raising=False)
    got = {}
    for r in K.streamed(g, 4).orderBy("mode", "v").collect():
        got.setdefault(r["mode"], []).append(r["part"])
    assert got == {mode: plain(edges, 64, 4, mode) for mode in ("fennel", "ldg")}


@pytest.mark.parametrize("block", [1, 100, 1 << 20])
def test_edges_in_blocks_equal_the_plain_stream(spark, case, monkeypatch, block):
    g, edges = case
    if block == 1:
        g, edges = from_edges(g.edges.where("pos < 6"), ["pos"], 64, "few"), edges[:6]
    monkeypatch.setattr(K, "ONE_TASK_EDGES", 100 if block > 1 else 1, raising=False)
    monkeypatch.setattr(K, "BLOCK_EDGES", block, raising=False)
    want, deg = [], np.bincount(np.array(edges).ravel(), minlength=64)
    for balance in (0.5, 2.0):
        has, size = np.zeros((64, 3), bool), np.zeros(3)
        for u, v in edges:
            share = deg[u] / (deg[u] + deg[v])
            score = has[u] * (2 - share) + has[v] * (1 + share) + balance * (size.max() - size) / (1 + size.max() - size.min())
            k = int(score.argmax())
            has[u, k] = has[v, k] = True
            size[k] += 1
            want.append((balance, u, v, k))
    assert sorted(tuple(r) for r in K.edge_streamed(g, 3, (0.5, 2.0)).collect()) == sorted(want)


def test_streams_of_nothing(spark):
    g = from_edges(spark.createDataFrame([], "eid long, src long, dst long, t long"), ["t", "eid"], 0, "none")
    assert K.streamed(g, 2).count() == K.edge_streamed(g, 2).count() == 0


def test_multilevel_leaves_its_result_alone(spark, case, tmp_path, monkeypatch):
    g, _ = case
    monkeypatch.setattr("tessera.functions.scratch.shared_dir", lambda spark: f"file://{tmp_path}")
    assert K.multilevel(g, 2, small=8).count() == 64
    left = [p.name.rsplit("-", 1)[0] for p in tmp_path.iterdir() if p.name.startswith("tessera-")]
    assert left.count("tessera-place") == 1 and "tessera-gains" not in left and "tessera-sym" not in left
