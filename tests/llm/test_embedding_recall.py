"""Recall of the embedding search against brute force, where vectors fill few dimensions of many, and at two sizes."""

import numpy as np
import pytest

from tessera.llm import embedding_dedup as E


@pytest.mark.parametrize(("fills", "n"), [(2, 1500), (3, 1500), (3, 4000), (8, 4000), (64, 4000)])
def test_recall_at_intrinsic_dimensions(spark, fills, n):
    rng = np.random.default_rng(fills * n)
    base = rng.normal(size=(n, fills))
    base[: n // 4] = base[n // 4 : 2 * (n // 4)] + 0.2 * rng.normal(size=(n // 4, fills))  # near copies
    x = (base @ np.linalg.qr(rng.normal(size=(64, fills)))[0].T).astype(np.float32)
    u = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1)[:, None]
    true = (u @ u.T >= 0.95).sum(axis=1) - 1
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(4)
    counts, _ = E.links(df)
    got = np.zeros(n, np.int64)
    for r in counts.collect():
        got[r.id] += r.n
    assert (got <= true + 1).all() and got.sum() >= 0.99 * true.sum()
    if fills <= 3:
        assert got.sum() == true.sum()


def test_filled_dimensions():
    rng = np.random.default_rng(0)
    for d in (2, 8, 64):
        x = rng.normal(size=(3000, d)) @ np.linalg.qr(rng.normal(size=(64, d)))[0].T
        x /= np.linalg.norm(x, axis=1)[:, None]  # a sphere: one dimension less, and of a few thousand vectors close ones are not that close
        assert 0.45 * d <= E.filled(x) <= 1.2 * d
