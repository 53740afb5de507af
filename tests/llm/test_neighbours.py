"""Nearest vectors against plain products of all pairs."""

import numpy as np

from rivulet.llm import neighbours
from rivulet.llm.common import Tables

SCHEMA = "vec_id long, embedding array<float>"


def plain(rows, every, k):
    """{query row: [(vec_id, score)]}; the scores by the order of components."""
    good = []
    for i, (vec_id, v) in enumerate(rows):
        if v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good.append((i, vec_id, np.array(v, np.float32).astype(float)))
    dot = lambda a, b: sum(x * y for x, y in zip(a.tolist(), b.tolist()))
    out = []
    for i, q, v in good:
        if q is None or q % every:
            continue
        all_ = [(max(-1.0, min(1.0, dot(v, w) / (dot(v, v) * dot(w, w)) ** 0.5)), c) for j, c, w in good if j != i and len(w) == len(v)]
        all_.sort(key=lambda x: (-x[0], x[1] is None, x[1]))
        out += [(q, r + 1, c, s) for r, (s, c) in enumerate(all_[:k])]
    return sorted(out, key=str)


def held(spark, rows, every=50, k=5, schema=SCHEMA, **kw):
    with Tables() as own:
        got = sorted((tuple(r) for r in neighbours.nearest(spark.createDataFrame(rows, schema), every, k, **kw).collect()), key=str)
    own.release(spark)
    return got


def same(got, want):
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert np.allclose([g[3] for g in got], [w[3] for w in want], rtol=0, atol=1e-12)


def test_against_all_pairs_in_many_blocks(spark):
    rnd = np.random.default_rng(3)
    rows = [(i, rnd.normal(size=24).astype(np.float32).tolist()) for i in range(1500)]
    same(held(spark, rows, every=10, block=16), plain(rows, 10, 5))


def test_copies_near_copies_and_scaled_copies(spark):
    rnd = np.random.default_rng(4)
    hot = rnd.normal(size=8).astype(np.float32)
    rows = [(i, hot.tolist()) for i in range(300)]
    rows += [(1000 + i, (hot * np.float32(2.0 ** (i % 5))).tolist()) for i in range(100)]
    rows += [(2000 + i, (hot + rnd.normal(size=8).astype(np.float32) * np.float32(1e-4)).tolist()) for i in range(300)]
    rows += [(3000 + i, rnd.normal(size=8).astype(np.float32).tolist()) for i in range(100)]
    same(held(spark, rows), plain(rows, 50, 5))


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.0]), (50, None), (100, []), (150, [0.0, 0.0]), (200, [nan, 1.0]), (250, [inf, 1.0]), (300, [None, 1.0]), (350, [1e-30, 1e-30]), (400, [3e38, -3e38]),
        (None, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [1.0, 0.0]), (450, [1.0, 2.0, 3.0]), (500, [-1.0, -2.0, -3.0]), (-50, [2.0, 0.0]),
    ]
    same(held(spark, rows), plain(rows, 50, 5))
    assert held(spark, []) == []
    clash = SCHEMA + ", row long, vector string, cell int"
    same(held(spark, [(*r, 1, "x", 2) for r in rows], schema=clash), plain(rows, 50, 5))
    same(held(spark, [(0, [0.5] * 1500), (1, [0.5] * 1499 + [0.25])]), plain([(0, [0.5] * 1500), (1, [0.5] * 1499 + [0.25])], 50, 5))


def test_bounds_hold():
    """No cosine lies further from its int8 estimate than the bound says."""
    rnd = np.random.default_rng(5)
    for scale in (1, 1e-20, 1e20):
        v = rnd.normal(size=(200, 16)) * scale * np.exp(rnd.normal(size=(200, 16)) * 3)
        c = neighbours.Coded(v)
        true = (v / np.linalg.norm(v, axis=1)[:, None]) @ (v / np.linalg.norm(v, axis=1)[:, None]).T
        about = (c.code @ c.code.T) * c.scale[:, None] * c.scale[None, :]
        assert (np.abs(true - about) <= c.near[:, None] * c.rest[None, :] + c.rest[:, None] + 1e-5).all()
