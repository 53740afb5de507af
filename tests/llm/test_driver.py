"""What the driver itself holds and does."""

import tracemalloc

import numpy as np

from rivulet.llm import language, near


def test_model_is_built_in_portions():
    rng = np.random.default_rng(5)
    text = rng.integers(97, 97 + 26, (4, 300_000)).astype(np.uint8)
    counts = {f"l{k}": np.unique(language.grams(t, np.array([0, len(t)])), return_counts=True) for k, t in enumerate(text)}
    tracemalloc.start()
    model = language.Model(counts, language.ORDER)
    kept, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    grams = sum(g.nbytes + n.nbytes for g, n in counts.values())
    assert model.cost.shape[1] > 15_000 and peak < kept + 4 * grams
    costs = 2.0 ** -model.cost.astype(float)
    assert (costs > 0).all() and (costs[:, :, 2:] <= 1).all()


def test_stars_need_no_round(spark):
    stars = [(k, 10 * k + j) for k in (1, 2, 3) for j in range(1, 9)]
    edges = spark.createDataFrame([*stars, *[(b, a) for a, b in stars], (7, 7)], "a long, b long")
    got = near.components(edges, rounds=0).collect()
    assert sorted((r["component"], r["node"]) for r in got) == sorted(stars)
    assert near.components(edges.limit(0), rounds=0).count() == 0


def test_what_is_no_star_goes_on(spark):
    # a path, two stars that share a node, and a ring
    rows = [(k, k + 1) for k in range(20)] + [(100, 110), (101, 110), (101, 111)] + [(200, 201), (201, 202), (200, 202)]
    got = near.components(spark.createDataFrame(rows, "a long, b long")).collect()
    want = {k: 0 for k in range(1, 21)} | {101: 100, 110: 100, 111: 100} | {201: 200, 202: 200}
    assert len(got) == len(want) and {r["node"]: r["component"] for r in got} == want
