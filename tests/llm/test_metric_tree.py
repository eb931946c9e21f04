import math
import random

import numpy as np

from tidemark.llm import metric_tree as mt
from tidemark.llm.common import work_folder

SCHEMA = "vec_id long, embedding array<float>, score string"


def brute(rows, every, k):
    good = [(i, [math.floor(1024.0 * float(np.float32(x))) for x in v]) for i, v, _ in rows
            if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, vector in {i: v for i, v in sorted(good, reverse=True)}.items():
        if q % every == 0:
            hits = sorted((-sum(a * b for a, b in zip(vector, w)), i) for i, w in good if i != q)[:k]
            out += [(q, rank + 1, i, -s) for rank, (s, i) in enumerate(hits)]
    return sorted(out)


def search(spark, rows, every=10, k=10):
    vectors = mt.scaled_vectors(spark.createDataFrame(rows, SCHEMA))
    found = mt.top_k(vectors, vectors.where(f"vec_id % {every} = 0"), work_folder(spark), k)
    return sorted(tuple(r) for r in found.collect())


def test_equals_brute_force_with_copies_ties_and_bad_vectors(spark, monkeypatch):
    monkeypatch.setattr(mt, "PIVOTS", 5)
    rng = random.Random(1)
    centers = [[rng.gauss(0, 0.1) for _ in range(8)] for _ in range(6)]
    rows = [(i, [x + rng.gauss(0, 0.02) for x in rng.choice(centers)], "s") for i in range(300)]
    rows += [(1000 + i, centers[0], "s") for i in range(150)]  # one vector with a third of the rows
    rows += [(2000, None, "s"), (2010, [1.0, None], "s"), (2020, [float("nan")] * 8, "s"), (2030, [float("inf")] * 8, "s"),
             (None, centers[1], "s"), (2040, [0.5, -0.25], "s"), (2050, [], "s"), (2060, [0.0] * 8, None), (7, centers[2], "s"), (7, centers[2], "s")]
    assert search(spark, rows) == brute(rows, 10, 10)


def test_fewer_than_k_and_empty_tables(spark):
    rows = [(0, [0.1, 0.2], "s"), (1, [0.3, -0.1], "s"), (2, [0.3, -0.1], "s")]
    assert search(spark, rows, every=1) == brute(rows, 1, 10)
    assert search(spark, rows[:1], every=1) == []
    assert search(spark, []) == []


def test_bounds_exclude_most_pages_of_clustered_data():
    rng = np.random.default_rng(2)
    centers = rng.normal(0, 800, (20, 16))
    rows = np.floor(centers[rng.integers(0, 20, 2000)] + rng.normal(0, 8, (2000, 16))).astype(np.int64)
    limit = float((rows**2).sum(axis=1).max())
    pages = list(mt._tree_pages(1, np.arange(2000), rows, limit))
    assert sorted(i for p in pages for i in p["ids"]) == list(range(2000))
    root, own = pages[0], pages[1:]
    top = {"center": root["center"], "centers": np.array([p["center"] for p in own]), "radii": np.array([p["radius"] for p in own]),
           "root_distances": np.array([p["root_distance"] for p in own])}
    seen = []

    class Counted(dict):
        def __getitem__(self, key):
            if key == "distances":
                seen.append(1)
            return super().__getitem__(key)

    leaves = [Counted(ids=p["ids"], rows=p["vectors"].reshape(-1, 16), distances=p["distances"]) for p in own]
    for q in range(20):
        best = mt.search_tree(q, rows[q], None, top, leaves, 10, limit)
        scores = rows @ rows[q]
        expected = sorted((-int(s), i) for i, s in enumerate(scores) if i != q)[:10]
        assert [(-int(s), int(i)) for s, i in zip(best.scores, best.ids)] == expected
    assert len(seen) < 0.5 * 20 * len(own)


def test_exact_products_of_large_components():
    a = np.array([[2**30, -(2**30)], [3, 5]], dtype=np.int64)
    assert mt.products(a, a).tolist() == [[2**61, -(2**31)], [-(2**31), 34]]
