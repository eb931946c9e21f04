import numpy as np
import pytest

from tidemark.llm import whitening
from tidemark.llm.common import work_folder
from tidemark.llm.queries import op12_whitened_vectors


def brute(vectors, weights=None):
    """n, S, deviation, eigenvalues and components over distinct integer vectors."""
    x = np.array(sorted(set(map(tuple, vectors))), dtype=object)
    w = np.ones(len(x)) if weights is None else np.array([weights[tuple(v)] for v in x], dtype=float)
    n = int(w.sum())
    sums = (x * w.astype(int).astype(object)[:, None]).sum(axis=0)
    z = ((x * n - sums) / n).astype(float)
    cov = (z * w[:, None]).T @ z / n
    values, vecs = np.linalg.eigh(cov)
    return n, sums, values[::-1], vecs.T[::-1], np.trace(cov)


def check(rows, result, by_count=False):
    good = [(k, tuple(int(np.floor(256 * float(c))) for c in v)) for k, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    counts = {}
    for _, v in good:
        counts[v] = counts.get(v, 0) + 1
    n, sums, values, vecs, trace = brute([v for _, v in good], counts if by_count else None)
    assert sorted(r.vec_id for r in result if r.component == 1) == sorted(k for k, _ in good)
    by_id = dict(good)
    signs = {}
    for r in result:
        d = np.array(by_id[r.vec_id], dtype=object) * n - sums
        assert r.n == n and r.deviation == sum(int(e) ** 2 for e in d)
        k = r.component - 1
        expected = float((d / n).astype(float) @ vecs[k]) / np.sqrt(values[k])
        if abs(expected) > 1e-6:
            sign = signs.setdefault(k, np.sign(expected) * np.sign(r.whitened))
            assert np.sign(expected) * sign == np.sign(r.whitened)
        assert abs(abs(r.whitened) - abs(expected)) < 1e-9 * max(1, abs(expected))
        assert abs(r.explained - values[k] / trace) < 1e-9 and r.identity_error < 1e-9


@pytest.mark.parametrize("by_count", [False, True])
def test_equals_brute_force(spark, by_count):
    rng = np.random.default_rng(1)
    rows = [(k, (rng.normal(size=7) * np.arange(1, 8) * 0.2 + 3).tolist()) for k in range(400)]
    rows += [(1000 + k, rows[3][1]) for k in range(300)]  # a third of all rows share one vector
    rows += [(2000, None), (2001, [None] * 7), (2002, [float("nan")] * 7), (2003, [float("inf")] + [0.0] * 6)]
    df = spark.createDataFrame([(k, v, "n", 5) for k, v in rows], "vec_id long, embedding array<double>, x string, salt int")
    found = whitening.whiten(whitening.whole_vectors(df), work_folder(spark), by_count=by_count)
    check(rows, found.collect(), by_count)


def test_query_equals_brute_force(spark):
    sf_dir = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    result = op12_whitened_vectors(spark, sf_dir).collect()
    assert len(result) == 4 * len(rows)
    check(rows, result)


def whitened(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    return whitening.whiten(whitening.whole_vectors(df), work_folder(spark)).collect()


def test_tables_without_spread_give_no_rows(spark):
    assert whitened(spark, []) == []
    assert whitened(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [])]) == []


def test_fewer_dimensions_and_lengths_apart(spark):
    found = whitened(spark, [(1, [0.0]), (2, [1.0]), (None, [1.0]), (4, [0.0, 0.0]), (5, [1.0, 0.0]), (6, [0.0, 3.0]), (6, [0.0, 3.0])])
    assert sorted((str(r.vec_id), r.component, r.n) for r in found) == sorted(
        [("1", 1, 2), ("2", 1, 2), ("None", 1, 2)] + [(k, c, 3) for k in ("4", "5", "6", "6") for c in (1, 2)]
    )
    assert all(abs(abs(r.whitened) - 1) < 1e-12 for r in found if r.n == 2)


def test_huge_entries_do_not_wrap(spark):
    found = whitened(spark, [(1, [1e300, 0.0]), (2, [0.0, 1.0]), (3, [3.0, 3.0])])
    assert {r.vec_id for r in found} == {1, 2, 3}
    assert all(r.deviation is None or r.deviation >= 0 for r in found) and any(r.deviation is None for r in found)
