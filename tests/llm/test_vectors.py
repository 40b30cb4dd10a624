"""Whitening and centroid clustering against plain versions."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest

from stillwell.llm import polynomial
from stillwell.llm.centroids import Assigner, cluster_vectors, pivot_rows, squared
from stillwell.llm.whitening import products, whiten

SCHEMA = "vec_id long, embedding array<float>, cluster int, n string, whitened double"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 7, "x", 0.5) for i, v in rows], SCHEMA)


def vectors(count, d=64, seed=0, spread=1.0):
    rng = np.random.default_rng(seed)
    return (rng.standard_normal((count, d)) * np.linspace(0.2, 1, d) * spread).astype(np.float32).tolist()


BAD = [(900, None), (901, []), (902, [float("nan")] + [0.0] * 63), (903, [float("inf")] + [0.0] * 63), (904, [None] + [0.0] * 63), (905, [1.0] * 63)]


def plain_clusters(rows, clusters, rounds):
    kept = [(i, [math.floor(64 * float(np.float32(x))) for x in v]) for i, v in rows]
    order = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), i, v) for i, v in kept if i is not None)
    centres = [v for _, _, v in order[:clusters]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), k) for k, c in enumerate(centres))

    for _ in range(rounds):
        own = [nearest(v)[1] for _, v in kept]
        for k in range(len(centres)):
            members = [v for (_, v), o in zip(kept, own) if o == k]
            if members:
                centres[k] = [sum(c) // len(members) for c in zip(*members)]
    found = [(i, *nearest(v)) for i, v in kept]
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    per = {k: sum(d for _, d, own in found if own == k) for k in range(len(centres))}
    return sorted(((i, k, d, per[k], sum(per.values()), names[k]) for i, d, k in found), key=str)


@pytest.mark.parametrize("count, clusters", [(300, 16), (9, 16), (40, 3)])
def test_clusters_against_plain_ones(spark, count, clusters):
    rows = list(enumerate(vectors(count, spread=2.0)))
    rows += [(None, rows[0][1]), (0, rows[0][1]), (count, rows[1][1]), (-5, [0.0] * 64), (-5, [0.0] * 64)]
    got = cluster_vectors(table(spark, rows + BAD), clusters=clusters).collect()
    assert sorted(map(tuple, got), key=str) == plain_clusters(rows, clusters, 3)


def test_clusters_of_nothing_and_of_large_numbers(spark):
    assert cluster_vectors(table(spark, BAD)).collect() == []
    rows = [(k, [float((-1) ** k * 2 ** (k % 20))] * 64) for k in range(40)] + [(99, [3e7] * 64)]
    got = cluster_vectors(table(spark, rows), clusters=4).collect()
    assert sorted(map(tuple, got), key=str) == plain_clusters(rows[:-1], 4, 3)


def test_bounds_never_exceed_distances_and_rule_some_out():
    v = np.floor(64 * np.array(vectors(500, seed=3)) + 2000 * np.repeat(np.eye(64)[:10], 50, axis=0)).astype(np.int64)
    centroids = v[::31]
    pivots = pivot_rows(centroids)
    assigner = Assigner(centroids, pivots)
    near = np.stack([np.sqrt(squared(v, p).astype(float)) for p in pivots], axis=1)
    true = np.stack([squared(v, c) for c in centroids], axis=1)
    assert (assigner.bounds(near) <= true).all()
    chosen, best, measured = assigner.nearest(v, near)
    assert (best == true.min(axis=1)).all() and (chosen == true.argmin(axis=1)).all()
    assert measured < true.size / 2


def check_whitening(got, rows, components):
    y = np.array([[math.floor(64 * float(np.float32(x))) + 1_000_000 for x in v] for _, v in rows], dtype=object)
    n, d = y.shape
    sums = y.sum(axis=0)
    centred = n * y - sums
    v = np.array([[float(int(a)) for a in row] for row in centred.T @ centred]) / n ** 3
    values, own = np.linalg.eigh(v)
    values, own = values[::-1], own[:, ::-1]
    count = min(components, d)
    assert len(got) == n * count
    want_deviation = sorted(int((row * row).sum()) for row in centred for _ in range(count))
    assert sorted(r["deviation"] for r in got) == want_deviation
    assert {r["n"] for r in got} == {n}
    w = (centred.astype(float) / n) @ own[:, :count]
    for k in range(count):
        if values[k] < 1e-6 * values[0]:
            assert all(r["whitened"] is None and r["explained"] < 1e-12 for r in got if r["component"] == k + 1)
            continue
        assert all(abs(r["explained"] / (values[k] / np.trace(v)) - 1) < 1e-9 for r in got if r["component"] == k + 1)
        assert len({r["identity_error"] for r in got}) == 1 and got[0]["identity_error"] < 1e-9
        gaps = [abs(values[k] - values[j]) for j in range(d) if j != k]
        if min(gaps, default=1) > 1e-6 * values[0]:
            plain = w[:, k] / math.sqrt(values[k])
            mine = {r["vec_id"]: r["whitened"] for r in got if r["component"] == k + 1}
            ours = np.array([mine[i] for i, _ in rows])
            sign = np.sign(ours @ plain)
            assert np.abs(ours - sign * plain).max() < 1e-8


def test_whitening_against_plain_eigenvectors(spark):
    rows = list(enumerate(vectors(200)))
    check_whitening(whiten(table(spark, rows + BAD)).collect(), rows, 32)


def test_whitening_of_few_rows_constant_columns_and_several_fold_roots(spark):
    few = [(k, [float(k), 0.0, 1.0, float(k % 2)]) for k in range(5)]
    check_whitening(whiten(table(spark, few)).collect(), few, 32)
    square = [(k, [float(a), float(b), 0.0]) for k, (a, b) in enumerate([(1, 0), (-1, 0), (0, 1), (0, -1)])]
    got = whiten(table(spark, square)).collect()
    check_whitening(got, square, 32)
    for one in (1, 2):
        assert abs(sum(r["whitened"] ** 2 for r in got if r["component"] == one) / 4 - 1) < 1e-12
    alone = whiten(table(spark, [(1, [1.0, 2.0])])).collect()
    assert [(r["whitened"], r["explained"], r["identity_error"], r["deviation"]) for r in alone] == [(None, None, None, 0)] * 2
    assert whiten(table(spark, BAD[:5])).collect() == []


def test_whitening_of_large_numbers(spark):
    rng = np.random.default_rng(5)
    rows = [(k, [float(np.float32(x)) for x in rng.standard_normal(4) * [3e6, 2e6, 1e5, 3e4]]) for k in range(30)] + [(None, [1.0] * 4)]
    got = whiten(table(spark, rows + [(77, [1e30] * 4)])).collect()
    assert len(got) == 31 * 4 and {r["n"] for r in got} == {31}
    assert got[0]["identity_error"] < 1e-9


def test_products_of_large_numbers_are_exact():
    y = np.random.default_rng(1).integers(-2 ** 31, 2 ** 31, (1000, 5))
    plain = y.astype(object).T @ y.astype(object)
    assert products(y) == plain.tolist()


@pytest.mark.parametrize("seed", range(6))
def test_polynomials_have_the_eigenvalues_as_roots(seed):
    rng = np.random.default_rng(seed)
    d, rank = int(rng.integers(1, 9)), int(rng.integers(0, 9))
    a = rng.integers(-9, 10, (d, rank)).astype(object)
    a[rng.random((d, rank)) < 0.4] = 0
    m = (a @ a.T).tolist() if rank else [[0] * d for _ in range(d)]
    primes = polynomial.primes_beyond(2 * polynomial.coefficient_bound(m))
    rest = polynomial.polynomials_mod(m, primes)
    exact = [polynomial.from_residues(rest[:, k].tolist(), primes) for k in range(d + 1)]
    roots = [n / 2 ** b if b >= 0 else n * 2 ** -b for n, b in polynomial.real_roots(exact, d)]
    want = np.linalg.eigvalsh(np.array(m, dtype=float))[::-1]
    assert np.allclose(roots, want, atol=1e-8 * max(1, want[0]))
