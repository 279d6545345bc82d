"""Whitening against plain numpy, and its exact steps against slow exact ones."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest

from gaugeflow.llm import whitening


def psd(rng, d, rank, size=9):
    b = [[rng.randint(-size, size) for _ in range(d)] for _ in range(rank)]
    return [[sum(r[i] * r[j] for r in b) for j in range(d)] for i in range(d)]


def plain_elementary(m):
    """By Faddeev and LeVerrier's recurrence in fractions."""
    d, e = len(m), [1]
    a = [[Fraction(int(i == j)) for j in range(d)] for i in range(d)]
    for k in range(1, d + 1):
        p = [[sum(m[i][x] * a[x][j] for x in range(d)) for j in range(d)] for i in range(d)]
        c = sum(p[i][i] for i in range(d)) / k
        e.append(c)
        a = [[(c if i == j else 0) - p[i][j] for j in range(d)] for i in range(d)]
    return e


@pytest.mark.parametrize("d, rank, size", [(1, 1, 9), (3, 3, 9), (6, 4, 9), (9, 9, 10**12)])
def test_polynomial_roots_and_vectors(spark, d, rank, size):
    m = psd(random.Random(d), d, rank, size)
    assert whitening.characteristic(spark, m) == plain_elementary(m)
    parts = whitening.components(spark, m, 8)
    want = np.linalg.eigvalsh(np.array(m, dtype=float))[::-1][: min(8, rank)]
    assert [float(x) for x, _ in parts] == pytest.approx(want.tolist(), rel=1e-9)
    v = np.array([v for _, v in parts])
    assert np.abs(v @ v.T - np.eye(len(v))).max() < 1e-14
    for root, x in parts:
        off = [sum(Fraction(a) * Fraction(b) for a, b in zip(row, x, strict=True)) - root * Fraction(y) for row, y in zip(m, x, strict=True)]
        assert max(map(abs, off)) < Fraction(root) / 10**14


def test_repeated_and_close_roots(spark):
    two = [[2, 0, 0], [0, 2, 0], [0, 0, 1]]
    roots = whitening.largest_roots(whitening.characteristic(spark, two), 8)
    assert [m for _, m in roots] == [2, 1]
    assert [float(r) for r, _ in roots] == pytest.approx([2.0, 1.0], rel=1e-15)
    v = np.array([v for _, v in whitening.components(spark, two, 8)])
    assert np.abs(v @ v.T - np.eye(3)).max() < 1e-14
    close = [[10**15, 1], [1, 10**15]]  # the roots differ in the 15th place
    parts = whitening.components(spark, close, 2)
    assert [x for x, _ in parts] == [pytest.approx(Fraction(10**15 + 1)), pytest.approx(Fraction(10**15 - 1))]
    assert parts[0][0] - parts[1][0] == pytest.approx(2)
    assert [abs(round(x, 12)) for _, v in parts for x in v] == [round(math.sqrt(0.5), 12)] * 4
    assert whitening.components(spark, [[0, 0], [0, 0]], 8) == []
    assert whitening.components(spark, [], 8) == []


SCHEMA = "vec_id long, embedding array<float>, n int, k int, whitened string"


def plain(vectors, most):
    x = [[math.floor(1024 * float(np.float32(c))) + 100_000 for c in v] for v in vectors]
    n, s = len(x), [sum(c) for c in zip(*x, strict=True)]
    dev = [sum((n * a - b) ** 2 for a, b in zip(v, s, strict=True)) for v in x]
    a = np.array(x, dtype=float)
    values, axes = np.linalg.eigh(np.cov(a.T, bias=True))
    values, axes = values[::-1][:most], axes[:, ::-1][:, :most]
    return n, dev, (a - a.mean(0)) @ axes / np.sqrt(values), values / np.trace(np.cov(a.T, bias=True))


def test_whitening_against_numpy(spark):
    rng = np.random.default_rng(4)
    vectors = (rng.normal(size=(300, 12)) @ rng.normal(size=(12, 12))).tolist() + [[0.5] * 12] * 100
    odd = [(900, None, 0, 0, ""), (901, [1.0, None, *[0.0] * 10], 0, 0, ""), (902, [float("nan")] * 12, 0, 0, ""), (903, [float("inf"), *[0.0] * 11], 0, 0, ""), (904, [1.0], 0, 0, ""), (905, [], 0, 0, ""), (906, [3e38] * 12, 0, 0, "")]
    rows = [(i, v, 0, 0, "") for i, v in enumerate(vectors)] + odd
    got = sorted(whitening.whiten(spark.createDataFrame(rows, SCHEMA).repartition(5), most=8).collect(), key=lambda r: r["vec_id"])
    n, dev, white, explained = plain(vectors, 8)
    assert [r["vec_id"] for r in got] == list(range(400))
    assert {r["n"] for r in got} == {n}
    assert [r["deviation"] for r in got] == dev
    have = np.array([r["whitened"] for r in got])
    signs = np.sign((have * white).sum(0))
    assert np.abs(have - white * signs).max() < 1e-8
    assert got[0]["explained"] == pytest.approx(explained.tolist(), rel=1e-9)
    assert 0 <= got[0]["identity_error"] < 1e-12


def test_few_equal_and_no_vectors(spark):
    make = lambda *v: whitening.whiten(spark.createDataFrame([(i, x, 0, 0, "") for i, x in enumerate(v)], SCHEMA)).collect()
    assert make() == []
    assert make(None, [None]) == []
    assert [(r["whitened"], r["deviation"]) for r in make([1.0, 2.0], [1.0, 2.0])] == [([], 0), ([], 0)]
    line = make([0.0, 0.0], [1.0, 1.0], [None, 1.0])
    assert [len(r["whitened"]) for r in line] == [1, 1]
    assert sorted(r["whitened"][0] for r in line) == pytest.approx([-1, 1])
    assert make([], [])[0]["whitened"] == []
    assert {r["deviation"] for r in make([4e12], [-4e12])} == {None}  # beyond a long


def test_sums_are_exact_for_large_entries(spark):
    big = [[float(2**40), 1.0], [float(-(2**41)), 0.5], [3.0, 2.0**30]]
    df = spark.createDataFrame([(0, v) for v in big], "vec_id long, embedding array<double>")
    x = [[math.floor(1024 * c) + 100_000 for c in v] for v in big]
    found = whitening.scatter(*whitening.remaining(df))
    assert found.sums == [sum(c) for c in zip(*x, strict=True)]
    assert found.matrix == [[3 * sum(v[i] * v[j] for v in x) - found.sums[i] * found.sums[j] for j in range(2)] for i in range(2)]
