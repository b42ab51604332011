"""Hard negatives and whitening against brute force, with hard cases and empty tables."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from inboxlake.llm import hard_negatives, vectors, whitening

SCHEMA = "vec_id long, embedding array<double>, label int, x string, key int, score double, ab string"


def table(spark, rows):
    """Rows (vec_id, embedding, label) with extra columns of clashing names."""
    return spark.createDataFrame([(*r, "x", 1, 2.0, None) for r in rows], SCHEMA).repartition(3)


def hard_rows():
    rng = np.random.default_rng(5)
    rows = [(i, [float(v) for v in rng.standard_normal(6)], int(i % 4)) for i in range(130)]
    rows += [(200 + i, rows[3][1], i % 3) for i in range(40)]  # copies: ties across labels
    rows += [(300, None, 1), (301, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (302, [float("nan")] * 6, 2),
             (303, [math.inf, 0.0, 0.0, 0.0, 0.0, 0.0], 2), (304, [-math.inf, 0.0, 0.0, 0.0, 0.0, 0.0], 2), (305, [0.0] * 6, 3),
             (306, [], 0), (307, [1.0, 2.0], 1), (308, [1.0] * 6, None), (None, [1.0] * 6, 1),
             (309, [-1.0] * 6, 1), (310, [1e-200] * 6, 1)]
    return rows + [rows[5], rows[100]]  # repeated rows, one of them an anchor


def finite(v):
    return v is not None and all(c is not None and math.isfinite(c) for c in v)


def mined(rows, is_anchor, k_pos=5, k_neg=5):
    rows = [(i, [math.floor(256 * c) for c in v], lab) for i, v, lab in rows if finite(v) and lab is not None
            and i is not None]
    anchors = {}
    for i, v, lab in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        if is_anchor(i):
            anchors.setdefault(i, (v, lab))
    out = []
    for a, (av, al) in anchors.items():
        scored = sorted((-sum(p * q for p, q in zip(av, v)), i, lab) for i, v, lab in rows if i != a)
        for s, i, _ in [r for r in scored if r[2] == al][:k_pos]:
            fits = [r for r in scored if r[2] != al and 80 * -s <= 100 * -r[0] <= 100 * -s]
            out += [(a, i, n, r[1], -s, -r[0]) for n, r in enumerate(fits[:k_neg], 1)]
    return sorted(out)


@pytest.mark.parametrize("block_bytes", [500, 4 << 20])
def test_mines_hard_negatives(spark, block_bytes):
    rows = hard_rows()
    df = table(spark, rows).where(vectors.is_finite(F.col("embedding"))).select(
        "vec_id", "label", vectors.scaled(F.col("embedding"), 256).alias("x"), "key", "score", "ab")
    got = hard_negatives.mine(df, F.col("vec_id") % 10 == 0, block_bytes=block_bytes)
    assert sorted(map(tuple, got.collect())) == mined(rows, lambda i: i % 10 == 0)


def test_keys_sort_as_their_parts():
    cases = [(a, s, r, i) for a in (-5, 0, 7) for s in (-(1 << 63), -1, 0, 3, (1 << 63) - 1) for r in (0, 1)
             for i in (-2, 9)]
    packed = [hard_negatives.pack([a], [s], r, [i])[0].as_py() for a, s, r, i in cases]
    by_bytes = [c for _, c in sorted(zip(packed, cases))]
    assert by_bytes == sorted(cases, key=lambda c: (c[0], -c[1], c[2], c[3]))
    assert [next(hard_negatives.unpack(hard_negatives.pack([a], [s], r, [i]))) for a, s, r, i in cases] == cases


def test_scores_are_exact_beyond_doubles():
    a, b = np.array([[1 << 40, 3]]), np.array([[1 << 20, 1], [-(1 << 30), 5], [1 << 30, 0]])
    assert vectors.inner_products(a, b).tolist() == [[(1 << 60) + 3, -(1 << 63), (1 << 63) - 1]]


@pytest.mark.parametrize("rows", [[], [(100, None, 1)], [(100, [1.0, 2.0], 1)]])
def test_few_or_no_vectors(spark, rows):
    df = table(spark, rows).where(vectors.is_finite(F.col("embedding"))).select(
        "vec_id", "label", vectors.scaled(F.col("embedding"), 256).alias("x"))
    assert hard_negatives.mine(df, F.col("vec_id") % 100 == 0).collect() == []
    assert whitening.whiten(df).collect() == []


def test_whitens(spark):
    rows = hard_rows()
    df = table(spark, rows).where(vectors.is_finite(F.col("embedding"))).select(
        "vec_id", vectors.scaled(F.col("embedding"), 256).alias("x"), "label", "key")
    got = whitening.whiten(df).collect()
    kept = [(i, [math.floor(256 * c) for c in v] + [0] * (6 - len(v))) for i, v, _ in rows if finite(v)]
    # vectors of different lengths are different vectors even where zeros make them equal
    lengths = {tuple(math.floor(256 * c) for c in v) for _, v, _ in rows if finite(v)}
    fit = np.array([list(v) + [0] * (6 - len(v)) for v in lengths])
    n, sums = len(fit), fit.sum(axis=0)
    centred = fit - sums / n
    cov = centred.T @ centred / n
    values, basis = np.linalg.eigh(cov)
    values, basis = values[::-1][:4], basis[:, ::-1][:, :4]
    assert len(got) == 4 * len(kept) and {r.component for r in got} == {1, 2, 3, 4}
    assert {r.n for r in got} == {n} and max(r.identity_error for r in got) < 1e-10
    assert [next(r.explained for r in got if r.component == c) for c in (1, 2, 3, 4)] \
        == pytest.approx(list(values / np.trace(cov)), rel=1e-12)
    want = {}
    for i, x in kept:
        w = (np.array(x) - sums / n) @ basis / np.sqrt(values)
        want.setdefault(i, []).append((int(((n * np.array(x) - sums) ** 2).sum()), *np.abs(w)))
    have = {}
    for r in sorted(got, key=lambda r: r.component):
        have.setdefault((r.vec_id, r.deviation), {}).setdefault(r.component, []).append(r.whitened)
    signs = {}
    for (i, deviation), by in have.items():
        match = [w for w in want[i] if w[0] == deviation]
        assert all(len(by[c]) == len(match) for c in by)
        for c in by:
            assert sorted(np.abs(by[c])) == pytest.approx(sorted(m[c] for m in match), rel=1e-9, abs=1e-9)
            exact = (np.array(next(x for j, x in kept if j == i
                                   and int(((n * np.array(x) - sums) ** 2).sum()) == deviation)) - sums / n) @ basis[:, c - 1]
            if abs(exact) > 1e-6:
                signs.setdefault(c, set()).add(np.sign(exact) * np.sign(by[c][0]))
    assert all(len(s) == 1 for s in signs.values())  # one sign for all rows


@pytest.mark.parametrize("gap", [1.0, 1e-6, 0.0])
def test_jacobi_davidson_on_close_and_equal_eigenvalues(gap):
    rng = np.random.default_rng(2)
    q, _ = np.linalg.qr(rng.standard_normal((40, 40)))
    values = np.concatenate([[9, 8 + gap, 8, 7, 7 - gap / 2], np.linspace(6, 0, 35)])
    a = (q * values) @ q.T
    passes = []
    got, basis = whitening.leading_pairs(lambda v: (passes.append(1), a @ v)[1], 40, 4)
    assert got == pytest.approx([9, 8 + gap, 8, 7] if gap < 1 else [9, 9, 8, 7], rel=1e-13)
    assert np.abs(a @ basis - basis * got).max() < 1e-12 and np.abs(basis.T @ basis - np.eye(4)).max() < 1e-13
    assert len(passes) < 150


@pytest.mark.parametrize("dims", [1, 2, 3, 5])
def test_jacobi_davidson_in_few_dimensions(dims):
    a = np.diag(np.arange(1.0, dims + 1))
    got, basis = whitening.leading_pairs(lambda v: a @ v, dims, 4)
    assert got == pytest.approx(sorted(np.diag(a))[::-1][:4]) and basis.shape == (dims, min(4, dims))


def test_no_variance_and_low_rank(spark):
    df = spark.createDataFrame([(i, [7, -3, 2]) for i in range(5)], "vec_id long, x array<long>")
    assert whitening.whiten(df).collect() == []
    flat = spark.createDataFrame([(i, [i, 2 * i, 5]) for i in range(9)], "vec_id long, x array<long>")
    got = whitening.whiten(flat).collect()
    assert {r.component for r in got} == {1} and got[0].explained == pytest.approx(1)


def test_minres_solves_indefinite_systems_in_step():
    rng = np.random.default_rng(4)
    a = rng.standard_normal((30, 30))
    a, b, shift = a + a.T, rng.standard_normal((30, 3)), np.array([0.3, -1.0, 4.0])
    x = whitening.minres(lambda v: a @ v - v * shift, b, 60, 1e-10)
    assert np.abs(a @ x - x * shift - b).max() < 1e-6


def test_deviations_beyond_64_bits():
    x = np.array([[1, 2], [1 << 40, 0]])
    assert whitening.deviations(x, 1 << 30, [5, 5]) == [((1 << 30) - 5) ** 2 + ((1 << 31) - 5) ** 2, None]
    assert whitening.deviations(x[:1], 3, [5, 5]) == [4 + 1]
