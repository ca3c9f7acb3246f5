"""Whitening against brute force over exact integers, and the moments' merging."""

import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest

from sievekit.llm import whitening
from sievekit.llm.whitening import _gathered, _nothing, _packed, _unpacked, op11_embedding_whitening, rounded, whiten

COLUMNS = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def vectors(spark, rows, extra=True):
    rows = [(i, None if v is None else [None if c is None else float(c) for c in v]) for i, v in rows]
    made = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    return made.selectExpr("*", "1 AS n", "2 AS dim", "'x' AS key") if extra else made


def brute(rows):
    """x vectors of good rows, n, sums, and V of the distinct ones."""
    good = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    xs = [(i, tuple(math.floor(256 * float(np.float32(c))) for c in v)) for i, v in good]
    fit = sorted({x for _, x in xs})
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    cov = [[float(sum(Fraction(n * x[a] - sums[a], n) * Fraction(n * x[b] - sums[b], n) for x in fit) / n) for b in range(len(sums))] for a in range(len(sums))]
    return xs, n, sums, np.array(cov)


def test_against_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = [(k, (rng.normal(size=6) * [5, 3, 2, 1, 0.5, 0.2] + 7).tolist()) for k in range(60)]
    rows += [(100 + k, rows[3][1]) for k in range(40)]  # one vector of many copies
    rows += [(200, None), (201, [1.0, None, 2, 3, 4, 5]), (202, [float("nan")] + [0.0] * 5), (203, [float("inf")] + [0.0] * 5), (204, []), (None, rows[0][1]), (205, [1.0, 2.0])]
    found = whiten(vectors(spark, rows).repartition(7)).collect()
    xs, n, sums, cov = brute([r for r in rows if r[0] != 205])
    assert len(found) == 4 * len(xs)
    assert sorted({r.vec_id for r in found if r.vec_id is not None}) == sorted({i for i, _ in xs if i is not None})
    values = np.linalg.eigvalsh(cov)[::-1]
    by = {(r.vec_id, r.component): r for r in found}
    for i, x in xs:
        for c in range(4):
            r = by[i, c + 1]
            assert r.n == n and r.deviation == sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True))
            assert r.explained == pytest.approx(values[c] / np.trace(cov), rel=1e-9) and r.identity_error < 1e-9
    # Whitened values are projections on unit eigenvectors: V times the direction they have in x gives it again.
    white = np.array([[by[i, c + 1].whitened for c in range(4)] for i, _ in xs])
    apart = np.array([x for _, x in xs]) - np.array(sums) / n
    ways = np.linalg.lstsq(apart, white, rcond=None)[0] * np.sqrt(values[:4])
    assert np.allclose(cov @ ways, ways * values[:4], atol=1e-7) and np.allclose((ways**2).sum(axis=0), 1)


def test_merge_is_order_free():
    rng = np.random.default_rng(1)
    x = rng.integers(-500, 500, (301, 5)) + np.array([10**9, 0, -(10**6), 3, 4])
    total = _nothing(5)
    for part in np.split(x, [0, 1, 50, 50, 222]):
        total = total.merge(_gathered(part) if len(part) else _nothing(5))
    whole = x - x.mean(axis=0)
    assert total.n == 301 and total.sums == x.sum(axis=0).tolist()
    assert np.allclose(total.scatter, whole.T @ whole, rtol=1e-8, atol=0.1)


def test_pack_round_trip():
    x = np.array([[1, -128], [127, 128], [70_000, -1], [1 << 62, -(1 << 63)], [0, 0]])
    assert (_unpacked(_packed(x), 2) == x).all() and [len(k) for k in _packed(x)] == [3, 5, 9, 17, 3]


def test_rounding_saturates():
    sizes, [(rows, x)] = rounded(pa.array([[1e308, -1e308, -0.001], None, [0.5, -0.0, 1.0]]))
    assert sizes.tolist() == [3, 0, 3] and rows.tolist() == [0, 2]
    assert x.tolist() == [[(1 << 63) - 1, -(1 << 63), -1], [128, 0, 256]]


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [])]])
def test_nothing_to_fit(spark, rows):
    found = whiten(vectors(spark, rows))
    assert found.columns == COLUMNS and found.collect() == []


def test_components_without_variance(spark):
    one = whiten(vectors(spark, [(1, [0.5, 0.25]), (2, [0.5, 0.25])])).collect()
    assert [(r.vec_id, r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in sorted(one)] == [
        (i, c, 1, 0, None, None, None) for i in (1, 2) for c in (1, 2)
    ]
    line = whiten(vectors(spark, [(k, [k / 4, k / 2, 1.0]) for k in range(5)])).collect()
    assert len(line) == 15 and all((r.whitened is None) == (r.component > 1) for r in line)
    assert all(r.explained == pytest.approx(1 if r.component == 1 else 0) and r.identity_error < 1e-9 for r in line)


def test_wide_numbers(spark):
    big = [(1, [1e18, 0.0]), (2, [-1e18, 1.0]), (3, [3e15, 5.0])]
    found = {(r.vec_id, r.component): r for r in whiten(vectors(spark, big)).collect()}
    xs, n, sums, _ = brute(big[2:] + [(4, [1.0, 1.0]), (5, [2.0, 1.0])])
    assert found[1, 1].deviation is None and len(found) == 6
    small = {r.vec_id: r.deviation for r in whiten(vectors(spark, [(3, [1e6, 5.0]), (4, [1.0, 1.0]), (5, [2.0, 1.0])])).collect()}
    xs, n, sums, _ = brute([(3, [1e6, 5.0]), (4, [1.0, 1.0]), (5, [2.0, 1.0])])
    assert small == {i: sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True)) for i, x in xs}


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    found = op11_embedding_whitening(spark, sf)
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    xs, n, sums, cov = brute(rows)
    got = found.collect()
    assert found.columns == COLUMNS and len(got) == 4 * len(xs)
    assert {(r.vec_id, r.n, r.deviation) for r in got} == {(i, n, sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True))) for i, x in xs}
    values, ways = np.linalg.eigh(cov)
    white = {(r.vec_id, r.component): r.whitened for r in got}
    for c in range(4):
        want = (np.array([x for _, x in xs]) - np.array(sums) / n) @ ways[:, -1 - c] / np.sqrt(values[-1 - c])
        have = np.array([white[i, c + 1] for i, _ in xs])
        assert np.allclose(have, want * np.sign(have @ want), atol=1e-8)
    assert max(r.identity_error for r in got) < 1e-9
    assert whitening.ORACLE == {}
