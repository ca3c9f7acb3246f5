"""Mixing: targets by plain water-filling, sums by exhaustive search, whole tables by their sums."""

import itertools
import re
from collections import defaultdict

import numpy as np
import pytest

from sievekit.llm import mixing
from sievekit.llm.mixing import DP_WORDS, fit, knapsack, mix, op12_source_mixing, repeated, targets


def brute_targets(sizes, weights=(3, 1, 2), share=1.5, most=2):
    """sizes: (source, size) pairs; the rounds of the contract, one after the other."""
    order = sorted(sizes, key=lambda x: (x[0] is None, (x[0] or "").encode()))
    weight = {s: weights[k % len(weights)] for k, (s, _) in enumerate(order)}
    size = dict(order)
    out, left, free = {}, share * sum(size.values()), set(size)
    while free:
        total = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / total > most * size[s]}
        if not over:
            return out | {s: left * weight[s] / total for s in free}
        for s in over:
            out[s] = most * size[s]
            left -= out[s]
        free -= over
    return out


@pytest.mark.parametrize(
    "sizes",
    [[("a", 10), ("b", 1000), ("c", 10), ("d", 10), (None, 500)], [("a", 5)], [("b", 0), ("a", 0)], [("z", 7), ("é", 3), ("Z", 100), (None, 0), ("", 9)], []],
)
def test_targets(spark, sizes):
    rows = spark.createDataFrame(sizes, "source string, source_size bigint")
    got = {r.source: r.target for r in targets(rows).collect()}
    assert got == pytest.approx(brute_targets(sizes))


def test_many_sources_in_ranges(spark):
    rng = np.random.default_rng(2)
    sizes = [(f"s{k}", int(v)) for k, v in enumerate(rng.pareto(0.7, 500) * 100)]
    rows = spark.createDataFrame(sizes, "source string, source_size bigint").repartition(9)
    got = {r.source: r.target for r in targets(rows).collect()}
    assert got == pytest.approx(brute_targets(sizes))
    assert sum(got.values()) == pytest.approx(1.5 * sum(v for _, v in sizes))


def test_knapsack_is_the_nearest_sum():
    rng = np.random.default_rng(3)
    for _ in range(300):
        kinds = rng.integers(1, 5)
        sizes, counts = rng.choice(np.arange(1, 30), kinds, replace=False), rng.integers(0, 4, kinds)
        budget = int(rng.integers(0, 80))
        take = knapsack(sizes, counts, budget)
        assert (take >= 0).all() and (take <= counts).all()
        best = min(abs(sum(n * s for n, s in zip(c, sizes, strict=True)) - budget) for c in itertools.product(*(range(n + 1) for n in counts)))
        assert abs(int((take * sizes).sum()) - budget) == best


@pytest.mark.parametrize("budget", [0, 1, 40_000, 1_000_003, 12_345_678, 10**9])
def test_fit_takes_shares_and_hits_the_budget(budget):
    rng = np.random.default_rng(4)
    sizes, counts = np.arange(3, 900), rng.integers(1, 60, 897)
    total = int((sizes * counts).sum())
    take = fit(sizes, counts, budget)
    assert (take >= 0).all() and (take <= counts).all()
    assert int((take * sizes).sum()) == (total if budget >= total else 0 if budget < 3 else budget)
    if DP_WORDS * 20 < budget < total:
        share = (take / counts)[counts > 20]
        assert np.abs(share - budget / total).max() < 0.25


def test_long_documents_only():
    sizes, counts = np.array([200_000, 300_000]), np.array([2, 2])
    assert fit(sizes, counts, 290_000).tolist() == [0, 1]
    assert fit(sizes, counts, 90_000).tolist() == [0, 0]
    assert fit(sizes, counts, 520_000).tolist() in ([1, 1], [0, 2])


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string").selectExpr("*", "1 AS size", "'k' AS key", "0 AS copies", "7L AS first")


def check(rows, found):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    own, taken = defaultdict(int), defaultdict(int)
    for _, t, s in rows:
        own[s] += size(t)
    want = brute_targets(list(own.items()))
    assert sorted((r.doc_id is None, r.doc_id or 0, r.source or "", r.size) for r in found) == sorted((i is None, i or 0, s or "", size(t)) for i, t, s in rows)
    for r in found:
        assert r.source_size == own[r.source] and r.target == pytest.approx(want[r.source])
        assert 0 <= r.taken <= 2 * r.size and r.taken == r.copies * r.size
        taken[r.source] += r.taken
    return {s: taken[s] - want[s] for s in own}


@pytest.mark.parametrize("most", [0, 200_000])
def test_edge_cases(spark, monkeypatch, most):
    monkeypatch.setattr(mixing, "MAX_BROADCAST", most)
    rows = [(k, "w " * (k % 7), f"s{k % 3}") for k in range(300)]
    rows += [(5, "copy of some text", "hot")] * 400  # repeated rows in a source of one size
    rows += [(None, "a b", None), (None, None, None), (900, "", "none"), (901, " \n", "none"), (902, "x y\x0bz", None), (903, "long " * 50_000, "big")]
    found = mix(docs(spark, rows).repartition(5)).collect()
    apart = check(rows, found)
    assert all(abs(v) <= 2 for s, v in apart.items() if s not in ("big", None))
    copies = sorted(r.copies for r in found if r.source == "hot")
    assert copies[-1] - copies[0] <= 1


def test_reruns_agree(spark):
    rows = [(k, "w " * (k % 50), f"s{k % 4}") for k in range(500)]
    got = [sorted(map(tuple, mix(docs(spark, rows).repartition(n)).collect())) for n in (1, 6)]
    assert got[0] == got[1]
    again = repeated(mix(docs(spark, rows))).groupBy("doc_id").count()
    assert {r.doc_id: r["count"] for r in again.collect()} == {r[0]: r[5] for r in got[0] if r[5]}


def test_empty_table(spark):
    found = mix(docs(spark, []))
    assert found.columns == ["doc_id", "source", "size", "source_size", "target", "copies", "taken"] and found.collect() == []


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    apart = check(rows, op12_source_mixing(spark, sf).collect())
    assert all(abs(v) <= 3 for v in apart.values())  # 50 documents a source leave such gaps between sums
