"""N-gram Jaccard join against brute force."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from sievekit.llm import jaccard
from sievekit.llm.jaccard import components, link, op3_ngram_jaccard_join


def brute(docs, size=4, percent=85):
    """id -> (set size, least id reachable)."""
    sets = {}
    for i, text in docs:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
        sets[i] = frozenset(tuple(w[k : k + size]) for k in range(len(w) - size + 1)) or frozenset([tuple(w)] if w else [])
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    having = defaultdict(list)
    for i in sorted(sets):
        shared = Counter(j for s in sets[i] for j in having[s])
        for j, k in shared.items():
            if 100 * k >= percent * (len(sets[i]) + len(sets[j]) - k):
                a, b = sorted((find(i), find(j)))
                root[b] = a
        for s in sets[i]:
            having[s].append(i)
    return {i: (len(sets[i]), find(i)) for i in sets}


def corpus():
    rng = random.Random(5)
    words = [f"w{k}" for k in range(400)]
    passage = " ".join(rng.choice(words) for _ in range(60))
    rows = [(0, None), (1, ""), (2, " \n"), (3, "one"), (4, "ONE"), (5, "one two three"), (6, "one two three four"), (7, "x" * 5000)]
    key = 10
    for _ in range(12):
        base = [rng.choice(words) for _ in range(rng.randint(30, 160))]
        for _ in range(rng.choice([1, 1, 2, 6, 25])):
            own = list(base)
            for _ in range(rng.randint(0, 7)):
                own[rng.randrange(len(own))] = rng.choice(words)
            text = " ".join(own)
            rows.append((key, text if rng.random() < 0.7 else text + " " + passage))
            key += 1
    rows += [(key + k, rows[20][1]) for k in range(5)]
    return rows


@pytest.mark.parametrize("sizes", [(16, 256), (2, 3)])
def test_equals_brute_force(spark, sizes):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in link(docs, sizes=sizes).collect()}
    assert got == brute(rows)


def test_beyond_the_broadcast_bound(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "MAX_BROADCAST", 0)
    rows = corpus()
    got = link(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == brute(rows)


def test_odd_rows(spark):
    rows = [(7, "a b c d e", 1), (7, "a b c d e", 2), (None, "a b c d e", 3), (9, None, 4), (None, None, 5)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, sig int")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in link(docs).collect()), key=str)
    assert got == sorted([(7, 2, 7), (7, 2, 7), (None, 2, 7), (9, 0, 9), (None, 0, None)], key=str)


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert op3_ngram_jaccard_join(spark, str(tmp_path)).count() == 0


def test_links_equal_brute_force(spark):
    """Every linked pair of different sets is there; every pair that is not is under the threshold."""
    rows, rng = corpus(), random.Random(2)
    base = [f"w{rng.randrange(400)}" for _ in range(150)]
    for k in range(40):
        own = list(base)
        for _ in range(1 + k % 3):
            own[rng.randrange(150)] = f"v{k}"
        rows.append((1000 + k, " ".join(own)))
    pairs, membership = jaccard.links(spark.createDataFrame(rows, "doc_id bigint, text string"), sizes=(3, 8))
    sets, least = {}, {}
    for i, text in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
        sets[i] = frozenset(tuple(w[k : k + 4]) for k in range(len(w) - 3)) or frozenset([tuple(w)] if w else [])
    for i in sorted(sets):
        least.setdefault(sets[i] or i, i)
    ids = sorted(k for k in least.values() if sets[k])
    want = set()
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            both = len(sets[i] & sets[j])
            if 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                want.add((i, j))
    got = [(min(r.id1, r.id2), max(r.id1, r.id2)) for r in pairs.collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 100
    assert {r.doc_id: r.class_id for r in membership.collect()} == {i: least[sets[i] or i] for i in sets}


def test_ranges_of_very_large_sets():
    """Ranges of 65,535 and more don't wrap, so that the bound never refuses a similar pair."""
    rng = np.random.default_rng(1)
    one = np.unique(rng.integers(0, 1 << 62, 4_600_000, dtype=np.uint64))
    two = one[1000:]
    a, b = (np.frombuffer(jaccard._ranges(x), dtype="<u2").astype(np.int64) for x in (one, two))
    assert (a == 65535).all() and (b == 65535).all()
    small = one[:1000]
    assert np.frombuffer(jaccard._ranges(small), dtype="<u2").sum() == 1000


def test_components(spark):
    edges = [(k, k + 1) for k in range(20)] + [(30, 31), (31, 32), (40, 40)]
    rows = [(bytes([a]), bytes([b])) for a, b in edges]
    got = {r.sig[0]: r.comp[0] for r in components(spark.createDataFrame(rows, "a binary, b binary")).collect()}
    assert got == {**{k: 0 for k in range(21)}, 30: 30, 31: 30, 32: 30}


def test_sketch_sums_all_tasks(spark, monkeypatch):
    texts = [(k, " ".join(f"w{k * j % 11}" for j in range(9))) for k in range(90)]
    rows = spark.createDataFrame(texts, "_id bigint, _text string").repartition(7)
    counts = Counter(int(s) for text in texts for s in jaccard._slot(jaccard.text_sets([text[1].encode()], 4)[0]))
    for many in (64, 2, 1):
        monkeypatch.setattr(jaccard, "SUMMED", many)
        got = jaccard._rarity(jaccard._first_pass(rows, 4))
        assert len(counts) > 9 and max(counts.values()) > 4
        assert all(got[s] == int(jaccard.STEPS * np.log2(n)) for s, n in counts.items())
        assert np.count_nonzero(got) == sum(n > 1 for n in counts.values())


def test_long_texts_are_verified_in_turn(spark, monkeypatch):
    """Long texts that pack to little are unpacked by their true length."""
    assert list(jaccard.stretches(np.array([3, 3, 9, 1, 1, 1]), 6)) == [(0, 2), (2, 3), (3, 6)]
    assert list(jaccard.stretches(np.array([], dtype=np.int64), 6)) == []
    monkeypatch.setattr(jaccard, "VERIFIED_BYTES", 1)
    base = [f"w{k % 5000}" for k in range(20_000)]
    rows = [(k, " ".join(base[: 20_000 - 100 * k])) for k in range(6)] + [(9, "a b c d e")]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r.component_id for r in jaccard.link(frame).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 0, 4: 0, 5: 0, 9: 9}
