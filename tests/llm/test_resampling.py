"""Importance resampling against the plain definition."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest

from sievekit.llm import resampling
from sievekit.llm.resampling import dictionaries, draw, op13_importance_resampling, weigh, zero_bytes

_FEATURES = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text):
    words = _FEATURES.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return words, [" ".join(words[k : k + n]) for n in (1, 2, 3) for k in range(len(words) - n + 1)]


def brute(docs, target):
    """Rows (doc_id, n_features, weight, score, rank) of all documents, those drawn in order first."""
    bucket = lambda f: zlib.crc32(f.encode()) % 10_000
    s, t = (Counter(bucket(f) for x in texts for f in features(x)[1]) for texts in ([x for _, x in docs], target))
    every, wanted = s.total(), t.total()
    gain = [math.floor(1000 * math.log((t[b] + 1) * (every + 10_000) / ((s[b] + 1) * (wanted + 10_000)))) for b in range(10_000)]
    rows = []
    for i, x in docs:
        words, found = features(x)
        weight = sum(gain[bucket(f)] for f in found)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((len(words), i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    fit = sorted((r for r in rows if r[0] >= 20), key=lambda r: (-r[4], r[1] is None, r[1] or 0))
    most = len(fit) * 5 // 100
    return [(*r[1:], k + 1) for k, r in enumerate(fit[:most])] + [(*r[1:], None) for r in fit[most:] + [r for r in rows if r[0] < 20]]


def order(rows):
    return sorted(rows, key=repr)


def check(spark, docs, target):
    made = spark.createDataFrame(docs, "doc_id bigint, text string").selectExpr("*", "1 AS n_features", "0 AS weight", "'x' AS feature", "2 AS n", "3 AS bucket")
    items = spark.createDataFrame([(0, t) for t in target], "bucket int, text string")
    found = draw(weigh(made.repartition(5), items)).select("doc_id", "n_features", "weight", "score", "rank").collect()
    assert order(map(tuple, found)) == order(brute(docs, target))


def test_against_brute_force(spark):
    words = ["The", "cat", "sat", "é", "ß9", "x-y", "ÀB", "你好", "10", "%%"]
    docs = [(k, " ".join(words[(k * j + j // 3) % len(words)] for j in range(k % 60))) for k in range(300)]
    docs += [(7, docs[50][1])] * 3 + [(None, docs[59][1]), (None, None), (400, ""), (401, " \t.\n"), (402, "a" * 70_000 + " b"), (403, "the cat " * 60_000)]
    check(spark, docs, ["the cat sat", None, "", "10 ß9, x-y", "你好 你好"])


@pytest.mark.parametrize("docs, target", [([], []), ([], ["a b"]), ([(1, "a b c " * 20), (2, None)], [])])
def test_empty_tables(spark, docs, target):
    check(spark, docs, target)


def test_ties_go_to_the_smaller_id(spark):
    rows = [(k, 30, 5, 10, k) for k in range(60)]
    made = spark.createDataFrame(rows, "doc_id bigint, n_words bigint, n_features bigint, weight bigint, __row bigint")
    from sievekit.llm.common import materialize

    got = draw(materialize(made, "ties")).where("rank IS NOT NULL").orderBy("rank").collect()
    want = sorted(brute([(k, None) for k in range(60)], []), key=lambda r: (-r[3], r[0]))
    assert [r.doc_id for r in got] == [r[0] for r in want[:3]] and [r["rank"] for r in got] == [1, 2, 3]


def test_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    docs, target = ([tuple(r)[:2] for r in spark.read.parquet(f"{sf}/{t}.parquet").select(k, "text").collect()] for t, k in (("documents", "doc_id"), ("benchmark", "item_id")))
    found = op13_importance_resampling(spark, sf)
    assert found.columns == ["doc_id", "n_features", "weight", "score", "rank", "n_words"]
    assert order(tuple(r)[:5] for r in found.collect()) == order(brute(docs, [t for _, t in target]))


def test_dictionaries_hold_each_string_once(monkeypatch):
    monkeypatch.setattr(resampling, "STRETCH", 7)
    texts = ["a b a b a b c", "", "The b\x0ba", "é é é " * 9, "x" * 300 + " a"]
    want, got = Counter(zlib.crc32(f.encode()) for t in texts for f in features(t)[1]), Counter()
    for crc, counts, place, of in dictionaries([t.encode() for t in texts]):
        assert (counts[place] > 0).all() and counts.sum() == len(place) == len(of)
        got.update({int(c): int(n) for c, n in zip(crc, counts, strict=True) if n})
    assert got == want


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 1000, 70_001])
def test_crc_of_parts(n):
    tail = bytes(k % 251 for k in range(n))
    table, crc = zero_bytes(n), zlib.crc32(b"head")
    moved = int(table[0][crc & 255] ^ table[1][crc >> 8 & 255] ^ table[2][crc >> 16 & 255] ^ table[3][crc >> 24])
    assert moved ^ zlib.crc32(tail) == zlib.crc32(b"head" + tail)
