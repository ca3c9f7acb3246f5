"""Quality rules: counts against brute force, and lists learned from drawn labels."""

import random
import re

import numpy as np

from sievekit.llm.quality import COUNTS, count, fit, judge, learn, op7_quality_rules, training_rows

TEXTS = [
    None, "", " \n \n", "a b c a b c", "x y z x y", "one\none\n \none\ntwo\n", "a#b $5 |%|", "é ü\x0b\x0cß x", "w " * 49, "w " * 60,
    "a b a b a b a b", "line\n" * 500, "p q r\np q r", "the " * 20_000,
]


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = {}
    for k in range(len(words) - 2):
        windows.setdefault(tuple(words[k : k + 3]), []).append(k)
    marked = {k + j for at in windows.values() if len(at) > 1 for k in at for j in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(marked)


def test_counts(spark):
    docs = spark.createDataFrame([(k, t, 0) for k, t in enumerate(TEXTS)], "doc_id bigint, text string, n_words int")
    got = {r.doc_id: tuple(r[c] for c in COUNTS[:5]) for r in count(docs).collect()}
    assert got == {k: brute(t) for k, t in enumerate(TEXTS)}


def test_base_verdict(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string")
    for r in judge(docs, []).collect():
        n, _, _, _, again = brute(TEXTS[r.doc_id])
        assert r.base_failed == (n < 50 or 100 * again > 50 * n) and r.kept == (not r.base_failed)


def test_learns_thresholds():
    rng = np.random.default_rng(0)
    x = {"a": rng.random(3000), "b": rng.random(3000), "c": rng.random(3000)}
    y = (x["a"] > 0.7) & (x["b"] <= 0.5) | (x["c"] > 0.95)
    rules = learn(x, y, np.arange(3000) % 3 == 0)
    got = np.zeros(3000, dtype=bool)
    for rule in rules:
        hit = np.ones(3000, dtype=bool)
        for c in rule:
            hit &= c.holds(x)
        got |= hit
    assert (got == y).mean() > 0.97


def test_rejects_what_labels_call_bad(spark, tmp_path):
    rng = random.Random(4)
    words = [f"w{k}" for k in range(3000)]
    docs, labels = [], []
    for k in range(400):
        bad = k % 3 == 0
        text = " ".join(rng.choice(words) + ("#" if bad else "") for _ in range(80))
        docs.append((k, text))
        labels += [(k, None if k % 50 == 1 else int(not bad))]
    docs += [(None, "x " * 70), (5, docs[5][1])]
    spark.createDataFrame(docs, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([*labels, (None, 0), (5, 1)], "doc_id bigint, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    got = op7_quality_rules(spark, str(tmp_path)).collect()
    assert len(got) == 402 and all(r.kept == (r.doc_id % 3 > 0) for r in got if r.doc_id is not None)


def test_empty_tables_and_single_class(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id bigint, text string")
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    assert fit(docs, none) == [] and fit(docs, spark.createDataFrame([(1, 1)], none.schema)) == []
    assert judge(docs.limit(0), []).count() == 0


def test_repeated_ids_train_on_one_text(spark):
    """The same row whatever the order of the input."""
    rows = [(1, "b b"), (1, "a"), (1, None), (2, "c")]
    labels = spark.createDataFrame([(1, 0), (2, 1)], "doc_id bigint, quality int")
    for n in (1, 3):
        docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(n)
        got = sorted((r.doc_id, r.word_chars) for r in training_rows(docs, labels, "quality").collect())
        assert got == [(1, 1), (2, 1)]
