"""Benchmark decontamination against plain dynamic programming."""

import random

from sievekit.llm.decontaminate import Pattern, budget, matches, normalise, op6_benchmark_decontamination, pieces


def least_distance(item, text):
    """Least edit distance of item to a substring of text."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        now = [i]
        for j, d in enumerate(text, 1):
            now.append(min(row[j] + 1, now[-1] + 1, row[j - 1] + (c != d)))
        row = now
    return min(row), row.index(min(row))


def test_bit_parallel_distance():
    rng = random.Random(1)
    for _ in range(400):
        item = "".join(rng.choice("ab ") for _ in range(rng.randint(1, 12)))
        text = "".join(rng.choice("ab ") for _ in range(rng.randint(0, 25)))
        assert Pattern.of(1, item).search(text) == least_distance(item, text)


def test_pieces_make_up_the_item():
    for n in (1, 5, 12, 13, 100):
        item = "".join(chr(97 + k % 26) for k in range(n))
        cut = pieces(item, budget(n))
        assert "".join(p for _, p in cut) == item and len(cut) == budget(n) + 1 and all(item[a : a + len(p)] == p for a, p in cut)


def edited(rng, text, n):
    out = list(text)
    for _ in range(n):
        k = rng.randrange(len(out))
        rng.choice([lambda: out.__setitem__(k, "#"), lambda: out.__delitem__(k), lambda: out.insert(k, "@")])()
    return "".join(out)


def corpus():
    rng = random.Random(2)
    words = ["alpha", "beta", "gamma", "delta", "of", "the", "in", "omega", "sigma", "theta", "kappa"]
    items = [(k, " ".join(rng.choice(words) for _ in range(rng.randint(8, 20)))) for k in range(6)]
    items += [(10, None), (11, ""), (12, "tiny one"), (0, items[0][1])]
    docs = [(k, " ".join(rng.choice(words) for _ in range(30))) for k in range(10)]
    for k in range(40):
        item = items[k % 6][1]
        noise = [" ".join(rng.choice(words) for _ in range(12)) for _ in range(2)]
        docs.append((100 + k, f"{noise[0]}\n {edited(rng, item, k // 6).upper()}  {noise[1]}"))
    return docs + [(900, None), (901, ""), (902, "a Tiny  ONE b"), (100, docs[10][1])], items


def test_equals_brute_force(spark):
    docs, items = corpus()
    found = matches(
        spark.createDataFrame([(*d, "clash") for d in docs], "doc_id bigint, text string, distance string").repartition(3),
        spark.createDataFrame(items, "item_id bigint, text string"), slice_chars=200,
    )
    got = sorted((r.doc_id, r.item_id, r.distance) for r in found.collect())
    want = []
    for d, text in docs:
        for i, item in items:
            if text and item and (n := normalise(item)):
                distance, _ = least_distance(n, normalise(text))
                if distance <= budget(len(n)):
                    want.append((d, i, distance))
    assert got == sorted(want)


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert op6_benchmark_decontamination(spark, str(tmp_path)).count() == 0


def test_item_ids_of_any_type(spark):
    text = "the quick brown fox jumps over the lazy dog by the river bank at dawn"
    docs = spark.createDataFrame([("d1", f"before {text} after"), ("d2", "nothing here")], "doc_id string, text string")
    items = spark.createDataFrame([("item-a", text), (None, None)], "item_id string, text string")
    assert [(r.doc_id, r.item_id, r.distance) for r in matches(docs, items).collect()] == [("d1", "item-a", 0)]
