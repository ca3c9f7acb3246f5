"""LM scoring: word scores against brute force, and the byte model as a distribution."""

import math
import pickle
import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np

from sievekit.llm import common, lm
from sievekit.llm.common import mix, powers, span_hash, word_hash


def corpus():
    rng = random.Random(6)
    words = ["the", "of", "Cat", "dog", "runs", "fast", "über", "x" * 40]
    rows = [(k, " ".join(rng.choice(words) for _ in range(rng.randint(1, 60)))) for k in range(300)]
    return [*rows, (900, None), (901, ""), (902, " \n"), (903, "dog " * 30_000), (5, rows[5][1])]


def words(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower()) + ["end"]


def brute(rows):
    count = Counter()
    for k, text in rows:
        if zlib.crc32(str(k).encode()) % 5 != 1:
            count.update(words(text))
    n, v = sum(count.values()), len(count)
    whole = n + 0.5 * (v + 1)
    return {
        k: (len(words(t)), sum(count[w] > 0 for w in words(t)), n, sum(math.log10((count[w] + 0.5) / whole) for w in words(t)))
        for k, t in rows
    }


def test_base_scores_by_broadcast_and_by_join(spark):
    rows = corpus()
    docs = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id bigint, text string, score double").repartition(3)
    docs = docs.select("*", lm.held_out().alias("held_out"))
    train = docs.where("NOT held_out")
    model, want = lm.fit(train), brute(rows)
    for most in (lm.MAX_BROADCAST, 0):
        got = lm.score(docs, model, train, max_broadcast=most).collect()
        assert len(got) == len(rows)
        for r in got:
            n, known, total, base = want[r.doc_id]
            assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total)
            assert math.isclose(r.base_score, base, rel_tol=1e-9) and r.score < 0
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 1)


def small_model():
    texts = ["the cat runs of the dog " * 8] * 6
    odds = np.zeros(lm.N_SLOTS, dtype=np.float16)
    seen = np.zeros(lm.N_SLOTS, dtype=np.uint8)
    code = np.concatenate([lm._codes([t.encode()])[0] for t in texts])
    table = np.zeros((lm.N_SLOTS, 2))
    contexts = lm._slots(code)
    for _, node, bit in lm._decisions(code):
        for o in lm.ORDERS:
            np.add.at(table, (lm._place(contexts[o], o, node), bit), 1)
    odds[:] = np.log((table[:, 1] + lm.ADDED) / (table[:, 0] + lm.ADDED))
    seen[:] = np.minimum(np.log2(1 + table.sum(axis=1)) * 4, 255)
    return lm.tune(odds, seen, [t.encode() for t in texts[:2]])


def test_next_byte_is_a_distribution():
    model = small_model()
    before = lm._codes([b"the ca"])[0][-1]
    codes = np.array([int(before) >> 8 << 8 | b for b in range(256)], dtype=np.uint64)
    for costs in model.costs(codes):
        assert abs(np.exp2(-costs.astype(float)).sum() - 1) < 1e-3


def test_memory_of_runs_changes_nothing():
    model = small_model()
    texts = [b"the cat", b"", b"zz\xc3\xa9", b"the dog of the cat"]
    one = [model.bits([t])[0] for t in texts]
    assert np.allclose(model.bits(texts), one) and one[0] < one[2] + 60
    assert model.bits([b"the cat runs of the dog "])[0] < model.bits([b"qxj vwk zzpl qq jjx bnm "])[0]


def test_every_training_text_is_learned_from(spark):
    texts = {k: f"the cat {k} runs of the dog" for k in range(60)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    chosen = [r.doc_id for r in docs.where(f"pmod(xxhash64(doc_id), {lm.TUNE_SHARE}) = 0").collect()]
    assert 0 < len(chosen) < 60
    for k in chosen:
        texts[k] = f"qx{k}zv " * 4_000
    model = lm.fit(spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(3))
    for k, text in texts.items():
        code = lm._codes([text.encode()])[0]
        contexts = lm._slots(code)
        for _, node, _ in lm._decisions(code):
            assert all((model.seen[lm._place(contexts[o], o, node)] > 0).all() for o in lm.ORDERS), k
    # Texts that are long are the mixer's too.
    assert min(len(texts[k]) for k in chosen) > 20_000 and not np.allclose(model.weights, 0.35)


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert lm.op9_lm_scoring(spark, str(tmp_path)).count() == 0


def brute_segments(text):
    """Segments of a text, word by word, with how many codes each holds."""
    raw = text.encode()
    out, begin, before = [], 0, 0
    for found in re.finditer(rb"[^\x20\x09-\x0D]+", raw):
        h = word_hash(found[0].lower())
        key = np.array([(h + 3 * before) % 2**64], dtype=np.uint64)
        if int(lm.mix(key)[0]) % lm.CUT == 0 and found.end() < len(raw):
            out.append(raw[begin : found.end() + 1])
            begin = found.end() + 1
        before = h
    return [*out, raw[begin:] + b"\xff"]


def test_segments_by_brute_force(spark):
    rng = random.Random(7)
    words = [f"w{k}" for k in range(400)] + ["Über", "UPPER"]
    text = {k: " ".join(rng.choice(words) for _ in range(rng.randint(0, 200))) for k in range(120)}
    text |= {500 + k: text[k] for k in range(30)} | {700: "", 701: " ", 702: "dog " * 5_000, 703: text[3][:400] + text[5]}
    docs = spark.createDataFrame(list(text.items()), "doc_id bigint, text string").repartition(3)
    docs = docs.select("*", lm.held_out().alias("held_out"))
    train = docs.where("NOT held_out")
    model = lm.fit(train)
    got = {r.doc_id: r.score for r in lm.score(docs, model, train).collect()}
    aside = {r.doc_id for r in train.where(lm._aside()).collect()}
    cut = {k: brute_segments(t) for k, t in text.items()}
    held = {k for k in text if zlib.crc32(str(k).encode()) % 5 == 1}
    count = Counter(s for k in cut if k not in held for s in cut[k])
    early = {s for k in cut if k not in held and k not in aside for s in cut[k]}
    late = [s for k in aside for s in cut[k]]
    weight = (sum(s in early for s in late) + 0.5) / (len(late) + 1)
    for k, segments in cut.items():
        code = lm._codes([text[k].encode()])[0]
        costs, at, past, bits = model.costs(code).astype(float), 0, 0.0, 0.0
        for s in segments:
            at += len(s)
            total = costs[:, :at].sum(axis=1)
            now = total.min() - math.log2(np.exp2(total.min() - total).mean())
            own, n = (segments.count(s), len(segments)) if k not in held else (0, 0)
            p, cost = (count[s] - own) / max(1, count.total() - n), now - past
            likely = np.logaddexp2(math.log2(1 - weight) - cost, math.log2(weight * p)) if p > 0 else math.log2(1 - weight) - cost
            bits, past = bits - likely, now
        assert math.isclose(got[k], -bits * math.log10(2), rel_tol=1e-5), k
    # Copies of a training text cost far less than texts that occur once.
    rate = {k: got[k] / (len(t) + 1) for k, t in text.items() if len(t) > 500 and k < 700}
    twice = [rate[k] for k in rate if k >= 500 and k - 500 not in held]
    assert len(twice) > 5 and min(twice) > max(rate[k] for k in rate if 30 <= k < 120)


def test_segments_without_training(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, None)], "doc_id bigint, text string").withColumn("held_out", lm.F.lit(True))
    none = docs.where("NOT held_out")
    got = {r.doc_id: r.score for r in lm.score(docs, lm.fit(none), none).collect()}
    assert math.isclose(got[1], -6 * 8 * math.log10(2), rel_tol=1e-3)
    assert math.isclose(got[2], -8 * math.log10(2), rel_tol=1e-3)


def test_segments_that_are_not_frequent(spark, monkeypatch):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("held_out", lm.held_out())
    train = docs.where("NOT held_out")
    model = lm.fit(train)
    one = sorted((r.doc_id or -1, r.score) for r in lm.score(docs, model, train).collect())
    monkeypatch.setattr(lm, "FREQUENT", 1)
    two = sorted((r.doc_id or -1, r.score) for r in lm.score(docs, model, train).collect())
    assert np.allclose(one, two, rtol=1e-9)


def test_sums_in_groups_change_nothing(spark, monkeypatch):
    """Counts and weights from many tasks, whether summed in one group or in many."""
    rows = [(k, f"some words of text {k % 13} and {k % 7} more") for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(7)
    monkeypatch.setattr(lm, "TUNE_BYTES", 60)
    models = []
    for summed in (64, 1):
        monkeypatch.setattr(lm, "SUMMED", summed)
        models.append(lm.fit(docs))
    one, two = models
    assert np.array_equal(one.odds, two.odds) and np.array_equal(one.seen, two.seen)
    assert np.allclose(one.weights, two.weights, rtol=1e-6) and np.abs(one.weights).max() > 0


def test_score_equals_a_plain_loop(spark):
    """Decision by decision: the mixed predictors' cost of each bit, as costs() has it for whole arrays."""
    docs = spark.createDataFrame([(k, f"the cat {k % 5} sat on the mat {k % 3}") for k in range(120)], "doc_id bigint, text string")
    model = lm.fit(docs)
    code = lm._codes([b"the cat 3 sat", b"dog"])[0]
    got = model.costs(code)
    contexts = lm._slots(code)
    for place in range(len(code)):
        byte, want = int(code[place]) & 0xFF, np.zeros(len(lm.FACTORS))
        for k in range(8):
            node, bit = (1 << k) | byte >> (8 - k), byte >> (7 - k) & 1
            gate, logit, inputs = 0, 0.0, []
            for row, order in enumerate(lm.ORDERS):
                at = int(lm._place(contexts[order][place : place + 1], order, np.array([node], dtype=np.uint64))[0])
                inputs.append(float(model.odds[at]))
                gate = row + 1 if model.seen[at] >= 7 else gate
            for row, x in enumerate([*inputs, 0.3]):
                logit += float(model.weights[gate * 8 + k, row]) * x
            signed = min(max(logit, -lm.MAX_LOGIT), lm.MAX_LOGIT) * (1 - 2 * bit)
            want += [math.log1p(math.exp(signed * f)) for f in lm.FACTORS]
        scale = got[:, place] / want
        assert np.allclose(scale, scale[0], rtol=1e-4) and (np.isclose(scale[0], 1, rtol=1e-4) or np.isclose(scale[0], 1 / math.log(2), rtol=1e-4))


def test_costs_in_parts_and_by_a_plain_sum(monkeypatch):
    """The packed tables give the decisions' costs one by one, however many codes are worked on at once."""
    model = small_model()
    code = np.unique(lm._codes([b"the cat runs of the dog, zz"])[0])
    whole = model.costs(code)
    monkeypatch.setattr(lm, "AT_ONCE", 3)
    assert np.array_equal(model.costs(code), whole)
    contexts, want = lm._slots(code), np.zeros(len(code))
    for k, node, bit in lm._decisions(code):
        places = [lm._place(contexts[o], o, node) for o in lm.ORDERS]
        for i in range(len(code)):
            gate = max([row + 1 for row, at in enumerate(places) if model.seen[at[i]] >= 7], default=0)
            x = [*(float(model.odds[at[i]]) for at in places), 0.3]
            logit = np.clip(np.dot(model.weights[gate * 8 + k], x), -lm.MAX_LOGIT, lm.MAX_LOGIT)
            want[i] += math.log2(1 + math.exp(logit * (1 - 2 * bit[i])))
    assert np.allclose(whole[lm.FACTORS.index(1.0)], want, rtol=1e-5)


def traced(f):
    """What f returns, and the bytes that it took at most and left."""
    tracemalloc.start()
    out = f()
    left, most = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    return out, most, left


def test_span_hash_by_plain_powers():
    data = np.frombuffer(random.Random(3).randbytes(3 * 4096 + 5), dtype=np.uint8)
    start = np.array([0, 0, 1, 4095, 4096, 8191, 100, len(data) - 1, len(data)])
    end = np.array([0, 1, 4096, 4097, 8192, 12_289, len(data), len(data), len(data)])
    base, whole = common._BASE, 1 << 64
    want = [
        (sum(int(common._BYTES[c]) * pow(base, k, whole) for k, c in enumerate(data[a:b].tolist())) + (b - a) * base) % whole
        for a, b in zip(start.tolist(), end.tolist(), strict=True)
    ]
    assert span_hash(data, start, end).tolist() == mix(np.array(want, dtype=np.uint64)).tolist()
    up, down = powers(9000)
    assert len(up) >= 9000 and len(down) >= 9000
    for k in (0, 1, 4095, 4096, 8999):
        assert int(up[k]) == pow(base, k, whole) and int(up[k]) * int(down[k]) % whole == 1


def test_memory_of_a_slice():
    """Two workers share an executor with the heap: tables of a slice's length must not stay, nor arrays pile up."""
    size = 4 << 20
    data = np.zeros(size, dtype=np.uint8)
    _, most, left = traced(lambda: span_hash(data, np.array([0, 5]), np.array([5, size])))
    assert most < 10 * size and left < size // 8
    texts = [b"a" * 1023] * (size // 1024)
    (code, bounds), most, _ = traced(lambda: lm._codes(texts))
    assert len(code) == bounds[-1] == size and most < 12 * size


def test_codes_by_a_plain_loop(monkeypatch):
    texts = [b"", b"a", b"abcdefgh" * 3, b"", "über".encode()]
    want = []
    for t in texts:
        run = bytes([lm.END]) * lm.LONGEST + t + bytes([lm.END])
        want += [int.from_bytes(run[k : k + lm.LONGEST + 1], "big") for k in range(len(t) + 1)]
    for at_once in (1, 3, 1 << 15):
        monkeypatch.setattr(lm, "AT_ONCE", at_once)
        code, bounds = lm._codes(texts)
        assert code.tolist() == want and np.diff(bounds).tolist() == [len(t) + 1 for t in texts]
    assert len(lm._codes([])[0]) == 0


def test_shed_model_costs_the_same():
    model = small_model()
    sent = pickle.loads(pickle.dumps(model))
    want = model.bits([b"the cat", b"", b"dog of the runs"])
    assert sent.shed().odds is None and sent.seen is None
    assert sent.shed().bits([b"the cat", b"", b"dog of the runs"]).tolist() == want.tolist()
