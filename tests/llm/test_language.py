"""Language ID: the Viterbi path against brute force, and held-out texts of made-up languages."""

import itertools
import random

import numpy as np

from sievekit.llm.language import UNKNOWN, fit, identify, op2_language_id, viterbi


def test_viterbi_equals_brute_force():
    rng = np.random.default_rng(0)
    for _ in range(60):
        labels = int(rng.integers(1, 4))
        first = np.concatenate([[0], np.cumsum(rng.integers(0, 7, size=3))])
        e = rng.normal(size=(first[-1], labels)).astype(np.float32) * 3
        penalty = float(rng.uniform(0.5, 4))
        path = viterbi(e, first, penalty, segment=int(rng.integers(1, 5)))

        def worth(p, rows, penalty=penalty):
            return sum(r[k] for r, k in zip(rows, p, strict=True)) - penalty * sum(a != b for a, b in itertools.pairwise(p))

        for a, b in itertools.pairwise(first):
            best = max(worth(p, e[a:b]) for p in itertools.product(range(labels), repeat=b - a))
            assert abs(worth(path[a:b], e[a:b]) - best) < 1e-4


def texts(n, seed):
    rng = random.Random(seed)
    parts = {"aa": ["ka", "to", "mi", "ré"], "bb": ["sch", "un", "ver", "ei"], "cc": ["пре", "ста", "ко", "ли"]}
    for k in range(n):
        lang = rng.choice(sorted(parts))
        yield k, " ".join("".join(rng.choices(parts[lang], k=rng.randint(1, 3))) for _ in range(rng.randint(5, 40))), lang


def test_held_out_and_odd_texts(spark):
    docs = spark.createDataFrame(list(texts(300, 1)), "doc_id bigint, text string, lang string")
    model = fit(docs)
    assert model.languages == ("aa", "bb", "cc")
    rows = [(k, t, lang, 0.5) for k, t, lang in texts(80, 2)]
    odd = [(900, None), (901, ""), (902, "12 34 !?"), (903, "ᏣᎳᎩ"), (904, "кота " * 30_000)]
    rows += [(k, t, None, 0.0) for k, t in odd] + [rows[0]]
    got = {}
    for r in identify(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, score double"), model).collect():
        got[r.doc_id] = r
    want = {k: lang for k, _, lang, _ in rows if k < 900}
    assert sum(got[k].lang_pred != lang for k, lang in want.items()) <= 1
    assert [got[k].lang_pred for k in (900, 901, 902)] == [UNKNOWN] * 3 and got[900].score == 0
    assert got[903].lang_pred in model.languages and got[904].lang_pred == "cc"


def test_spans_of_mixed_text(spark):
    model = fit(spark.createDataFrame(list(texts(300, 1)), "doc_id bigint, text string, lang string"))
    mixed = " ".join(["schver unei verun"] * 10 + ["katomi réto mika"] * 20)
    row = identify(spark.createDataFrame([(1, mixed)], "doc_id bigint, text string"), model).first()
    assert row.lang_pred == "aa" and row.n_spans == 2 and 0.5 < row.score < 0.8


def test_letters_of_all_scripts(spark):
    parts = {
        "te": ["తెలుగు", "భాష", "మంచి"], "kn": ["ಕನ್ನಡ", "ಭಾಷೆ", "ಒಳ್ಳೆಯ"], "gu": ["ગુજરાતી", "ભાષા"], "lo": ["ພາສາ", "ລາວ"],
        "my": ["မြန်မာ", "ဘာသာ"], "am": ["አማርኛ", "ቋንቋ"], "km": ["ភាសា", "ខ្មែរ"], "aa": ["katomi", "réto"],
    }
    rng = random.Random(5)
    rows = [(k, " ".join(rng.choices(parts[lang], k=12)), lang) for k, lang in enumerate(sorted(parts) * 12)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = fit(docs)
    assert model.languages == tuple(sorted(parts))
    got = {r.doc_id: r for r in identify(docs, model).collect()}
    assert all(got[k].lang_pred == lang and got[k].score > 0.9 for k, _, lang in rows)


def test_more_languages_than_labels_of_a_byte(spark):
    rows = []
    for k in range(300):
        word = "".join(chr(0x4E00 + 60 * k + j) for j in range(5))
        rows.append((k, f"{word} {word} {word}", f"l{k:03}"))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = fit(docs)
    assert len(model.languages) == 300
    got = {r.doc_id: r.lang_pred for r in identify(docs, model).collect()}
    assert got == {k: lang for k, _, lang in rows}


def test_undivided_path_equals_segments():
    rng = np.random.default_rng(2)
    first = np.concatenate([[0], np.cumsum(rng.integers(0, 40, size=20))])
    e = rng.normal(size=(first[-1], 5)).astype(np.float32) * 3
    assert (viterbi(e, first, 4.0, segment=1000) == viterbi(e, first, 4.0, segment=7)).all()


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id bigint, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    assert op2_language_id(spark, str(tmp_path)).count() == 0


def test_signs_in_a_scripts_range_are_no_letters(spark):
    rows = [(k, "the cat sat on the mat " * 3, "en") for k in range(8)] + [(100, "϶϶϶ ϶", None), (101, "×÷ ×", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in identify(docs, fit(docs)).where("doc_id >= 100").collect()}
    assert got == {100: ("und", 0.0), 101: ("und", 0.0)}


def test_repeated_ids_train_once(spark):
    """Rows that share an id count as one, so the bound on ids bounds rows."""
    rows = [(1, "aa bb cc", "x")] * 50 + [(1, "zz", "y"), (2, "dd ee", "y")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    once = spark.createDataFrame([(1, "aa bb cc", "x"), (2, "dd ee", "y")], "doc_id bigint, text string, lang string")
    one, two = fit(docs), fit(once)
    assert one.languages == two.languages == ("x", "y") and np.array_equal(one.table, two.table)
