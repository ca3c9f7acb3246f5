"""Readers and sinks on small files, mutation rules and streaming forms."""

import json
import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from sievekit.operators import mutation as mu
from sievekit.operators import pairs
from sievekit.operators import similarity as si
from sievekit.sources import readers, sinks
from sievekit.streaming import progress

CODE = 'import os, hashlib\ndef f(cur, user, p):\n    if not user.is_authenticated:\n        raise ValueError("x")\n    k = os.environ["KEY"]\n    return hashlib.sha256(p).hexdigest()\n'


def test_benchmark_shapes(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"metadata": {}, "samples": [{"id": "1", "cwe": "CWE-1", "difficulty": "easy"}]}))
    (tmp_path / "b.json").write_text(json.dumps([{"id": "2", "cwe": "CWE-2", "difficulty": "hard"}, {"id": "3", "cwe": "CWE-1", "difficulty": "hard"}]))
    assert sorted(r.id for r in readers.benchmark(spark, str(tmp_path)).collect()) == ["1", "2", "3"]
    assert [r.id for r in readers.benchmark(spark, str(tmp_path), "hard", "CWE-1").collect()] == ["3"]


def test_results_shapes(spark, tmp_path):
    d = {"sample_id": "s", "cwe": "c", "metrics": {"mutation_score": 0.5}}
    for k, shape in enumerate([{"results": [{"detailed_results": [d, d]}]}, {"detailed_results": [d]}, {"details": [d]}, [d, d]]):
        (tmp_path / f"{k}.json").write_text(json.dumps(shape))
    assert readers.results(spark, str(tmp_path)).where("metrics.mutation_score = 0.5").count() == 6


def test_payloads_batches_and_variations(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps({"CWE-1": {"name": "n", "payloads": {"a": ["x", ""], "b": ["y"]}}}))
    assert sorted((r.cwe, r.category, r.payload) for r in readers.payloads(spark, f"{tmp_path}/p.json").collect()) == [("CWE-1", "a", "x"), ("CWE-1", "b", "y")]
    (tmp_path / "b.jsonl").write_text(json.dumps({"custom_id": "a__b__full", "response": {"body": {"choices": [{"message": {"content": "hi"}}]}}}) + "\n" + json.dumps({"custom_id": "c__id"}) + "\n")
    got = sorted((r.sample_id, r.variant, r.content) for r in readers.batch_output(spark, f"{tmp_path}/b.jsonl").collect())
    assert got == [("a__b", "full", "hi"), ("c", "id", None)]
    full = {"source_sample_id": "1", "secure_code": "a", "insecure_code": "b", "security_tests": "c"}
    (tmp_path / "v.json").write_text(json.dumps({"variations": [full, {**full, "secure_code": ""}]}))
    assert readers.variations(spark, f"{tmp_path}/v.json").count() == 1


def test_text_pairs_and_examples(spark, tmp_path):
    for name in ("x_task", "x_test", "y_task"):
        (tmp_path / f"{name}.py").write_text(name)
    assert [(r.stem, r.task, r.test) for r in readers.text_pairs(spark, str(tmp_path)).collect()] == [("x", "x_task", "x_test")]
    (tmp_path / "q.txt").write_text("BEGIN here\n// a\n# b\nEND\nno\nBEGIN\nc\nEND\n")
    assert [r.block for r in readers.example_blocks(spark, f"{tmp_path}/q.txt", "BEGIN", "END").orderBy("pos").collect()] == ["a\nb\n", "c\n"]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", "easy", "s", "m"), (2, "b", "hard", "s", "m")], "id int, cwe string, difficulty string, source string, model string")
    sinks.save_collection(rows, f"{tmp_path}/c")
    assert spark.read.parquet(f"{tmp_path}/c/samples").count() == 2 and spark.read.json(f"{tmp_path}/c/stats").count() == 5
    sinks.save_splits(rows, f"{tmp_path}/s")
    assert spark.read.parquet(f"{tmp_path}/s/difficulty=hard").count() == 1
    sinks.save_results(rows, f"{tmp_path}/r", "run1")
    sinks.save_csv(rows, f"{tmp_path}/v", ("label",))
    assert spark.read.csv(f"{tmp_path}/v", header=True).columns[-1] == "label"
    sinks.append_checkpoint(rows.where("id = 1"), f"{tmp_path}/k")
    assert [r.id for r in readers.resume(rows, spark.read.parquet(f"{tmp_path}/k")).collect()] == [2]
    sinks.save_requests(rows.withColumn("prompt", F.lit("p")), spark.createDataFrame([("x",), ("y",)], "variant string"), f"{tmp_path}/q", "m")
    assert spark.read.json(f"{tmp_path}/q").count() == 4
    for text in (sinks.markdown(rows, "T"), sinks.latex(rows), sinks.console(rows, "T")):
        assert "hard" in text


def test_mutation_rules(spark):
    found = mu.mutants(CODE, mu.default_rules())
    operators = {o for o, _, _ in found}
    assert {"WEAKCRYPTO", "HARDCODE", "RMAUTH"} <= operators and all(mu.compiles(t) and t != CODE for _, t, _ in found)
    assert len({t for _, t, _ in found}) == len(found) and len(mu.TARGETS) == 33
    assert mu.mutants("def broken(:", mu.default_rules()) == [] and len(mu.mutants(CODE, mu.default_rules(), 2)) <= 2
    df = spark.createDataFrame([("1", CODE, ["WEAKCRYPTO"]), ("2", None, None)], "id string, secure_code string, mutation_operators array<string>")
    rows = mu.generate(df).collect()
    assert [r.operator for r in rows] == ["WEAKCRYPTO"] * 2 and "md5" in rows[0].mutated_code and "sha1" in rows[1].mutated_code


def test_every_operator_has_rules():
    assert {r.operator for r in mu.default_rules()} == set(mu.TARGETS)


def test_similarity_keeps_argument_order(spark):
    df = spark.createDataFrame([("tide", "diet")], "a string, b string")
    assert df.select(si.ratio("a", "b").alias("x"), si.ratio("b", "a").alias("y")).first() == (0.25, 0.5)
    rows = [(k, "c", "s", "abcdefghij" * 10 + "x" * k, k) for k in range(3)] + [(9, "c", "s", "zzz", 9)]
    near = pairs.near_duplicates(spark.createDataFrame(rows, "id int, cwe string, source string, code string, ord int"))
    assert sorted((r.id1, r.id2) for r in near.collect()) == [(0, 1), (0, 2), (1, 2)]
    assert sorted(r.id for r in pairs.greedy_dedup(spark.createDataFrame(rows, "id int, cwe string, source string, code string, ord int")).collect()) == [0, 9]


def test_similar_pairs_and_greedy_against_brute_force(spark):
    """All pairs over the threshold; and rows that no kept one before them is like."""
    rng = random.Random(4)
    texts = []
    for _ in range(12):
        base = "".join(rng.choice("abcdef ") for _ in range(rng.randint(0, 120)))
        for _ in range(rng.randint(1, 6)):
            own = list(base)
            for _ in range(rng.randint(0, 9)):
                own.insert(rng.randint(0, len(own)), rng.choice("xyz"))
            texts.append("".join(own))
    texts += [texts[3], texts[3], "", "", "a"]
    rows = [(k, rng.choice("pq"), t, k) for k, t in enumerate(texts)] + [(900, "p", None, 900)]
    df = spark.createDataFrame(rows, "id int, cwe string, code string, ord int")
    first = {}
    for k, t in enumerate(texts):
        first.setdefault(t, k)
    ids = sorted(first.values())
    ratios = {(i, j): SequenceMatcher(None, texts[i], texts[j]).ratio() for i in ids for j in ids if i < j}
    want = {p for p, r in ratios.items() if r > 0.9} | {(first[t], k) for k, t in enumerate(texts) if first[t] != k}
    got = {(r.id1, r.id2): r.ratio for r in pairs.near_duplicates(df).collect()}
    assert set(got) == want and len(want) > 15 and all(got[p] == ratios.get(p, 1.0) for p in got)
    kept = []
    for _, cwe, t, k in rows:
        old = [o for o, c in kept if c == cwe]
        if t is None or not any(SequenceMatcher(None, t, texts[o]).ratio() > 0.95 for o in old if o < 900):
            kept.append((k, cwe))
    assert sorted(r.ord for r in pairs.greedy_dedup(df).collect()) == sorted(k for k, _ in kept)


def test_sources_from_outside(spark, tmp_path):
    rows = [
        {"prompt_id": 1, "cwe_identifier": "CWE-89", "language": "python", "origin_code": "    def f(a):\n        return a\n", "test_case_prompt": "p", "file_path": "x.py"},
        {"prompt_id": 2, "cwe_identifier": "CWE-78", "language": "python", "origin_code": "import os\nreturn os", "test_case_prompt": "q"},
        {"prompt_id": 3, "cwe_identifier": "CWE-78", "language": "python", "origin_code": "if settings.DEBUG: run()"},
        {"prompt_id": 4, "cwe_identifier": "CWE-1", "language": "c", "origin_code": "import x"}, {"prompt_id": 5, "cwe_identifier": "CWE-1", "language": "Python", "origin_code": "import ("},
    ]
    (tmp_path / "i.json").write_text(json.dumps(rows))
    got = {r.original_id: r for r in readers.instruct_samples(spark, f"{tmp_path}/i.json").collect()}
    assert sorted(got) == ["1", "2"] and got["1"].code == "def f(a):\n    return a\n" and got["2"].code.startswith("def snippet():")
    assert all(tuple(r.asDict()) == readers.EXTERNAL for r in got.values())
    parts = "{'code_before': 'import a', 'vulnerable_code': 'bad()', 'patched_code': 'good()', 'code_after': ''}"
    table = [("1", "89", "t", parts, "[]"), ("2", "89", "t", parts, "['numpy']"), ("3", "5", "t", parts, "[]"), ("4", "89", "t", "not a literal", None)]
    spark.createDataFrame(table, "id string, CWE_ID string, task_description string, ground_truth string, install_requires string").write.parquet(f"{tmp_path}/p")
    found = readers.fragment_samples(spark, f"{tmp_path}/p", ["CWE-89"]).collect()
    assert [(r.id, r.insecure_code, r.secure_code) for r in found if r.insecure_code] == [("1", "import a\nbad()", "import a\ngood()")]
    (tmp_path / "t.json").write_text(json.dumps({"CWE-1": [{"prompt": "x"}, {"prompt": "y", "entry_point": "f"}]}))
    assert sorted((r.id, r.prompt) for r in readers.template_samples(spark, f"{tmp_path}/t.json").collect()) == [("CWE-1-000", "x"), ("CWE-1-001", "y")]
    manager = readers.SourceManager({"t": lambda: readers.template_samples(spark, f"{tmp_path}/t.json"), "i": lambda: readers.instruct_samples(spark, f"{tmp_path}/i.json")})
    assert sorted(r.origin for r in manager.load_all().collect()) == ["i", "i", "t", "t"] and manager.load("i", "CWE-89").count() == 1


def test_paths_and_ages(spark, tmp_path):
    (tmp_path / "b.json").write_text(json.dumps([{"id": "2", "cwe": "CWE-2", "difficulty": "hard"}]))
    assert readers.benchmark(spark, f"{tmp_path}/none.json", others=(f"{tmp_path}/b.json",)).count() == 1
    with pytest.raises(FileNotFoundError):
        readers.first_path(spark, f"{tmp_path}/none.json")
    assert readers.latest(spark, f"{tmp_path}/*.json").endswith("b.json") and readers.latest(spark, f"{tmp_path}/*.txt") is None
    (tmp_path / "c.json").write_text(json.dumps([{"cwe_id": "1", "fetched_at": "2024-01-01T00:00:00"}, {"cwe_id": "2", "fetched_at": "2024-01-02T11:00:00"}]))
    now = F.lit("2024-01-02 12:00:00").cast("timestamp")
    assert [r.cwe_id for r in readers.cached_pages(spark, f"{tmp_path}/c.json", now=now).collect()] == ["2"]
    assert readers.cached_pages(spark, f"{tmp_path}/c.json", None).count() == 2


def test_audit_files_and_report(spark, tmp_path):
    audited = spark.createDataFrame([(1, 0.5, True), (2, 0.0, False)], "id int, overlap double, flagged boolean")
    sinks.save_audit(audited, spark.createDataFrame([("a b", 3)], "gram string, df int"), f"{tmp_path}/a")
    assert [r.id for r in spark.read.json(f"{tmp_path}/a/clean").collect()] == [2] and spark.read.json(f"{tmp_path}/a/summary").first().flagged == 1
    text = sinks.report({"One": audited, "Two": audited}, "All", ("note",))
    assert text.startswith("# All\n\nnote\n\n## One") and "## Two" in text


def test_stream_goes_on_from_its_checkpoint(spark, tmp_path):
    events = spark.createDataFrame([(k, k % 3, float(k)) for k in range(10)], "id int, user_id int, value double").withColumn("ts", F.expr("timestamp'2024-01-01' + make_dt_interval(0, 0, id)"))
    events.write.parquet(f"{tmp_path}/in")
    source = progress.stream(spark, f"{tmp_path}/in", events.schema)
    for more in (0, 5):
        if more:
            events.limit(more).write.mode("append").parquet(f"{tmp_path}/in")
        progress.run_to_end(source, f"{tmp_path}/out", f"{tmp_path}/ck")
        assert spark.read.parquet(f"{tmp_path}/out").count() == 10 + more
