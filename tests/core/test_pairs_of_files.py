"""Task and test files, and examples in comments, from folders written here."""

import hashlib

from pyspark.sql import functions as F

from sievekit.sources import readers, sinks

TASK = """import os
import re


def run_it(x: str) -> str:
    \"\"\"Run x.\"\"\"
    # BEGIN SOLUTION
    return os.path.realpath(x)

"""
TEST = """from cwe_022_0_task import run_it

def run_it_unsafe(x):
    return x


def run_it_unsafe_2 (x):
    def unsafe_inner():
        pass
    return os.popen(x)


def test_unsafe():
    assert run_it("a")
"""


def test_pairs(spark, tmp_path):
    files = {
        "cwe_022_0_task": TASK, "cwe_022_0_test": TEST, "cwe_079_0_task": TASK, "cwe_079_0_test": TEST.replace("run_it_unsafe(", "some_unsafe("),
        "cwe_329_0_task": TASK, "cwe_329_0_test": TEST, "cwe_078_0_task": TASK.replace("BEGIN", "END"), "cwe_078_0_test": TEST, "cwe_077_0_task": TASK,
        "cwe_502_0_task": "def f():\n    # BEGIN SOLUTION\n    pass", "cwe_502_0_test": "def broken(:", "other_task": "def g():\n  # BEGIN SOLUTION\n  pass\n\n", "other_test": "# CWE-0611\ndef g_unsafe():\n  return 1\n",
        "none_task": TASK, "none_test": TEST,
    }
    for name, text in files.items():
        (tmp_path / f"{name}.py").write_text(text)
    got = {(r.original_id, r.unsafe): r for r in readers.expert_pairs(spark, f"file://{tmp_path}").collect()}
    assert set(got) == {("cwe_022_0", "run_it_unsafe"), ("cwe_022_0", "run_it_unsafe_2"), ("cwe_079_0", "some_unsafe"), ("cwe_079_0", "run_it_unsafe_2"), ("other", "g_unsafe")}
    r = got["cwe_022_0", "run_it_unsafe"]
    assert (r.cwe, r.function, r.prompt) == ("CWE-22", "run_it", 'def run_it(x: str) -> str:\n    """Run x."""')
    assert r.secure_code == "import os\nimport re\n\n\n" + TASK[TASK.index("def run_it") :].rstrip()
    assert r.insecure_code == "import os\nimport re\n\n\ndef run_it(x):\n    return x"
    assert r.id == hashlib.md5(b"cweval_cwe_022_0_unsafe_0").hexdigest()[:12]
    assert got["cwe_022_0", "run_it_unsafe_2"].id == hashlib.md5(b"cweval_cwe_022_0_unsafe_2_1").hexdigest()[:12]
    assert got["cwe_022_0", "run_it_unsafe_2"].insecure_code.split("\n\n\n")[1].startswith("def run_it(x):\n    def unsafe_inner")
    r = got["other", "g_unsafe"]
    assert (r.cwe, r.function, r.prompt, r.secure_code, r.insecure_code) == ("CWE-611", "g", "def g():", "def g():\n  # BEGIN SOLUTION\n  pass", "def g():\n  return 1")
    assert {r.cwe for r in readers.expert_pairs(spark, f"file://{tmp_path}", 22).collect()} == {"CWE-22"}
    assert readers.expert_pairs(spark, f"file://{tmp_path}", 22).inputFiles() and all("cwe_022" in f for f in readers.text_files(spark, f"file://{tmp_path}", "cwe_{22,022}_*.py").inputFiles())


def test_examples(spark):
    cases = [
        ("/**\n * ```python\n * x = 1\n *   y\n * ```\n*/", ["x = 1\ny"]), ("// BAD\n// a\nb\n// GOOD\nc", ["a\nb"]), ("// bad\n// good\n// Bad: x\nq\n```", ["q"]),
        ("// bad\na\n// bad\nb\n// good", ["a\nb"]), ("```python\nnever ended", []), ("", []), (None, []), ("// bad\n\n// good", [""]),
    ]
    cases[0] = ("/**\n```python\n* x = 1\n*   y\n```\n*/", ["x = 1\ny"])
    rows = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(cases)], "k int, t string").select("k", readers.query_examples(F.col("t")).alias("e"))
    assert [r.e for r in rows.orderBy("k").collect()] == [e for _, e in cases]


def test_literals(spark):
    cases = [
        ('{"n": 1, "s": "x"}', (1, "x", None)), ("{'n': 2, 's': \"it's\", 'l': (True, None)}", (2, "it's", [True, None])), ("{'l': {False}}", (None, None, [False])), ("{'n': None}", (None, None, None)),
        ("__import__('os').getpid()", None), ("{'n': 1 + ", None), ("", None), (None, None), ("-" * 100_000 + "1", None), ("{'s': b'x'}", None), ("{'s': '\\\\u00e9'}", (None, "\\u00e9", None)),
    ]
    rows = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(cases)], "k int, t string")
    got = {r.k: r.f for r in rows.select("k", readers.parse_field(F.col("t"), "n int, s string, l array<boolean>").alias("f")).collect()}
    assert {k: None if f is None else tuple(f) for k, f in got.items()} == {k: want for k, (_, want) in enumerate(cases)}


def test_unjudged(spark, tmp_path):
    for name in ("r/a.json", "r/b.json", "r/c.txt", "j/a.json"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("{}")
    assert [r.name for r in readers.unjudged(spark, f"file://{tmp_path}/r/*.json", f"file://{tmp_path}/j/*.json").collect()] == ["b.json"]
    assert readers.unjudged(spark, f"file://{tmp_path}/no/*.json", f"file://{tmp_path}/j/*").count() == 0


def test_checkpoint_of_finished_rows(spark, tmp_path):
    todo, path = spark.createDataFrame([(1,), (2,), (3,)], "id int"), f"file://{tmp_path}/done"
    sinks.append_checkpoint(todo.where("id = 2"), path)
    assert sorted(r.id for r in readers.resume(todo, spark.read.parquet(path)).collect()) == [1, 3]
    assert sinks.clear_checkpoint(spark, path) and not sinks.clear_checkpoint(spark, path) and not (tmp_path / "done").exists()
