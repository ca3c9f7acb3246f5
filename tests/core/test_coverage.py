"""Executable lines, coverage from sets of lines, and classes of parameters."""

import pytest
from pyspark.sql import functions as F

from sievekit.operators import coverage

CODE = '''"""Docstring
over two lines."""
import os  # 3

# comment
def f(a,
      b=2):
    """Inner."""
    if a:

        return (
            b
        )
    x = """text
    more"""
'''


def test_lines(spark):
    rows = [(1, CODE), (2, "def f(:\n\n  # x\n  y"), (3, ""), (4, None), (5, "-" * 200_000 + "1")]
    got = {r.id: r.lines for r in spark.createDataFrame(rows, "id int, code string").select("id", coverage.executable_lines("code").alias("lines")).collect()}
    # The constant of a docstring is a node of its own, so its first line counts.
    assert got == {1: [1, 3, 6, 7, 8, 9, 11, 12, 14], 2: [1, 4], 3: [], 4: [], 5: [1]}


def test_coverage(spark):
    samples = spark.createDataFrame([(1, "a = 1\n\nb = 2\nc = 3\n"), (2, ""), (3, "x = 1")], "id int, code string")
    executed = spark.createDataFrame([(1, 1), (1, 1), (1, 2), (1, 4), (1, 99), (3, 7), (9, 1)], "id int, line int")
    got = {r.id: (r.lines_total, r.lines_covered, r.line_coverage) for r in coverage.line_coverage(samples, executed).collect()}
    assert got == {1: (3, 2, 2 / 3), 2: (0, 0, 0.0), 3: (1, 0, 0.0)}


@pytest.mark.parametrize(
    "code, name, want",
    [
        ("def f(self, user_input: str = 'a', *args, **kw): pass", "f", [("user_input", "str", "'a'", "tainted")]),
        ("def g(a): pass\ndef  f (\n  db,\n  x: sqlite3.Connection = None,\n  Query\n): pass", "f", [("db", None, None, "infrastructure"), ("x", "sqlite3.Connection", "None", "infrastructure"), ("Query", None, None, "tainted")]),
        ("def f(x: dict = {'a': 1}, y=b==c): pass", "f", [("x", "dict", "{'a': 1}", "unknown"), ("y", None, "b==c", "unknown")]),
        ("def f(path: RequestPath, *, cls, user_id=(1, 2)): pass", "f", [("path", "RequestPath", None, "infrastructure"), ("user_id", None, "(1", "infrastructure"), ("2", None, None, "unknown")]),
        ("def f(): pass", "f", []), ("def f.x(a): pass", "f.x", [("a", None, None, "unknown")]), ("x = 1", "f", []), (None, "f", []), ("def f(a): pass", None, []), ("", "", []),
    ],
)
def test_parameters(spark, code, name, want):
    row = spark.createDataFrame([(code, name)], "code string, name string").select(coverage.classified_parameters(F.col("code"), F.col("name")).alias("p")).first()
    assert [tuple(p) for p in row.p] == want
