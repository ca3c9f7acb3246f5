"""Rules over hand-made cases, dealt over the benchmark's items: what is expected is written down by hand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievekit.functions import text as t
from sievekit.operators import audit as a
from sievekit.operators import contamination as c
from sievekit.operators import findings as fi
from sievekit.operators import judges as j
from sievekit.operators import kills
from sievekit.operators import rules as r
from sievekit.operators import similarity as si
from sievekit.session import table
from sievekit.sources import readers


def cases(spark: SparkSession, sf_dir: str, rows: list[tuple], schema: str) -> DataFrame:
    """item_id and the columns of one case for each item, in turn."""
    numbered = spark.createDataFrame([(k, *x) for k, x in enumerate(rows)], f"_k int, {schema}")
    items = table(spark, sf_dir, "benchmark").select("item_id", (F.col("item_id") % len(rows)).cast("int").alias("_k"))
    return items.join(F.broadcast(numbered), "_k").drop("_k")


def literal(x: object) -> str:
    """A value as SQL."""
    if x is None:
        return "NULL"
    if isinstance(x, bool):
        return str(x).lower()
    if isinstance(x, str):
        return "'" + x.replace("'", "''") + "'"
    return f"{x!r}::DOUBLE" if isinstance(x, float) else str(x)


def expected(rows: list[tuple], names: str) -> str:
    """The SQL of what cases() should give in columns names."""
    values = ", ".join(f"({', '.join(map(literal, (k, *x)))})" for k, x in enumerate(rows))
    return f"SELECT item_id, {names} FROM benchmark JOIN (VALUES {values}) AS t(k, {names}) ON item_id % {len(rows)} = k"


ERRORS = [
    ("SyntaxError: a", "syntax"), ("  Invalid Syntax near b", "syntax"), ("E  ModuleNotFoundError: No module", "import"), ("importerror", "import"),
    ("NameError: x", "name"), ("TypeError", "type"), ("attributeError: y", "attribute"), ("IndentationError: z", "indentation"),
    ("Timeout after 5 s", "timeout"), ("RuntimeError: q", "runtime"), ("ValueError: odd", "other_runtime"), ("an Exception came", "other_runtime"),
    ("strange", "unknown"), ("", "unknown"), (None, "unknown"),
]
MODELS = [
    ("org/m:1.5 b [4bit]", "lab", "org_m_1.5b_lab"), ("plain", "", "plain"), ("a b", None, "ab"), (" x/y [z] w", "p q", "x_y_p q"), ("v2.0", "lab", "v2.0_lab"),
]
VARIANTS = [
    ("Removed x", "removal"), ("Dead check (pass instead of raise)", "pass_variant"), ("a → b", "removal"), ("Kept (dead code)", "pass_variant"),
    ("dead end", "removal"), ("DEAD CHECK", "pass_variant"), ("", "removal"),
]
TOOL_CWES = [
    ("CWE-327: Use of a Broken Algorithm", "CWE-327"), ("see CWE-089 and CWE-20", "CWE-089"), (" 79 ", "CWE-79"), ("0079", "CWE-0079"), ("cwe-22", None), ("79x", None),
    ("", None), (None, None),
]

_A = 'def test_login_rejects_bad_input(v):\n    """Doc."""\n    assert True\n    assert v == 4, \'message\'\n    assert result is not None\n    assert ok\n    assert 1 == 1\n    pytest.fail("no")\n'
_B = "def test_y():\n    assert False\n    assert x, f'm'\n    assert f(a, \"b\")\n"
_E = "def test_e():\n    run(0, -5, [], {}, 'a' * 1000, float('nan'), '\\n', max_len)\n    # boundary, unicode, blank\n"
_F = (
    "import sqlite3\nfrom socket import x\nclass T:\n    pass\ntry:\n    a()\nexcept ValueError:\n    pass\nwhile True:\n    print(1)\n    print (2)\n"
    "    print(3)\n    time.sleep(1)\n"
)
_G = "import pytest\n@pytest.fixture\ndef db():\n    db.reset()\n@pytest.mark.parametrize('x', [1])\ndef test_g(x):\n    with pytest.raises (ValueError):\n        run(x)\n"
CODES = [_A, _B, "", "x = 1\nassert(True)\n", _E, _F, _G]
COUNTS = "total, assert_true, assert_false, is_not_none, bare_assert, tautology, with_messages, pytest_fail"
COUNTED = [(6, 1, 0, 1, 1, 1, 1, 1), (3, 0, 1, 0, 0, 0, 2, 0), (0,) * 8, (0,) * 8, (0,) * 8, (0,) * 8, (0,) * 8]
EDGES = [
    "empty string|None/null input|special characters", "special characters", "", "",
    "zero value|negative number|boundary condition|min/max values|special characters|large/long input|empty/blank handling|unicode characters|"
    "empty list/array|empty dict/object|control characters|float edge cases",
    "", "special characters",
]
NOTES = [
    "", "", "", "", "",
    "try/except pass swallows errors (x1)|Contains class definition (not allowed)|Imports real modules instead of using mocks: socket, sqlite3|"
    "while True loop (potential hang)|time.sleep() in tests (slows execution)|Excessive print statements (3) instead of assertions",
    "",
]
FLAGS = "pytest_raises, pytest_raises_context, redundant_import_pytest, has_fixture, parametrize, mock_reset"
FLAGGED = [(False,) * 6] * 6 + [(True,) * 6]
#: cwe, entry point, tests; score, assertions, edge cases, follows, confidence.
QUALITY = [
    ("CWE-89", "login", _A, 0.36, 6, 3, False, 0.76), ("CWE-89", "zzz", _B, 0.21, 3, 1, False, 0.64),
    ("CWE-89", "f", " \n", 0.0, 0, 0, False, 1.0), ("CWE-22", "run", _G, 0.31, 0, 1, True, 0.58), ("CWE-89", "f", None, 0.0, 0, 0, False, 1.0),
]

SECURITY = j.SecurityRules(
    attacks={"CWE-89": [("or 1=1", "tautology"), ("union select", "union"), ("--", "comment")]}, least={"CWE-89": 2},
    mocks={"CWE-89": {"db": ["last_query"]}}, right={"CWE-89": ["last_params", "not in db.last_query"]}, wrong={"CWE-89": ["in result_all"]},
)
_S = "def test_inject():\n    find(\"' OR 1=1\")\n    assert payload not in db.last_query, 'injection'\n    assert db.last_params\n"
_U = "def test_all():\n    find('UNION SELECT 1 -- or 1=1')\n    assert row in result_all\n"
#: cwe, its name, secure code, tests.
ATTACKED = [
    ("CWE-89", "SQL Injection", "def find(q):\n    pass", _S), ("CWE-89", "SQL Injection", "def find(q):\n    pass", ""),
    ("CWE-1", "Odd", "def g(): pass", "def test_z():\n    assert True\n    pass\n"),
    ("CWE-1", "Path Traversal", "def g(p): pass", "def test_q():\n    with pytest.raises(ValueError):\n        g('../x traversal')\n"),
    ("CWE-89", "SQL Injection", "def find(q):\n    pass", _U),
]
#: attacks, mocks used, mocks expected, right, wrong, security asserts; all asserts.
CHECKED = [("tautology", 1, 1, 2, 0, 1, 2), ("", 0, 1, 0, 0, 0, 0), ("", 0, 0, 0, 0, 0, 1), ("", 0, 0, 0, 0, 0, 1), ("tautology,union,comment", 0, 1, 0, 1, 0, 1)]
#: score, addressed, attacks, confidence.
SCORED = [(0.75, True, "tautology", 0.8), (0.0, False, "", 1.0), (0.0, False, "", 0.5), (0.23, True, "", 0.55), (0.45, True, "tautology,union,comment", 0.7)]

SNIPPETS = [
    ("def f(x):\n    return x", True, False), ("import os", True, False), ("system(\"ls\")\nimport os", False, False), ("my $x = 1; if x:", False, False),
    ("words only", False, False), ("", False, False), (None, False, False), ("if config.debug: run()", True, True), ("for x in args:\n    pass", True, True),
    ("args = 1\nfor x in args:\n    pass", True, False), ("def f(params):\n    return params", True, False), ("rev = 1\nreturn rev", True, True),
    ("cursor = connect()\nprint(1)", True, False),
]
PARAMETERS = [
    ("def f(self, a: int = 3, *args, b='x', **kw): pass", "f", "a|b"), ("def g(): pass", "g", ""), ("def g(a): pass", "f", ""),
    ("x = 1\ndef h(a,\n      b): pass", "h", "a|b"), ("def k(d: Dict[str, int], e): pass", "k", "d|int]|e"), ("def f(a): pass", None, ""),
]
OLD_CODE = [
    ("    x = 1\n    print x\n", "x = 1\nprint(x)"), ("print \"a\"\ny", "print(\"a\")\ny"), ("\n\n  y = 2", "y = 2"), ("print a, b", "print(a, b"),
    ("print(a)", "print(a)"), ("", ""), (" \n", " \n"), (None, None),
]
#: weakness, way, code, what it becomes.
WAYS = [
    ("CWE-89", "sql_direct_execute", "r = db.execute(q).fetchall()", "r = conn.execute(q).fetchall()"),
    ("CWE-89", "sql_fetchone_variant", "r = db.execute(q).fetchall()", "cursor = db.execute(q)\nr = cursor.fetchone()"),
    ("CWE-89", "sql_cursor_based", "  r = db.execute(q)", "  cursor = db.cursor()\n  cursor.execute(q)\n  r = cursor.fetchall()"),
    ("CWE-89", "sql_context_manager", "def f(q):\n    r = db.execute(q)", "def f(q):\n    with db.connection() as conn:\n        r = db.execute(q)"),
    ("CWE-78", "cmd_subprocess_run", "subprocess.call(cmd)", "subprocess.run(cmd, capture_output=True)"),
    ("CWE-78", "cmd_check_output", "subprocess.run(cmd)", "subprocess.check_output(cmd)"),
    ("CWE-78", "cmd_subprocess_popen", "subprocess.run(cmd)", "proc = subprocess.Popen(cmd, stdout=subprocess.PIPE)\noutput, _ = proc.communicate()"),
    ("CWE-22", "path_os_path", "import pathlib\np = Path(a) / b", "import pathlib\np = os.path.join(a, b)"),
    ("CWE-22", "path_os_path", "p = Path(a) / b", "p = Path(a) / b"),
    ("CWE-22", "path_context_manager", "t = open(p).read()", "with open(p) as f:\n    t = f.read()"),
    ("CWE-22", "path_pathlib", "os.path.exists(p)", "from pathlib import Path\nPath(p).exists()"),
    ("CWE-22", "path_pathlib", "open(p)", "open(p)"), ("CWE-502", "deser_json_loads", "json.load(f)", "json.loads(f)"),
    ("CWE-999", "deser_json_loads", "json.load(f)", "json.load(f)"),
]


def _ways(s, d):
    rows = cases(s, d, [x[:3] for x in WAYS], "cwe string, way string, code string")
    code, name = F.col("code"), F.lit("none")
    for weakness, ways in c.STRUCTURES.items():
        for way, steps in ways.items():
            done, called = c.restructured(F.col("code"), F.col("cwe"), structures={weakness: {way: steps}})
            here = F.col("way") == way
            code, name = F.when(here, done).otherwise(code), F.when(here, called).otherwise(name)
    return rows.select("item_id", "way", code.alias("code"), name.alias("name"))


#: id, mutated codes of a sample whose fix is safe() and whose weakness is eval(); whether a mutant is alike, and how much.
_SECURE, _INSECURE = "a = 1\nx = safe(v)\n", "a = 1\nx = eval(v)\n"
MUTANTS = [(1, "CWE-95", _INSECURE), (1, "CWE-95", "a = 2\nx = safe(v)\n"), (2, "CWE-95", "a = 2\nx = safe(v)\n"), (3, "CWE-1", _INSECURE)]


def _sanity(s, d):
    """Programs that quote a document's text, their insecure forms, and mutants that are like those or not."""
    said = F.concat(F.lit("note = '"), F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z ]", " "), F.lit("'\n"))
    docs = table(s, d, "documents").select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 3 < 2, "CWE-95").otherwise("CWE-1").alias("cwe"), said.alias("said"))
    samples = docs.select("id", "cwe", F.concat(F.lit("x = int(y)\n"), "said").alias("secure_code"), F.concat(F.lit("x = eval(y)\n"), "said").alias("insecure_code"))
    first = F.when(F.col("id") % 3 == 0, "x = eval(y)\n").otherwise("x = str(y)\n")
    return si.mutation_sanity(samples, docs.select("id", F.concat(first, "said").alias("mutated_code")), {"CWE-95": [r"EVAL\("]})


_SEMGREP = [
    ('{"results": [{"check_id": "r1", "start": {"line": 3}, "extra": {"severity": "ERROR", "message": "m", "metadata": {"cwe": ["CWE-89: SQL", "CWE-1"]}}}]}', "r1", "m", "ERROR", 3, "CWE-89"),
    ('{"results": [{"check_id": "r2", "start": {"line": 4}, "extra": {"severity": "INFO", "message": "n", "metadata": {"cwe": "CWE-078"}}}]}', "r2", "n", "INFO", 4, "CWE-078"),
    ('{"results": [{"check_id": "r3", "start": {"line": 5}, "extra": {"severity": "INFO", "message": "o", "metadata": {}}}]}', "r3", "o", "INFO", 5, None),
]
_ROW = "a = {n}\nb = [{n}]\nif a:\n    c = 1\n"
#: What an identifier is, and the names that are known already.
_KNOWN = ["the", "of"]
#: generation method and quality, source, reviewed by hand, reviewed, entry point, secure code, insecure code, tests; level, passed, notes, method.
ASSESSED = [
    (None, "verified", "x", None, None, "f", "broken(", "", "", "template", True, "", "transform"),
    ("template", None, "x", None, None, "f", "broken(", "", "", "template", True, "", "template"),
    (None, None, "own", True, None, "f", "broken(", "", "", "curated", True, "", "transform"),
    (None, None, "own", None, None, "f", "# AUTO-GENERATION FAILED", "", "", "auto", False, "Secure code generation failed", "transform_failed"),
    ("llm", None, "x", None, None, "f", " x = 1", "x = 1 ", "", "auto", False, "Secure code identical to insecure", "llm"),
    ("llm", None, "x", None, None, "f", "x = (", "x = 1", "", "auto", False, "Syntax error", "llm"),
    ("llm", None, "x", None, True, "f", "def g(): pass", "x = 1", "def t(", "auto", False, "Entry point 'f' not in secure code|security_tests has syntax error", "llm"),
    ("transform_x", None, "x", None, True, "f", "def f(): pass", "x = 1", "f()", "reviewed", True, "", "transform_x"),
    ("llm", None, "x", None, False, "", "def f(): pass", "x = 1", None, "auto", True, "", "llm"),
]

QUERIES = {
    "x07_error_category": lambda s, d: cases(s, d, [x[:1] for x in ERRORS], "error string").select("item_id", kills.error_category(F.col("error")).alias("category")),
    "a16_test_validity": lambda s, d: kills.test_validity(
        cases(s, d, [x[:1] for x in ERRORS], "error string").withColumn("file", F.concat(F.lit("file"), (F.col("item_id") % 4).cast("string")))
    ),
    "x09_model_name": lambda s, d: cases(s, d, [x[:2] for x in MODELS], "name string, provider string").select("item_id", t.model_name(F.col("name"), F.col("provider")).alias("folder")),
    "x28_variant_type": lambda s, d: cases(s, d, [x[:1] for x in VARIANTS], "said string").select("item_id", t.variant_type(F.col("said")).alias("kind")),
    "x02_tool_cwe": lambda s, d: cases(s, d, [x[:1] for x in TOOL_CWES], "raw string").select("item_id", fi.tool_cwe(F.col("raw")).alias("cwe")),
    "x16_assertion_counts": lambda s, d: cases(s, d, [(x,) for x in CODES], "code string").select("item_id", j.assertion_counts(F.col("code")).alias("a")).select("item_id", "a.*"),
    "x18_edge_cases": lambda s, d: cases(s, d, [(x,) for x in CODES], "code string").select("item_id", F.array_join(j.edge_case_tags(F.col("code")), "|").alias("tags")),
    "x19_anti_patterns": lambda s, d: cases(s, d, [(x,) for x in CODES], "code string").select("item_id", F.array_join(j.anti_patterns(F.col("code")), "|").alias("notes")),
    "x20_practices": lambda s, d: cases(s, d, [(x,) for x in CODES], "code string").select("item_id", j.practices(F.col("code")).alias("p")).select("item_id", "p.*"),
    "m04_quality_score": lambda s, d: j.quality_score(
        cases(s, d, [x[:3] for x in QUALITY], "cwe string, entry_point string, tests string").withColumnRenamed("item_id", "id"),
        {"CWE-89": ["db"], "CWE-22": ["fs"]}, {"CWE-89": ["fs"]},
    ).withColumnRenamed("id", "item_id"),
    "f17_security_checks": lambda s, d: cases(s, d, ATTACKED, "cwe string, cwe_name string, secure_code string, code string").withColumns(
        j.security_checks(F.col("code"), F.col("cwe"), SECURITY)
    ).select("item_id", F.array_join("attacks", ",").alias("attacks"), "mocks_used", "mocks_expected", F.col("right").alias("n_right"), F.col("wrong").alias("n_wrong"), "security_asserts"),
    "x17_assertions": lambda s, d: cases(s, d, [x[3:] for x in ATTACKED], "code string").select("item_id", j.test_assertions(F.col("code")).alias("n")),
    "m05_security_score": lambda s, d: j.security_score(
        cases(s, d, ATTACKED, "cwe string, cwe_name string, secure_code string, tests string").withColumnRenamed("item_id", "id"), SECURITY
    ).select(F.col("id").alias("item_id"), "score", "cwe_addressed", F.array_join("attacks", ",").alias("attacks"), "confidence"),
    "f15_python_snippets": lambda s, d: r.python_snippets(cases(s, d, [x[:1] for x in SNIPPETS], "code string")).select("item_id"),
    "f16_lacks_context": lambda s, d: cases(s, d, [x[:1] for x in SNIPPETS], "code string").select("item_id", r.lacks_context(F.col("code")).alias("lacks")),
    "s03_whole_snippets": lambda s, d: r.whole_snippets(cases(s, d, [x[:1] for x in SNIPPETS], "code string")).select("item_id"),
    "x23_parameters": lambda s, d: cases(s, d, [x[:2] for x in PARAMETERS], "code string, name string").select("item_id", F.array_join(r.parameters(F.col("code"), F.col("name")), "|").alias("names")),
    "x22_preprocessed": lambda s, d: cases(s, d, [x[:1] for x in OLD_CODE], "code string").select("item_id", r.preprocessed(F.col("code")).alias("code")),
    "x14_restructured": _ways,
    "a35_mutation_sanity": lambda s, d: _sanity(s, d).withColumn("best_similarity", F.round("best_similarity", 3)),
    "a35_sanity_summary": lambda s, d: si.sanity_summary(_sanity(s, d)),
    "n05_parse_semgrep": lambda s, d: fi.parse_semgrep(cases(s, d, [x[:1] for x in _SEMGREP], "json string"), keep=("item_id",)),
    "m10_assess": lambda s, d: a.assess(
        cases(s, d, [x[:9] for x in ASSESSED], "generation_method string, generation_quality string, source string, manually_reviewed boolean, reviewed boolean, entry_point string, secure_code string, insecure_code string, security_tests string").withColumn("functional_tests", F.lit(None).cast("string"))
    ).select("item_id", F.col("quality_level").alias("level"), F.col("validation_passed").alias("passed"), F.array_join("notes", "|").alias("notes"), "method"),
    "s04_literal_field": lambda s, d: table(s, d, "benchmark").select("item_id", readers.parse_field(F.format_string("{'n': %d, 's': 'x'}", "item_id"), "n int, s string").alias("f")).select("item_id", "f.*"),
}

#: difflib's ratio of "+x = eval(y)" and "+x = str(y)": 8 of 12 and 11 characters match.
_LIKE_EXACT = "16 / 23.0E0"
_LIKE = f"round({_LIKE_EXACT}, 3)"
ORACLE = {
    "x07_error_category": expected([x[1:] for x in ERRORS], "category"),
    "a16_test_validity": f"WITH e AS ({expected([x[1:] for x in ERRORS], 'category')}) SELECT file, category, count(*) AS n FROM (SELECT 'file' || (item_id % 4) AS file, category FROM e) GROUP BY ROLLUP (file, category)",
    "x09_model_name": expected([x[2:] for x in MODELS], "folder"),
    "x28_variant_type": expected([x[1:] for x in VARIANTS], "kind"),
    "x02_tool_cwe": expected([x[1:] for x in TOOL_CWES], "cwe"),
    "x16_assertion_counts": expected(COUNTED, COUNTS),
    "x18_edge_cases": expected([(x,) for x in EDGES], "tags"),
    "x19_anti_patterns": expected([(x,) for x in NOTES], "notes"),
    "x20_practices": expected(FLAGGED, FLAGS),
    "m04_quality_score": expected([x[3:] for x in QUALITY], "score, assertions, edge_cases, follows_practices, confidence"),
    "f17_security_checks": expected([x[:6] for x in CHECKED], "attacks, mocks_used, mocks_expected, n_right, n_wrong, security_asserts"),
    "x17_assertions": expected([x[6:] for x in CHECKED], "n"),
    "m05_security_score": expected(SCORED, "score, cwe_addressed, attacks, confidence"),
    "f15_python_snippets": f"SELECT item_id FROM ({expected([x[1:2] for x in SNIPPETS], 'python')}) WHERE python",
    "f16_lacks_context": expected([x[2:] for x in SNIPPETS], "lacks"),
    "s03_whole_snippets": f"SELECT item_id FROM ({expected([x[1:] for x in SNIPPETS], 'python, lacks')}) WHERE python AND NOT lacks",
    "x23_parameters": expected([x[2:] for x in PARAMETERS], "names"),
    "x22_preprocessed": expected([x[1:] for x in OLD_CODE], "code"),
    "x14_restructured": expected([(x[1], x[3], f"structural_{x[1]}" if x[0] != "CWE-999" else "none") for x in WAYS], "way, code, name"),
    "a35_mutation_sanity": f"SELECT doc_id AS id, CASE WHEN doc_id % 3 < 2 THEN 'CWE-95' ELSE 'CWE-1' END AS cwe, 1 AS mutants, doc_id % 3 = 0 AS class_match, CASE WHEN doc_id % 3 = 0 THEN 1.0E0 ELSE {_LIKE} END AS best_similarity FROM documents",
    "a35_sanity_summary": f"SELECT count(*) AS checked, count(*) FILTER (WHERE doc_id % 3 = 0) AS matched, round(avg(CASE WHEN doc_id % 3 = 0 THEN 1.0E0 ELSE {_LIKE_EXACT} END), 3) AS similarity FROM documents",
    "n05_parse_semgrep": expected([x[1:] for x in _SEMGREP], "rule, message, severity, line, cwe"),
    "m10_assess": expected([x[9:] for x in ASSESSED], "level, passed, notes, method"),
    "s04_literal_field": "SELECT item_id, CAST(item_id AS INT) AS n, 'x' AS s FROM benchmark",
}
