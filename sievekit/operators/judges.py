"""Judge answers, rule-based test scoring and composite scores."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WEIGHTS = {"mutation": 0.50, "security": 0.20, "quality": 0.15, "coverage": 0.15}
ANSWER = "score int, confidence int, cwe_addressed boolean, attack_vectors_tested array<string>, issues_found array<string>"


def json_blob(text: Column, schema: str = ANSWER) -> Column:
    """The struct of the first {...} (greedy) in a text; nulls where there is none or it is broken."""
    return F.from_json(F.regexp_extract(text, r"(?s)\{.*\}", 0), schema)


def scaled(score: Column) -> Column:
    """Percent as a share; missing counts as 0."""
    return F.coalesce(score, F.lit(0)) / 100.0


def repaired(text: Column) -> Column:
    """A model's JSON without fences, line comments and trailing commas."""
    bare = F.regexp_replace(text, r"(?m)^\s*```\w*\s*$", "")
    bare = F.regexp_replace(bare, r"(?m)//[^\n\"]*$", "")
    return F.trim(F.regexp_replace(bare, r",\s*([}\]])", "$1"))


def composite(**scores: Column) -> Column:
    """Weighted sum of mutation, security, quality, coverage; missing ones count as 0."""
    out = F.lit(0.0)
    for name, weight in WEIGHTS.items():
        out = out + F.coalesce(scores.get(name, F.lit(None).cast("double")), F.lit(0.0)) * weight
    return out


def combine(security: DataFrame, quality: DataFrame) -> DataFrame:
    """Both judges' shares by sample; one that is missing keeps the other's part (0.6 and 0.4)."""
    a = security.select("sample_id", scaled(F.col("raw")).alias("security"))
    b = quality.select("sample_id", scaled(F.col("raw")).alias("quality"))
    score = F.coalesce("security", F.lit(0.0)) * 0.6 + F.coalesce("quality", F.lit(0.0)) * 0.4
    return a.join(b, "sample_id", "full").withColumn("composite", score)


def judge_summary(combined: DataFrame) -> DataFrame:
    """Counts and means; the composite's over rows that have both scores."""
    both = F.col("security").isNotNull() & F.col("quality").isNotNull()
    return combined.agg(
        F.count("security").alias("n_security"), F.count("quality").alias("n_quality"), F.count_if(both).alias("n_both"),
        F.avg("security").alias("avg_security"), F.avg("quality").alias("avg_quality"),
        F.avg(F.when(both, F.col("composite"))).alias("avg_composite"),
        F.min(F.when(both, F.col("composite"))).alias("min_composite"), F.max(F.when(both, F.col("composite"))).alias("max_composite"),
    )


def extract_code(response: Column) -> Column:
    """Fenced blocks joined by an empty line; else from the first test function on; else the whole."""
    fenced = F.array_join(F.transform(F.regexp_extract_all(response, F.lit(r"(?s)```(?:python)?\s*\n(.*?)```"), F.lit(1)), lambda x: F.trim(x)), "\n\n")
    from_test = F.regexp_extract(response, r"(?s)(def test_.*)", 1)
    return F.coalesce(F.nullif(fenced, F.lit("")), F.nullif(F.trim(from_test), F.lit("")), F.trim(response))


def entry_point(code: Column) -> Column:
    """The first function's name, null without any."""
    return F.nullif(F.regexp_extract(code, r"def\s+(\w+)\s*\(", 1), F.lit(""))


def _stripped(code: Column) -> Column:
    """A text's lines without white space around them."""
    return F.transform(F.split(code, "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))


def assertion_counts(code: Column) -> Column:
    """Struct of counters over a test's lines; total counts lines that assert, and those with pytest.fail besides.

    An asserting line is of one kind at most, the first that fits.
    """
    lines = _stripped(code)
    asserts = F.filter(lines, lambda x: x.startswith("assert "))
    kinds = (
        ("assert_true", r"^assert\s+True\s*$"), ("assert_false", r"^assert\s+False\s*$"), ("is_not_none", r"^assert\s+\w+\s+is\s+not\s+None\s*$"),
        ("bare_assert", r"^assert\s+\w+\s*$"), ("tautology", r"^assert\s+1\s*==\s*1"),
    )

    def kind(line: Column) -> Column:
        out = F.lit("other")
        for name, pattern in reversed(kinds):
            out = F.when(line.rlike(pattern), name).otherwise(out)
        return out

    found = F.transform(asserts, kind)
    failed = F.size(F.filter(lines, lambda x: x.contains("pytest.fail")))
    return F.struct(
        (F.size(asserts) + failed).alias("total"),
        *(_number(found, name).alias(name) for name, _ in kinds),
        F.size(F.filter(asserts, lambda x: x.rlike(r",\s*f?[\"']"))).alias("with_messages"), failed.alias("pytest_fail"),
    )


def _number(items: Column, value: str) -> Column:
    return F.size(F.filter(items, lambda x: x == value))


#: Signs of edge cases, whatever the case, and what they are called, in order: fixed values.
EDGE_CASES = (
    (r'""(?!\w)', "empty string"), (r"''(?!\w)", "empty string"), (r"\bNone\b", "None/null input"), (r"\b0\b(?!\.\d)", "zero value"),
    (r"-\d+", "negative number"), (r"boundary|edge|limit|overflow|underflow", "boundary condition"), (r"max_|min_|MAX|MIN", "min/max values"),
    (r"special.*char|[<>&\"'\\]", "special characters"), (r"\*\s*\d{3,}|10{5,}|\"a\"\s*\*", "large/long input"),
    (r"empty|blank|whitespace", "empty/blank handling"), (r"unicode|utf|\\u[0-9a-f]", "unicode characters"), (r"\[\s*\]", "empty list/array"),
    (r"\{\s*\}", "empty dict/object"), (r"\\n|\\r|\\t", "control characters"), (r"float\(|inf|nan|NaN", "float edge cases"),
)


def edge_case_tags(code: Column) -> Column:
    """Names of the edge cases that a test's text shows, each once, in the order of the table."""
    return F.array_distinct(F.array_compact(F.array(*(F.when(code.rlike(f"(?i){p}"), F.lit(n)) for p, n in EDGE_CASES))))


SWALLOWED = r"except\s*.*:\s*\n\s*pass"
CLASS = r"(?m)^class\s+\w+"


def anti_patterns(code: Column) -> Column:
    """What a test should not do, as notes."""
    def number(pattern: str) -> Column:
        return F.size(F.regexp_extract_all(code, F.lit(pattern), F.lit(0)))

    modules = F.regexp_extract_all(code, F.lit(r"(?m)^(?:from\s+|import\s+)(subprocess|socket|http\.client|urllib\.request|sqlite3)\b"), F.lit(1))
    prints = number(r"(?m)^\s+print\s*\(")
    return F.array_compact(
        F.array(
            F.when(number(SWALLOWED) > 0, F.format_string("try/except pass swallows errors (x%d)", number(SWALLOWED))),
            F.when(code.rlike(CLASS), F.lit("Contains class definition (not allowed)")),
            F.when(F.size(modules) > 0, F.concat(F.lit("Imports real modules instead of using mocks: "), F.array_join(F.array_sort(F.array_distinct(modules)), ", "))),
            F.when(code.rlike(r"while\s+True:"), F.lit("while True loop (potential hang)")),
            F.when(code.contains("time.sleep"), F.lit("time.sleep() in tests (slows execution)")),
            F.when(prints >= 3, F.format_string("Excessive print statements (%d) instead of assertions", prints)),
        )
    )


def practices(code: Column) -> Column:
    """Struct of six flags of how a test uses pytest."""
    return F.struct(
        code.contains("pytest.raises").alias("pytest_raises"), code.rlike(r"with\s+pytest\.raises\s*\(").alias("pytest_raises_context"),
        code.rlike(r"(?m)^import\s+pytest\s*$").alias("redundant_import_pytest"), code.contains("@pytest.fixture").alias("has_fixture"),
        code.contains("@pytest.mark.parametrize").alias("parametrize"), code.contains(".reset()").alias("mock_reset"),
    )


def _steps(value: Column, *steps: tuple[float, int]) -> Column:
    """Points of the first step that a value reaches, 0 below all."""
    out = F.lit(0)
    for least, points in reversed(steps):
        out = F.when(value >= least, points).otherwise(out)
    return out


def quality_score(tests: DataFrame, mocks: dict[str, list[str]] | None = None, wrong: dict[str, list[str]] | None = None) -> DataFrame:
    """id, score, assertions, edge_cases, follows_practices, confidence of tests (id, cwe, entry_point, tests).

    Seven sections of points: tests, assertions, use of pytest, structure, edge cases, mocks (of
    the weakness, and such that are another's) and calls of the target; together a share of 100.
    Blank tests score 0 with confidence 1.
    """
    from sievekit.operators.similarity import test_functions

    code = F.coalesce("tests", F.lit(""))
    rows = tests.select("id", "cwe", "entry_point", code.alias("code"), test_functions(code).alias("f"))
    rows = rows.withColumns({"a": assertion_counts(F.col("code")), "p": practices(F.col("code")), "edges": F.size(edge_case_tags(F.col("code")))})
    code, f, a, p = (F.col(c) for c in ("code", "f", "a", "p"))
    n = F.size(f["functions"])

    def share(items: Column, part: float) -> Column:
        return (n > 0) & (items >= n * part)

    points = _steps(n, (5, 15), (4, 12), (3, 10), (2, 7), (1, 3))
    points = F.greatest(points - F.least(f["duplicates"] * 5, F.lit(15)), F.lit(0))
    asserted = _steps(a["total"], (8, 25), (5, 20), (3, 15), (1, 8))
    asserted = F.when((a["total"] > 0) & (a["with_messages"] >= a["total"] * 0.5), F.least(asserted + 5, F.lit(30))).otherwise(asserted)
    for lost in (
        a["assert_true"] * 10, a["assert_false"] * 3,
        F.when((a["total"] > 0) & (a["is_not_none"] >= a["total"] * 0.6), 5).otherwise(0), a["tautology"] * 10,
    ):
        asserted = F.greatest(asserted - lost, F.lit(0))
    used = F.when(p["pytest_raises"], 5).otherwise(0) + F.when(p["pytest_raises_context"], 5).otherwise(0) + F.when(p["redundant_import_pytest"], 0).otherwise(3)
    has_class = code.rlike(CLASS)
    used = F.least(F.when(has_class, F.greatest(used - 5, F.lit(0))).otherwise(used), F.lit(15))
    documented = F.size(F.filter(f["functions"], lambda x: x["documented"]))
    telling = F.size(F.filter(f["functions"], lambda x: F.length(x["name"]) > 15))
    built = F.when(share(documented, 0.6), 8).when(documented > 0, 4).when(code.contains("# "), 3).otherwise(0)
    built = built + F.when(share(telling, 0.5), 7).when(telling > 0, 3).otherwise(0)
    built = F.least(F.when(code.rlike(SWALLOWED), F.greatest(built - 5, F.lit(0))).otherwise(built), F.lit(15))
    mocked = F.when(p["mock_reset"], 5).otherwise(0)
    for cwe, names in sorted((mocks or {}).items()):
        hit = reduce(lambda x, y: x | y, (code.contains(m) for m in names), F.lit(False))
        mocked = F.when((F.col("cwe") == cwe) & hit, mocked + 5).otherwise(mocked)
    for cwe, names in sorted((wrong or {}).items()):
        hit = reduce(lambda x, y: x | y, (code.rlike(rf"\b{m}\.") for m in names), F.lit(False))
        mocked = F.when((F.col("cwe") == cwe) & hit, F.greatest(mocked - 5, F.lit(0))).otherwise(mocked)
    target = F.coalesce(F.nullif("entry_point", F.lit("")), entry_point(code), F.lit(""))
    callers = F.size(F.filter(f["functions"], lambda x: F.contains(x["body"], target)))
    called = (
        F.when(target == "", 5).when(~F.contains(code, target), -5)
        .when((callers >= n * 0.5) & (callers > 0), 10).when(callers > 0, 5).otherwise(0)
    )
    total = points + asserted + used + built + _steps(F.col("edges"), (4, 10), (2, 5), (1, 3)) + F.least(mocked, F.lit(10)) + called
    blank = code.rlike(r"^\s*$")
    sure = F.least(F.lit(0.5) + n * 0.05 + a["total"] * 0.02 + F.col("edges") * 0.03, F.lit(1.0))
    return rows.select(
        "id", F.when(blank, 0.0).otherwise(F.round(F.greatest(F.least(total / 100.0, F.lit(1.0)), F.lit(0.0)), 2)).alias("score"),
        F.when(blank, 0).otherwise(a["total"]).alias("assertions"), F.when(blank, 0).otherwise(F.col("edges")).alias("edge_cases"),
        (~blank & p["pytest_raises"] & (a["assert_true"] == 0) & ~has_class).alias("follows_practices"),
        F.when(blank, 1.0).otherwise(F.round(sure, 2)).alias("confidence"),
    )


#: Words of security that an assertion may name: fixed values.
SECURITY_WORDS = (
    "injection", "inject", "vulnerable", "vuln", "exploit", "malicious", "attack", "payload", "unsafe", "insecure", "security", "sanitiz",
    "escape", "xss", "sqli", "ssrf", "traversal", "bypass", "unauthorized", "permission", "auth", "hardcoded", "weak", "sensitive", "leak",
    "expos", "parameterized", "shell", "eval", "pickle", "deserializ", "csrf", "redirect", "certificate", "encrypt", "hash", "random",
    "secret", "token", "credential",
)
#: Lines that check nothing, and exceptions that a test of security expects: fixed values.
EMPTY_CHECKS = (
    r"(?m)^\s*assert\s+True\s*$", r"(?m)^\s*assert\s+False\s*$", r"(?m)^\s*assert\s+result\s+is\s+not\s+None\s*$",
    r"(?m)^\s*assert\s+result\s*$", r"(?m)^\s*assert\s+1\s*==\s*1", r"(?m)^\s*pass\s*$",
)
EXCEPTIONS = ("ValueError", "PermissionError", "SecurityError", "AuthenticationError", "AuthorizationError", "Forbidden", "Unauthorized")


@dataclass(frozen=True)
class SecurityRules:
    """By weakness: attack patterns with their names, how many are expected, mocks with attributes, right and wrong assertions."""

    attacks: dict[str, list[tuple[str, str]]] = field(default_factory=dict)
    least: dict[str, int] = field(default_factory=dict)
    mocks: dict[str, dict[str, list[str]]] = field(default_factory=dict)
    right: dict[str, list[str]] = field(default_factory=dict)
    wrong: dict[str, list[str]] = field(default_factory=dict)

    @classmethod
    def from_json(cls, text: str) -> SecurityRules:
        """Rules from an object with the five fields."""
        return cls(**json.loads(text))


def _of_cwe(cwe: Column, table: dict, value: Callable[[object], Column], default: Column) -> Column:
    out = default
    for name, entry in sorted(table.items()):
        out = F.when(cwe == name, value(entry)).otherwise(out)
    return out


def security_checks(code: Column, cwe: Column, rules: SecurityRules) -> dict[str, Column]:
    """Attacks found, mocks used and expected, assertions of right and wrong polarity, and those that name security."""
    none, zero = F.array().cast("array<string>"), F.lit(0)

    def named(pairs: list) -> Column:
        return F.array_compact(F.array(*(F.when(code.rlike(f"(?i){p}"), F.lit(n)) for p, n in pairs)))

    def number(texts: list) -> Column:
        return reduce(lambda x, y: x + y, (code.contains(t).cast("int") for t in texts), zero)

    words = "|".join(SECURITY_WORDS)
    lines = _stripped(code)
    return {
        "attacks": _of_cwe(cwe, rules.attacks, named, none),
        "least": _of_cwe(cwe, rules.least, F.lit, F.lit(1)),
        "mocks_used": _of_cwe(cwe, rules.mocks, lambda m: number(list(m)), zero),
        "mocks_expected": _of_cwe(cwe, rules.mocks, lambda m: F.lit(len(m)), zero),
        "right": _of_cwe(cwe, rules.right, number, zero), "wrong": _of_cwe(cwe, rules.wrong, number, zero),
        "security_asserts": F.size(F.filter(lines, lambda x: (x.startswith("assert ") | x.contains("pytest.fail")) & F.lower(x).rlike(words))),
    }


def test_assertions(code: Column) -> Column:
    """Lines that assert or fail, and those with pytest.raises besides."""
    lines = _stripped(code)
    own = F.size(F.filter(lines, lambda x: x.startswith("assert ") | x.contains("pytest.fail")))
    return own + F.size(F.filter(lines, lambda x: x.contains("pytest.raises")))


def security_score(tests: DataFrame, rules: SecurityRules) -> DataFrame:
    """id, score, cwe_addressed, attacks, confidence of tests (id, cwe, cwe_name, secure_code, tests).

    Points for attacks, mocks (or, where none are expected, looking at source or expecting
    exceptions), assertions of the right polarity and calls of the target, less those for empty
    checks; together a share of 100. Blank tests score 0 with confidence 1.
    """
    from sievekit.operators.similarity import test_functions

    code = F.coalesce("tests", F.lit(""))
    rows = tests.select("id", "cwe", "cwe_name", entry_point(F.col("secure_code")).alias("target"), code.alias("code"), test_functions(code).alias("f"))
    rows = rows.withColumns(security_checks(F.col("code"), F.col("cwe"), rules))
    code, n = F.col("code"), F.size("f.functions")
    found = F.size("attacks")
    tried = F.when(found >= F.greatest(F.lit(3), F.col("least") + 1), 35).when(found >= F.col("least"), 25).when(found >= 1, 15).otherwise(0)

    def holds(*words: str) -> Column:
        return reduce(lambda x, y: x | y, (code.contains(w) for w in words))

    inspects = holds("inspect.getsource", "inspect.getmodule", "re.search", "re.findall", "re.match") & holds("source", "code", "module")
    mocked = (
        F.when(F.col("mocks_expected") > 0, F.when(F.col("mocks_used") == F.col("mocks_expected"), 25).when(F.col("mocks_used") > 0, 15).otherwise(0))
        .when(inspects, 20).when(holds(*EXCEPTIONS, "pytest.raises"), 18).otherwise(5)
    )
    polar = _steps(F.col("right"), (2, 15), (1, 10)) + _steps(F.col("security_asserts"), (3, 10), (1, 5)) - F.col("wrong") * 5
    callers = F.when(F.coalesce("target", F.lit("")) == "", n).otherwise(F.size(F.filter("f.functions", lambda x: F.contains(x["body"], F.col("target")))))
    aims = (F.col("mocks_used") > 0) | (found >= 1)
    detects = F.when((callers > 0) & aims & (F.col("right") >= 1), 15).when((callers > 0) & aims, 10).when(callers > 0, 5).when(n > 0, 2).otherwise(0)
    words = F.filter(F.split(F.lower("cwe_name"), r"\s+"), lambda w: F.length(w) > 3)
    addressed = (
        F.contains(code, F.col("cwe")) | F.contains(code, F.replace(F.col("cwe"), F.lit("CWE-"), F.lit("")))
        | F.coalesce(F.exists(words, lambda w: F.contains(F.lower(code), w)), F.lit(False)) | (found >= 1) | (F.col("right") >= 1) | (F.col("mocks_used") >= 1)
    )
    detects = F.when(addressed, F.greatest(detects, F.lit(5))).otherwise(detects)
    empty = reduce(lambda x, y: x + y, (code.rlike(p).cast("int") for p in EMPTY_CHECKS))
    total = F.greatest(tried + mocked + F.greatest(F.least(polar, F.lit(25)), F.lit(0)) + detects - empty * 4, F.lit(0))
    evidence = found + F.col("mocks_used") + F.col("right") + F.col("security_asserts") + (callers > 0).cast("int")
    blank = code.rlike(r"^\s*$")
    return rows.select(
        "id", F.when(blank, 0.0).otherwise(F.round(F.least(total / 100.0, F.lit(1.0)), 2)).alias("score"),
        (~blank & addressed).alias("cwe_addressed"), F.when(blank, F.array().cast("array<string>")).otherwise(F.slice("attacks", 1, 6)).alias("attacks"),
        F.when(blank, 1.0).otherwise(F.round(F.least(F.lit(0.5) + evidence * 0.05, F.lit(1.0)), 2)).alias("confidence"),
    )


#: Assertions that always hold: fixed values.
ALWAYS_TRUE = (
    r"assert\s+True\b", r"assert\s+result\s+is\s+not\s+None\s+or\s+result\s+is\s+None", r"assert\s+1\s*==\s*1",
    r"assert\s+[\"'].*[\"']\s*$",
)


def has_real_assertion(tests: Column) -> Column:
    """Whether an assertion, comments and docstrings aside, says more than what always holds."""
    bare = F.regexp_replace(tests, r"(?m)#.*$", "")
    bare = F.regexp_replace(bare, r"(?s)\"\"\".*?\"\"\"|'''.*?'''", "")
    found = F.regexp_extract_all(bare, F.lit(r"assert\s+[^,\n]+"), F.lit(0))
    always = "(?i)" + "|".join(ALWAYS_TRUE)
    return F.coalesce(F.exists(found, lambda a: ~F.trim(a).rlike(always)), F.lit(False))
