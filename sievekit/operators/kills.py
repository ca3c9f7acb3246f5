"""Layered classification of failing tests.

Rules are data, a row an operator: regular expressions (layer operator_keyword), literal
payloads (attack_payload) and mock attributes (mock_observability). They are read from a file
or given as a table, and joined with the errors by operator.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the classification.
CRASH_NAMES = (
    "ImportError", "TypeError", "NameError", "SyntaxError", "AttributeError", "IndentationError", "ModuleNotFoundError",
    "RecursionError", "MemoryError", "OverflowError", "UnicodeDecodeError",
)
CRASH_FRAGMENTS = (
    "failed to execute target code", "failed to parse test code", "unterminated string", "f-string:", "invalid syntax",
    "unexpected eof", "expected ':'", "expected ')'", "expected '}'", "error collecting", "errors ===", "importtestmodule",
    "_gcd_import", "_find_and_load", "_load_unlocked", "frozen importlib", "unexpected indent", "unindent does not match",
)
GENERIC = (
    "inject", "malicious", "attack", "vulnerability", "secure", "unsafe", "dangerous", "tainted", "exploit", "bypass",
    "unauthorized",
)
PRIORITY = {"semantic": 5, "functional": 4, "assertion_incidental": 3, "crash": 2, "other": 1}


@dataclass(frozen=True)
class Rules:
    """keywords, payloads: operator -> patterns; mocks: operator -> mock -> attributes."""

    keywords: dict[str, list[str]] = field(default_factory=dict)
    payloads: dict[str, list[str]] = field(default_factory=dict)
    mocks: dict[str, dict[str, list[str]]] = field(default_factory=dict)

    @classmethod
    def from_json(cls, text: str) -> Rules:
        """Rules from an object with the three fields."""
        return cls(**json.loads(text))


RULES_SCHEMA = "operator string, pattern string, payloads array<string>, mocks map<string,array<string>>"
#: Most rows of rules that are broadcast; beyond, they are joined by a shuffle.
MAX_BROADCAST = 10_000


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """The rule table of a JSON file: an object with keywords, payloads (operator -> list) and mocks (operator -> mock -> list)."""
    return rule_table(spark, Rules.from_json(spark.read.text(path, wholetext=True).first()[0]))


def rule_table(spark: SparkSession, rules: Rules) -> DataFrame:
    """operator, pattern (any of its regular expressions), payloads (lower case), mocks."""
    names = sorted({*rules.keywords, *rules.payloads, *rules.mocks})
    rows = [
        (n, "|".join(f"(?:{x})" for x in rules.keywords.get(n, [])) or None, [x.lower() for x in rules.payloads.get(n, [])], {k: sorted(x) for k, x in rules.mocks.get(n, {}).items()})
        for n in names
    ]
    return spark.createDataFrame(rows, RULES_SCHEMA)


def _any(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def with_rules(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """rows (operator) with their operator's pattern, payloads and mocks in a struct _rule; null where it has none."""
    own = rules.select(F.col("operator").alias("_operator"), F.struct("pattern", "payloads", "mocks").alias("_rule"))
    if rules.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST:
        own = F.broadcast(own)
    return rows.join(own, rows["operator"] == F.col("_operator"), "left").drop("_operator")


def _observed(access: Column, mocks: Column) -> Column:
    """Whether a mock's attributes that were read (a map of arrays) are among those of the rules."""
    return F.exists(F.map_keys(mocks), lambda m: F.coalesce(F.arrays_overlap(F.try_element_at(access, m), F.try_element_at(mocks, m)), F.lit(False)))


def classify(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """rows (error, operator, mock_access: map of arrays or null) with kill_type and layer."""

    def said(kind: str, layer: str) -> Column:
        return F.struct(F.lit(kind).alias("kill_type"), F.lit(layer).alias("layer"))

    def holds(condition: Column) -> Column:
        return F.coalesce(condition, F.lit(False))

    error, rule = F.col("error"), F.col("_rule")
    low = F.lower(error)
    crash = _any([error.contains(n) for n in CRASH_NAMES]) | _any([low.contains(x) for x in CRASH_FRAGMENTS])
    assertion = error.contains("AssertionError") | error.contains("Assertion failed")
    kind = (
        F.when(error.isNull() | (error == ""), said("other", "none"))
        .when(crash, said("crash", "crash"))
        .when(low.contains("did not raise"), said("functional", "functional"))
        .when(~assertion, said("other", "none"))
        .when(holds(_observed(F.col("mock_access"), rule["mocks"])), said("semantic", "mock_observability"))
        .when(holds(F.rlike(low, rule["pattern"])), said("semantic", "operator_keyword"))
        .when(_any([low.contains(x) for x in GENERIC]), said("semantic", "generic_keyword"))
        .when(holds(F.exists(rule["payloads"], lambda x: low.contains(x))), said("semantic", "attack_payload"))
        .otherwise(said("assertion_incidental", "none"))
    )
    return with_rules(rows, rules).withColumn("_kind", kind).select(*(rows[c] for c in rows.columns), "_kind.*")


def priority(kind: Column) -> Column:
    """How strong a kill type is."""
    out = F.lit(0)
    for name, value in PRIORITY.items():
        out = F.when(kind == name, value).otherwise(out)
    return out


def best_kill(tests: DataFrame, *keys: str) -> DataFrame:
    """The strongest kill of each mutant's tests, the first on ties (column seq)."""
    strength = F.struct(priority(F.col("kill_type")), -F.col("seq"))
    best = F.max_by(F.struct("kill_type", "layer", "seq"), strength)
    return tests.groupBy(*keys).agg(best.alias("b")).select(*keys, "b.kill_type", "b.layer", F.col("b.seq").alias("test_seq"))


def first_error(own: Column, tests: Column) -> Column:
    """A mutant's error, or that of its first failing test with one (tests: array of passed, error)."""
    failing = F.filter(tests, lambda t: ~F.coalesce(t["passed"], F.lit(False)) & (F.coalesce(t["error"], F.lit("")) != ""))
    return F.coalesce(F.nullif(own, F.lit("")), F.get(failing, 0)["error"])


def explanation(kind: Column, layer: Column, operator: Column) -> Column:
    """One line that says why a kill counts as what it does."""
    why = (
        F.when(layer == "mock_observability", "test read a security attribute of a mock")
        .when(layer == "operator_keyword", F.concat(F.lit("assertion names what "), operator, F.lit(" breaks")))
        .when(layer == "generic_keyword", "assertion uses a general security term")
        .when(layer == "attack_payload", "assertion shows an attack payload")
        .when(kind == "functional", "expected exception was not raised")
        .when(kind == "crash", "code did not run")
        .when(kind == "assertion_incidental", "assertion without security terms")
        .otherwise("no known error")
    )
    return F.concat_ws(": ", kind, why)


#: Kinds of error by what the message names, whatever the case, the first that fits: fixed values.
ERROR_KINDS = (
    ("syntax", ("syntaxerror", "invalid syntax")), ("import", ("importerror", "modulenotfounderror")), ("name", ("nameerror",)),
    ("type", ("typeerror",)), ("attribute", ("attributeerror",)), ("indentation", ("indentationerror",)), ("timeout", ("timeout",)),
    ("runtime", ("runtimeerror",)), ("other_runtime", ("error", "exception")),
)


def error_category(message: Column) -> Column:
    """The kind of error that a message names, else unknown."""
    low = F.lower(message)
    out = F.lit("unknown")
    for kind, words in reversed(ERROR_KINDS):
        out = F.when(_any([low.contains(w) for w in words]), kind).otherwise(out)
    return F.when(F.coalesce(message, F.lit("")) == "", F.lit("unknown")).otherwise(out)


def test_validity(rows: DataFrame) -> DataFrame:
    """file, category, n: failing tests by kind of error, with totals (nulls)."""
    return rows.withColumn("category", error_category(F.col("error"))).rollup("file", "category").agg(F.count("*").alias("n"))


def mock_hits(mutants: DataFrame, rules: DataFrame) -> DataFrame:
    """Mutants (operator, mock_access: map of arrays) whose tests read a mock's security attribute of their operator."""
    own = with_rules(mutants, rules)
    return own.where(_observed(F.col("mock_access"), F.col("_rule.mocks"))).select(*(mutants[c] for c in mutants.columns))
