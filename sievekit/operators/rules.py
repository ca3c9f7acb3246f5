"""Rules over code text: snippets, context, parameters, API tags, patterns and weighted coverage."""

from __future__ import annotations

import textwrap
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Texts that no Python has, and signs of Python.
FOREIGN = ('system("', "`", "$_", "@_", "my $", "#!/bin/bash", "#!/bin/sh", "getcwd()", 'print "')
PYTHON = (
    r"\bdef\s+\w+\s*\(", r"\bimport\s+\w+", r"\bfrom\s+\w+\s+import", r"\bif\s+.*:", r"\bfor\s+\w+\s+in\s+", r"\bwhile\s+.*:", r"\breturn\s+",
    r"\bclass\s+\w+", r"print\s*\(", r"\bwith\s+\w+",
)
# Names that a snippet takes from the file around it, and those that must be its own.
CONTEXT = (
    r"\bconfig\.\w+", r"\bsettings\.\w+", r"\bCONFIG\[", r"\b(src_dir|dest_dir|work_dir|base_dir|root_dir|output_dir)\b",
    r"\b(test_dir|build_dir|data_dir|log_dir|tmp_dir)\b", r"\b(build_cmd|run_cmd|exec_cmd|shell_cmd)\b", r"\b(dep_dir|lib_dir|bin_dir)\b",
    r"\brev\b(?!\s*=)", r"\bcloud_function\b", r"\bfunction_names\b", r"\b(db_conn|connection|cursor)\b(?!\s*=)", r"\blogger\.\w+",
    r"\bp\.readline", r"\bf\.read", r"\blsfJobID\b", r"\bjob\s*,\s*task\s*=", r"^print\s+[\"'][^\"']+[\"']\s*$",
)
SETTINGS = ("config", "settings", "options", "args", "params")
#: Patterns counted by family of weaknesses: (text, what it is called), fixed values.
FAMILIES = (
    (("CWE-89",), (("execute(", "cursor.execute()"), ("SELECT ", "SQL SELECT"), ("INSERT ", "SQL INSERT"), ("query(", "query()"), ("raw(", "raw SQL"), ("%s", "%s placeholder"), ("?", "? placeholder"))),
    (("CWE-78", "CWE-77"), (("subprocess", "subprocess module"), ("os.system", "os.system()"), ("os.popen", "os.popen()"), ("shell=True", "shell=True"), ("Popen", "Popen"), ("call(", "subprocess.call()"), ("run(", "subprocess.run()"))),
    (("CWE-79",), (("escape", "escape function"), ("sanitize", "sanitize function"), ("render", "render template"), ("html", "html processing"))),
)
#: Weight of an attack by its importance, others 1: fixed values.
IMPORTANCE = {"critical": 3.0, "high": 2.0, "medium": 1.0, "low": 0.5}


def _any(hits: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, hits, F.lit(False))


def is_python_snippet(code: Column) -> Column:
    """Whether a text has signs of Python and none of other languages; null and blank texts don't."""
    given = F.coalesce(code, F.lit(""))
    return (F.trim(given) != "") & ~_any([given.contains(x) for x in FOREIGN]) & _any([given.rlike(x) for x in PYTHON])


def python_snippets(rows: DataFrame, column: str = "code") -> DataFrame:
    """Rows whose text looks like Python."""
    return rows.where(is_python_snippet(F.col(column)))


def lacks_context(code: Column) -> Column:
    """Whether a snippet uses names that only the file around it can have given."""
    given = F.coalesce(code, F.lit(""))

    def undefined(name: str) -> Column:
        own = given.rlike(rf"(?m)^\s*{name}\s*=") | given.rlike(rf"def\s+\w+\s*\([^)]*\b{name}\b")
        return given.rlike(rf"\b{name}\b") & ~own

    return _any([given.rlike(x) for x in CONTEXT]) | _any([undefined(x) for x in SETTINGS])


def whole_snippets(rows: DataFrame, column: str = "code") -> DataFrame:
    """Rows that are Python and bring their names along."""
    return rows.where(is_python_snippet(F.col(column)) & ~lacks_context(F.col(column)))


def parameters(code: Column, name: Column) -> Column:
    """Names of a function's parameters, without self, cls and starred ones; empty if it isn't there."""
    text = F.coalesce(F.get(F.regexp_extract_all(code, F.concat(F.lit(r"def\s+\Q"), name, F.lit(r"\E\s*\(([^)]*)\)")), F.lit(1)), 0), F.lit(""))
    names = F.transform(F.split(text, ","), lambda p: F.trim(F.substring_index(F.substring_index(F.regexp_replace(p, r"\s+", " "), "=", 1), ":", 1)))
    return F.filter(names, lambda p: (p != "") & ~p.isin("self", "cls") & ~p.startswith("*"))


def call_arguments(tests: Column, name: Column) -> Column:
    """Arguments of the first plain call of a function in its tests; -1 without any."""
    found = F.get(F.regexp_extract_all(tests, F.concat(F.lit(r"(?<!def )\b\Q"), name, F.lit(r"\E\(([^()]*)\)")), F.lit(1)), 0)
    return F.when(found.isNull(), F.lit(-1)).when(F.trim(found) == "", F.lit(0)).otherwise(F.size(F.split(found, ",")))


@F.pandas_udf(T.StringType())
def dedented(code: pd.Series) -> pd.Series:
    """Code without the white space that all its lines share, and without blank lines before it."""

    def one(text: str | None) -> str | None:
        if text is None or not text.strip():
            return text
        lines = textwrap.dedent(text).split("\n")
        while lines and not lines[0].strip():
            lines.pop(0)
        return "\n".join(lines)

    return code.map(one)


def preprocessed(code: Column) -> Column:
    """Dedented code with print statements of the old kind as calls."""
    out = F.regexp_replace(dedented(code), r"\bprint\s+([\"'][^\"']*[\"'])", r"print($1)")
    out = F.regexp_replace(out, r"(?m)\bprint\s+(\w+)\s*$", r"print($1)")
    return F.regexp_replace(out, r"\bprint\s+(\w+)\s*,", r"print($1,")


def api_tags(code: Column, patterns: dict[str, dict[str, list[str]]]) -> Column:
    """Map of category to the APIs whose patterns a text has, whatever the case, in the order of the table."""
    entries = []
    for category, apis in patterns.items():
        hits = F.array_compact(F.array(*(F.when(code.rlike("(?i)" + "|".join(f"(?:{p})" for p in ps)), F.lit(api)) for api, ps in apis.items())))
        entries.append(F.struct(F.lit(category).alias("category"), hits.alias("apis")))
    return F.map_from_entries(F.filter(F.array(*entries), lambda e: F.size(e["apis"]) > 0))


def primary_api(tags: Column, cwe: Column, categories: dict[str, str]) -> Column:
    """The first API of the category that a weakness is about; null without any."""
    out = F.lit(None).cast("string")
    for name, category in sorted(categories.items()):
        out = F.when(cwe == name, F.get(F.try_element_at(tags, F.lit(category)), 0)).otherwise(out)
    return out


def pattern_histogram(samples: DataFrame, families: tuple = FAMILIES) -> DataFrame:
    """cwe, pattern, n: samples (cwe, code) of each family of weaknesses that have each of its patterns."""
    found = F.array().cast("array<string>")
    for cwes, patterns in reversed(families):
        hits = F.array_compact(F.array(*(F.when(F.col("code").contains(text), F.lit(name)) for text, name in patterns)))
        found = F.when(_any([F.col("cwe").contains(c) for c in cwes]), hits).otherwise(found)
    return samples.select("cwe", F.explode(found).alias("pattern")).groupBy("cwe", "pattern").agg(F.count("*").alias("n"))


def attack_coverage(tests: DataFrame, attacks: DataFrame) -> DataFrame:
    """id, coverage, covered, missing of tests (id, cwe, code) by the attacks of their weakness.

    attacks: cwe, name, importance, patterns; a weakness without any counts as covered. A
    weakness may be given as CWE-n in any case, or as n.
    """
    upper = F.upper("cwe")
    named = tests.select("id", F.when(upper.startswith("CWE-"), upper).otherwise(F.concat(F.lit("CWE-"), upper)).alias("cwe"), F.lower("code").alias("_low"))
    weight = F.lit(1.0)
    for name, value in IMPORTANCE.items():
        weight = F.when(F.col("importance") == name, value).otherwise(weight)
    table = attacks.select("cwe", F.struct("name", weight.alias("weight"), F.transform("patterns", lambda p: F.lower(p)).alias("patterns")).alias("a"))
    by_cwe = table.groupBy("cwe").agg(F.collect_list("a").alias("attacks"))
    rows = named.join(by_cwe, "cwe", "left")
    hit = F.transform("attacks", lambda a: F.struct(a["name"].alias("name"), a["weight"].alias("weight"), F.exists(a["patterns"], lambda p: F.contains(F.col("_low"), p)).alias("hit")))

    def total(items: Column) -> Column:
        return F.aggregate(items, F.lit(0.0), lambda acc, a: acc + a["weight"])

    rows = rows.withColumn("_hit", hit)
    covered = F.filter("_hit", lambda a: a["hit"])
    return rows.select(
        "id", F.coalesce(total(covered) / F.nullif(total(F.col("_hit")), F.lit(0.0)), F.when(F.col("attacks").isNull(), 1.0).otherwise(0.0)).alias("coverage"),
        F.array_sort(F.transform(covered, lambda a: a["name"])).alias("covered"),
        F.array_sort(F.transform(F.filter("_hit", lambda a: ~a["hit"]), lambda a: a["name"])).alias("missing"),
    )


def payloads_or_default(samples: DataFrame, payloads: DataFrame, default: list[str], most: int) -> DataFrame:
    """id and payloads of samples (id, cwe): the first of their weakness's (cwe, payloads), else of the default."""
    return samples.join(payloads.withColumnRenamed("payloads", "_p"), "cwe", "left").select(
        "id", F.slice(F.coalesce("_p", F.array(*map(F.lit, default))), 1, most).alias("payloads")
    )
