"""Scalar functions over names, ids and display text."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def short_hash(text: Column, digits: int, algorithm: str = "md5") -> Column:
    """The first hexadecimal digits of a text's hash."""
    data = text.cast("binary")
    return F.substring(F.md5(data) if algorithm == "md5" else F.sha2(data, 256), 1, digits)


def mutant_id(operator: Column, code: Column) -> Column:
    """Eight digits over operator and code."""
    return short_hash(F.concat(operator, F.lit(":"), code), 8)


def hashed_identifier(name: Column) -> Column:
    """A name made of the hash of another."""
    return F.concat(F.lit("var_"), short_hash(name, 6))


def model_name(name: Column, provider: Column | None = None) -> Column:
    """A model's name as a folder: up to the first bracket, colons and slashes as _, no blanks; then its provider if there is one."""
    bare = F.trim(F.substring_index(name, "[", 1))
    clean = F.regexp_replace(F.translate(bare, ":/", "__"), " ", "")
    if provider is None:
        return clean
    return F.when(F.coalesce(provider, F.lit("")) == "", clean).otherwise(F.concat(clean, F.lit("_"), provider))


def truncate(code: Column, lines: int = 30, chars: int = 1500) -> Column:
    """The first lines and characters, with a note of what is cut."""
    parts = F.split(code, "\n")
    more = F.concat(F.lit("\n... ("), (F.size(parts) - lines).cast("string"), F.lit(" more lines)"))
    cut = F.when(F.size(parts) > lines, F.concat(F.array_join(F.slice(parts, 1, lines), "\n"), more)).otherwise(code)
    return F.when(F.length(cut) > chars, F.concat(F.substring(cut, 1, chars), F.lit("\n... (truncated)"))).otherwise(cut)


#: What a description of a check that is left without effect says: fixed values.
DEAD = ("pass instead of raise", "dead check", "(dead ")


def variant_type(description: Column) -> Column:
    """pass_variant for a check that is left without effect, else removal."""
    low = F.lower(description)
    dead = F.lit(False)
    for words in DEAD:
        dead = dead | low.contains(words)
    return F.when(dead, "pass_variant").otherwise("removal")


def difficulty(score: Column) -> Column:
    """easy up to 20, medium up to 50, else hard."""
    return F.when(score <= 20, "easy").when(score <= 50, "medium").otherwise("hard")


#: Prompts by kind, with the slots that each fills; a production text comes as a parameter.
PROMPTS = {
    "no_hint": "Write pytest tests for {entry_point}.\n```python\n{code}\n```\nAnswer with test functions only.",
    "cwe_id": "Write pytest security tests for {entry_point}; its weakness would be {cwe}.\n```python\n{code}\n```\nAnswer with test functions only.",
    "full": "Write pytest security tests against {cwe} ({cwe_name}).\n{mock_env}\nAttacks to try:\n{attacks}\n```python\n{code}\n```\nAnswer with test functions only.",
    "no_mocks": "Write pytest security tests against {cwe} ({cwe_name}).\nAttacks to try:\n{attacks}\n```python\n{code}\n```\nAnswer with test functions only.",
    "judge_security": "Do these tests find {cwe} ({cwe_name})?\n```python\n{code}\n```\n```python\n{tests}\n```\nAttacks to expect:\n{attacks}\nAnswer in JSON.",
    "judge_quality": "How good are these tests of {entry_point} ({cwe}, {difficulty})?\n```python\n{tests}\n```\n{mock_env}\nAnswer in JSON.",
}
#: What a slot without a value says.
UNSET = {"entry_point": "function", "cwe_name": "vulnerability", "difficulty": "unknown"}


def prompt(kind: str, slots: dict[str, Column], templates: dict[str, str] = PROMPTS) -> Column:
    """A prompt of some kind; a slot that is null or not given takes its value of UNSET, else nothing."""
    parts = re.split(r"\{(\w+)\}", templates[kind])
    return F.concat(*(F.lit(x) if k % 2 == 0 else F.coalesce(slots.get(x, F.lit(None).cast("string")), F.lit(UNSET.get(x, ""))) for k, x in enumerate(parts)))


def cwe_number(cwe: Column) -> Column:
    """The number of CWE-n, for sorting; null for other texts."""
    return F.nullif(F.regexp_extract(cwe, r"(\d+)", 1), F.lit("")).cast("int")


def concat_fragments(fragments: Column) -> Column:
    """Code fragments without empty ones and trailing white space, a line feed between."""
    trimmed = F.transform(fragments, lambda x: F.rtrim(F.coalesce(x, F.lit(""))))
    return F.array_join(F.filter(trimmed, lambda x: x != ""), "\n")


def weighted_coverage(covered: Column, critical: Column) -> Column:
    """Share of weights covered; arrays of booleans and of weights; 1.0 where there is nothing to cover."""
    total = F.aggregate(critical, F.lit(0.0), lambda a, x: a + x)
    hit = F.aggregate(F.zip_with(covered, critical, lambda c, w: F.when(c, w).otherwise(0.0)), F.lit(0.0), lambda a, x: a + x)
    return F.when(total > 0, hit / total).otherwise(F.lit(1.0))
