"""Findings of static tools: parsing, detection, summaries and comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievekit.operators.metrics import improvement, ratio

BANDIT = "results array<struct<test_id string, test_name string, issue_severity string, issue_confidence string, line_number int, issue_text string>>"


def normalise_cwe(raw: Column) -> Column:
    """CWE-0*(n) at the start as CWE-n, anything else unchanged."""
    return F.when(raw.rlike(r"^CWE-0*\d+"), F.concat(F.lit("CWE-"), F.regexp_extract(raw, r"^CWE-0*(\d+)", 1))).otherwise(raw)


def tool_cwe(raw: Column) -> Column:
    """A tool's mention of a CWE: the first CWE-n as it stands, or a bare number; else null."""
    named = F.nullif(F.regexp_extract(raw, r"(CWE-\d+)", 1), F.lit(""))
    bare = F.concat(F.lit("CWE-"), F.nullif(F.regexp_extract(raw, r"^\s*(\d+)\s*$", 1), F.lit("")))
    return F.coalesce(named, bare)


SEMGREP = "results array<struct<check_id string, path string, start struct<line int>, extra struct<severity string, message string, metadata struct<cwe: string>>>>"


def parse_semgrep(rows: DataFrame, column: str = "json", keep: tuple[str, ...] = ("sample_id",)) -> DataFrame:
    """rule, message, severity, line, cwe of each finding; metadata's cwe may be a text or a list, whose first one counts."""
    listed = SEMGREP.replace("cwe: string", "cwe: array<string>")
    both = rows.select(*keep, F.arrays_zip(F.from_json(column, SEMGREP)["results"].alias("a"), F.from_json(column, listed)["results"].alias("b")).alias("z"))
    f = both.select(*keep, F.explode("z").alias("f"))
    raw = F.coalesce(F.get(F.col("f.b.extra.metadata.cwe"), 0), F.col("f.a.extra.metadata.cwe"))
    return f.select(
        *keep, F.col("f.a.check_id").alias("rule"), F.col("f.a.extra.message").alias("message"),
        F.col("f.a.extra.severity").alias("severity"), F.col("f.a.start.line").alias("line"), tool_cwe(raw).alias("cwe"),
    )


def rule_summary(rows: DataFrame) -> DataFrame:
    """By cwe: samples, detections in insecure and secure code, both rates and the distinct rules.

    rows: cwe, secure_hit, insecure_hit, rules (array). A tool that failed on the secure code
    (null) counts as a sample without any detection.
    """
    n = F.count("*")
    ran = F.col("secure_hit").isNotNull()
    insecure, secure = F.count_if(ran & F.col("insecure_hit")), F.count_if(F.col("secure_hit"))
    counts = rows.groupBy(F.coalesce("cwe", F.lit("unknown")).alias("cwe")).agg(
        n.alias("total"), secure.alias("detected_secure"), insecure.alias("detected_insecure"),
        ratio(insecure, n).alias("detection_rate"), ratio(secure, n).alias("false_positive_rate"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.when(ran, F.col("rules")))))).alias("rules"),
    )
    return counts


def parse_bandit(rows: DataFrame, column: str = "json", keep: tuple[str, ...] = ("sample_id",)) -> DataFrame:
    """A row for each finding of a tool's JSON report; broken reports give none."""
    return rows.select(*keep, F.explode(F.from_json(column, BANDIT)["results"]).alias("f")).select(*keep, "f.*")


def detections(samples: DataFrame, findings: DataFrame) -> DataFrame:
    """sample_id, cwe, and whether each tool and any tool found its cwe."""
    hits = findings.select("sample_id", "cwe", "tool").distinct()
    joined = samples.select("sample_id", "cwe").join(hits, ["sample_id", "cwe"], "left")
    return joined.groupBy("sample_id", "cwe").agg(
        F.coalesce(F.bool_or(F.col("tool") == "bandit"), F.lit(False)).alias("bandit"),
        F.coalesce(F.bool_or(F.col("tool") == "semgrep"), F.lit(False)).alias("semgrep"),
        F.bool_or(F.col("tool").isNotNull()).alias("detected"),
    )


def summary(found: DataFrame, static: list[str], *keys: str) -> DataFrame:
    """Detected, totals and rates by cwe, with its class."""
    total, hit = F.count("*"), F.count_if("detected")
    return found.groupBy("cwe").agg(
        total.alias("total"), hit.alias("detected"), ratio(hit, total).alias("rate"),
        F.count_if("bandit").alias("by_bandit"), F.count_if("semgrep").alias("by_semgrep"),
    ).withColumn("kind", F.when(F.col("cwe").isin(*static), "static").otherwise("dynamic"))


def compare(found: DataFrame, results: DataFrame) -> DataFrame:
    """Detection rates of tools and tests with absolute and relative gain: one row."""
    a = found.agg(F.avg(F.col("detected").cast("int")).alias("static_rate"))
    b = results.agg(F.avg(F.col("vuln_detected").cast("int")).alias("test_rate"))
    absolute, relative = improvement(F.col("static_rate"), F.col("test_rate"))
    return a.crossJoin(b).select("static_rate", "test_rate", absolute.alias("absolute"), relative.alias("relative"))


def rules_by_cwe(findings: DataFrame) -> DataFrame:
    """Distinct rules of each cwe, as text."""
    return findings.groupBy("cwe").agg(F.array_join(F.sort_array(F.collect_set("rule")), ",").alias("rules"), F.count("*").alias("n"))


def detectability(insecure: Column, secure: Column) -> tuple[Column, Column]:
    """Whether a tool finds the weakness, and whether the fix takes findings away (numbers of findings)."""
    return insecure > 0, (insecure > 0) & (secure < insecure)


def finding_matches(findings: Column, keywords: list[str], cwe: Column, strict: bool = False) -> Column:
    """Whether a keyword or the cwe occurs in any finding (array of rule, message, cwe); not strict: any finding does."""
    words = F.lit(False)

    def hit(x: Column) -> Column:
        text = F.lower(F.concat_ws(" ", x["rule"], x["message"]))
        found = words
        for k in keywords:
            found = found | text.contains(k)
        return found | (x["cwe"] == cwe)

    matched = F.exists(findings, hit)
    return matched if strict else matched | (F.size(findings) > 0)
