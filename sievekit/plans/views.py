"""Adapter views: the test tables in the shape of the engine's entities.

Each view has a Spark function (spark, sf_dir) -> DataFrame and SQL of the same meaning.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sievekit.session import table

KILL_TYPES = ("semantic", "functional", "assertion_incidental", "crash", "other")
LAYERS = ("mock_observability", "operator_keyword", "generic_keyword", "attack_payload")


def sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as samples: id, code, cwe, source, difficulty, ord."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), F.col("text").alias("code"), F.col("lang").alias("cwe"), "source",
        F.when(F.col("n_chars") < 1000, "easy").when(F.col("n_chars") < 5000, "medium").otherwise("hard").alias("difficulty"),
        "n_chars", F.col("doc_id").alias("ord"),
    )


SAMPLE = """v_sample AS (
  SELECT doc_id AS id, text AS code, lang AS cwe, source,
    CASE WHEN n_chars < 1000 THEN 'easy' WHEN n_chars < 5000 THEN 'medium' ELSE 'hard' END AS difficulty,
    n_chars, doc_id AS ord FROM documents)"""


def mutant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as mutants: sample_id, seq, operator, killed, kill_type, layer, category."""
    order = ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", "l_quantity")
    rows = table(spark, sf_dir, "lineitem")
    d = F.round(F.col("l_discount") * 100).cast("int")
    t = F.round(F.col("l_tax") * 100).cast("int")
    kill = F.when(d < 5, "semantic").when(d < 7, "functional").when(d < 9, "assertion_incidental").when(d < 10, "crash").otherwise("other")
    layer = F.when(t < 2, LAYERS[0]).when(t < 5, LAYERS[1]).when(t < 7, LAYERS[2]).otherwise(LAYERS[3])
    return rows.select(
        F.col("l_orderkey").alias("sample_id"),
        F.row_number().over(W.partitionBy("l_orderkey").orderBy(*order)).alias("seq"),
        F.concat("l_returnflag", "l_linestatus").alias("operator"),
        (F.col("l_quantity") > 25).alias("killed"),
        kill.alias("kill_type"),
        F.when(kill == "semantic", layer).otherwise("none").alias("layer"),
        F.when(F.col("l_linenumber") == 1, "cwe_specific").when(F.col("l_linenumber") < 4, "generic").alias("category"),
    )


MUTANT = """v_mutant0 AS (
  SELECT *, CAST(round(l_discount * 100) AS INT) AS d, CAST(round(l_tax * 100) AS INT) AS t,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate, l_quantity) AS seq
  FROM lineitem),
v_mutant1 AS (
  SELECT *, CASE WHEN d < 5 THEN 'semantic' WHEN d < 7 THEN 'functional' WHEN d < 9 THEN 'assertion_incidental'
    WHEN d < 10 THEN 'crash' ELSE 'other' END AS kill_type FROM v_mutant0),
v_mutant AS (
  SELECT l_orderkey AS sample_id, seq, l_returnflag || l_linestatus AS operator, l_quantity > 25 AS killed, kill_type,
    CASE WHEN kill_type <> 'semantic' THEN 'none' WHEN t < 2 THEN 'mock_observability' WHEN t < 5 THEN 'operator_keyword'
      WHEN t < 7 THEN 'generic_keyword' ELSE 'attack_payload' END AS layer,
    CASE WHEN l_linenumber = 1 THEN 'cwe_specific' WHEN l_linenumber < 4 THEN 'generic' END AS category
  FROM v_mutant1)"""


def result(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as per-sample results, with the mutation score of its mutants."""
    counts = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("sample_id")).agg(
        F.count("*").alias("total"), F.count_if(F.col("l_quantity") > 25).alias("hit")
    )
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("sample_id"), F.col("o_orderpriority").alias("cwe"),
        F.col("o_orderstatus").alias("difficulty"), F.col("o_custkey").alias("owner"),
        (F.col("o_orderkey") % 3 != 0).alias("secure_passes"),
        (F.col("o_totalprice") / 1000000.0).alias("line_coverage"),
        F.concat(F.lit("model-"), (F.col("o_custkey") % 4).cast("string")).alias("model"),
    )
    gate = F.col("secure_passes")
    return rows.join(counts, "sample_id", "left").select(
        "*",
        (gate & (F.col("sample_id") % 2 == 0)).alias("vuln_detected"),
        gate.alias("mutation_attempted"),
        F.when(gate, F.col("hit") * 1.0 / F.col("total")).alias("mutation_score"),
        F.when(gate, F.coalesce("total", F.lit(0))).alias("mutants_total"),
        F.when(gate, F.coalesce("hit", F.lit(0))).alias("mutants_killed"),
    )


RESULT = """v_count AS (
  SELECT l_orderkey AS sample_id, count(*) AS total, count(*) FILTER (WHERE l_quantity > 25) AS hit FROM lineitem GROUP BY 1),
v_result AS (
  SELECT o_orderkey AS sample_id, o_orderpriority AS cwe, o_orderstatus AS difficulty, o_custkey AS owner,
    o_orderkey % 3 <> 0 AS secure_passes, o_totalprice / 1000000.0 AS line_coverage,
    'model-' || CAST(o_custkey % 4 AS VARCHAR) AS model,
    (o_orderkey % 3 <> 0) AND o_orderkey % 2 = 0 AS vuln_detected,
    o_orderkey % 3 <> 0 AS mutation_attempted,
    CASE WHEN o_orderkey % 3 <> 0 THEN hit * 1.0E0 / total END AS mutation_score,
    CASE WHEN o_orderkey % 3 <> 0 THEN coalesce(total, 0) END AS mutants_total,
    CASE WHEN o_orderkey % 3 <> 0 THEN coalesce(hit, 0) END AS mutants_killed
  FROM orders LEFT JOIN v_count ON sample_id = o_orderkey)"""


def judge(spark: SparkSession, sf_dir: str, role: str) -> DataFrame:
    """First turn of a role in each conversation as a judge's score in percent: sample_id, raw."""
    rows = table(spark, sf_dir, "conversations").where(F.col("role") == role)
    first = rows.groupBy(F.col("conv_id").alias("sample_id")).agg(F.min_by("text", F.struct("turn", "text")).alias("text"))
    return first.select("sample_id", F.least(F.length("text"), F.lit(100)).alias("raw"))


def judge_sql(role: str, name: str) -> str:
    """The CTE of judge()."""
    return f"""{name} AS (
  SELECT conv_id AS sample_id, least(length(arg_min(text, (turn, text))), 100) AS raw FROM conversations WHERE role = '{role}' GROUP BY 1)"""


def finding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as findings of tools: sample_id, tool, rule, cwe, severity, ord."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("sample_id"), F.when(F.col("event_id") % 2 == 0, "bandit").otherwise("semgrep").alias("tool"),
        F.concat(F.lit("B"), (F.col("event_id") % 17).cast("string")).alias("rule"), F.col("event_type").alias("cwe"),
        F.when(F.col("value") < 10, "LOW").when(F.col("value") < 50, "MEDIUM").otherwise("HIGH").alias("severity"),
        F.col("event_id").alias("ord"), "props",
    )


FINDING = """v_finding AS (
  SELECT user_id AS sample_id, CASE WHEN event_id % 2 = 0 THEN 'bandit' ELSE 'semgrep' END AS tool,
    'B' || CAST(event_id % 17 AS VARCHAR) AS rule, event_type AS cwe,
    CASE WHEN value < 10 THEN 'LOW' WHEN value < 50 THEN 'MEDIUM' ELSE 'HIGH' END AS severity, event_id AS ord, props
  FROM events)"""
