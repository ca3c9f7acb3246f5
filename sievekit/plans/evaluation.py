"""Evaluation aggregates over the adapter views."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievekit.operators import metrics as m
from sievekit.plans import views as v

_GUARD = "CASE WHEN {b} > 0 THEN {a} * 1.0E0 / {b} ELSE 0.0E0 END"
_KILLED = "sum(coalesce(mutants_killed, 0))"
_TOTAL = "sum(coalesce(mutants_total, 0))"
_MEAN = "coalesce(avg(mutation_score), 0.0)"
_RATE = "count(*) FILTER (WHERE secure_passes) * 1.0E0 / count(*)"
_SUMMARY = f"""count(*) AS samples, count(mutation_score) AS valid_mutation_scores,
  count(*) FILTER (WHERE mutation_attempted) AS samples_with_scores, {_MEAN} AS avg_mutation_score,
  coalesce(stddev_samp(mutation_score), 0.0) AS std_mutation_score, {_MEAN} * ({_RATE}) AS effective_mutation_score,
  {_RATE} AS secure_pass_rate, count(*) FILTER (WHERE secure_passes) AS secure_pass_count,
  coalesce(avg(CAST(vuln_detected AS INT)), 0.0) AS avg_vuln_detection, coalesce(avg(line_coverage), 0.0) AS avg_line_coverage,
  CAST({_TOTAL} AS BIGINT) AS total_mutants, CAST({_KILLED} AS BIGINT) AS total_killed,
  CAST({_TOTAL} - {_KILLED} AS BIGINT) AS total_survived,
  {_GUARD.format(a=_KILLED, b=_TOTAL)} AS overall_mutation_score,
  {_GUARD.format(a=f"({_TOTAL} - {_KILLED})", b=_TOTAL)} AS overall_survival_rate"""
_MUTANTS = """count(*) AS total, count(*) FILTER (WHERE killed) AS killed, count(*) FILTER (WHERE NOT killed) AS survived,
  count(*) FILTER (WHERE killed) * 1.0E0 / count(*) AS kill_rate, count(*) FILTER (WHERE NOT killed) * 1.0E0 / count(*) AS survival_rate"""


def _breakdown(keys: str = "") -> str:
    def n(what: str) -> str:
        return f"count(*) FILTER (WHERE killed AND {what})"

    sem, fun, inc, cra = (f"kill_type = '{k}'" for k in ("semantic", "functional", "assertion_incidental", "crash"))
    layers = ", ".join(f"{n(f"{sem} AND layer = '{k}'")} AS semantic_{k}" for k in v.LAYERS)
    generic = n(f"{sem} AND layer = 'generic_keyword'")
    return f"""{keys}count(*) AS total_mutants, count(*) FILTER (WHERE killed) AS total_killed, {n(sem)} AS semantic_kills,
  {n(fun)} AS functional_kills, {n(inc)} AS incidental_kills, {n(cra)} AS crash_kills, {n("kill_type = 'other'")} AS other_kills, {layers},
  count(*) FILTER (WHERE killed) * 1.0E0 / count(*) AS mutation_score, {n(sem)} * 1.0E0 / count(*) AS security_mutation_score,
  ({n(sem)} - {generic}) * 1.0E0 / count(*) AS security_mutation_score_strict, {n(fun)} * 1.0E0 / count(*) AS functional_score,
  {n(inc)} * 1.0E0 / count(*) AS incidental_score, {n(cra)} * 1.0E0 / count(*) AS crash_score"""


def _by(key: str) -> str:
    return f"WITH {v.RESULT} SELECT coalesce({key}, 'unknown') AS {key}, {_SUMMARY}, count(*) < 5 AS low_confidence FROM v_result GROUP BY 1"


QUERIES = {
    "a01_calculate_metrics": lambda s, d: m.calculate(v.result(s, d)),
    "a02_mutation_score": lambda s, d: v.result(s, d).select(
        "sample_id", m.mutation_score(F.col("mutants_killed"), F.col("mutants_total"), F.lit(1)).alias("score"),
        m.ratio(F.col("mutants_total") - F.col("mutants_killed"), F.col("mutants_total")).alias("survival_rate"),
    ),
    "a03_coverage_ratio": lambda s, d: v.sample(s, d).select(
        "id", m.ratio(F.col("n_chars") % 100, F.col("n_chars") % 7).alias("line_coverage")
    ),
    "a04_by_cwe": lambda s, d: m.calculate(v.result(s, d), "cwe"),
    "a05_by_difficulty": lambda s, d: m.calculate(v.result(s, d), "difficulty"),
    "a06_by_source_type": lambda s, d: m.calculate(v.result(s, d).withColumnRenamed("model", "source_type"), "source_type"),
    "a07_by_mutant_category": lambda s, d: m.mutant_totals(v.mutant(s, d), "category"),
    "a08_by_operator": lambda s, d: m.mutant_totals(v.mutant(s, d), "operator"),
    "a09_survival_patterns": lambda s, d: m.survivors(v.mutant(s, d), v.result(s, d)).groupBy("cwe", "operator").agg(
        F.count("*").alias("survived"), F.countDistinct("sample_id").alias("samples")
    ),
    "a10_kill_breakdown": lambda s, d: m.kill_breakdown(v.mutant(s, d)),
    "a10_kill_breakdown_by_operator": lambda s, d: m.kill_breakdown(v.mutant(s, d), "operator"),
    "a11_security_precision": lambda s, d: m.security_precision(v.result(s, d), "cwe"),
    "a12_model_comparison": lambda s, d: m.calculate(v.result(s, d), "model").orderBy("model"),
    "a17_vd_quadrants": lambda s, d: m.quadrants(v.result(s, d), "difficulty"),
    "a31_model_averages": lambda s, d: m.model_averages(v.result(s, d)),
    "a38_reference_summary": lambda s, d: m.calculate_by_each(v.result(s, d), "cwe", "difficulty", "model"),
    "f13_survived_mutants": lambda s, d: m.survivors(v.mutant(s, d), v.result(s, d)),
    "j09_with_and_without": lambda s, d: m.delta_by_key(
        v.result(s, d).where("owner % 2 = 0"), v.result(s, d).where("owner % 2 = 1")
    ),
    "o01_weak_operators": lambda s, d: m.weak_operators(v.mutant(s, d)),
    "o02_most_survivors": lambda s, d: m.most_survivors(v.mutant(s, d)),
    "o04_leaderboard": lambda s, d: m.leaderboard(v.result(s, d)),
}

ORACLE = {
    "a01_calculate_metrics": f"WITH {v.RESULT} SELECT {_SUMMARY} FROM v_result",
    "a02_mutation_score": f"""WITH {v.RESULT} SELECT sample_id, {_GUARD.format(a="mutants_killed", b="(mutants_total - 1)")} AS score,
      {_GUARD.format(a="(mutants_total - mutants_killed)", b="mutants_total")} AS survival_rate FROM v_result""",
    "a03_coverage_ratio": f"WITH {v.SAMPLE} SELECT id, {_GUARD.format(a='(n_chars % 100)', b='(n_chars % 7)')} AS line_coverage FROM v_sample",
    "a04_by_cwe": _by("cwe"),
    "a05_by_difficulty": _by("difficulty"),
    "a06_by_source_type": _by("model").replace("AS model, count", "AS source_type, count"),
    "a07_by_mutant_category": f"WITH {v.MUTANT} SELECT coalesce(category, 'unknown') AS category, {_MUTANTS} FROM v_mutant GROUP BY 1",
    "a08_by_operator": f"WITH {v.MUTANT} SELECT operator, {_MUTANTS} FROM v_mutant GROUP BY 1",
    "a09_survival_patterns": f"""WITH {v.MUTANT} SELECT coalesce(o_orderpriority, 'unknown') AS cwe, operator, count(*) AS survived,
      count(DISTINCT sample_id) AS samples FROM v_mutant LEFT JOIN orders ON o_orderkey = sample_id WHERE NOT killed GROUP BY 1, 2""",
    "a10_kill_breakdown": f"WITH {v.MUTANT} SELECT {_breakdown()} FROM v_mutant",
    "a10_kill_breakdown_by_operator": f"WITH {v.MUTANT} SELECT {_breakdown('operator, ')} FROM v_mutant GROUP BY operator",
    "a11_security_precision": f"""WITH {v.RESULT} SELECT cwe, count(*) FILTER (WHERE secure_passes) AS secure_passes,
      count(*) FILTER (WHERE vuln_detected) AS vuln_detected_count,
      count(*) FILTER (WHERE vuln_detected) * 1.0E0 / nullif(count(*) FILTER (WHERE secure_passes), 0) AS security_precision
      FROM v_result GROUP BY 1""",
    "a12_model_comparison": _by("model"),
    "a17_vd_quadrants": f"""WITH {v.RESULT} SELECT difficulty, CASE WHEN secure_passes AND vuln_detected THEN 'correct'
      WHEN secure_passes THEN 'both_pass' WHEN vuln_detected THEN 'both_fail' ELSE 'inverted' END AS quadrant, count(*) AS n
      FROM v_result GROUP BY 1, 2""",
    "a31_model_averages": f"""WITH {v.RESULT} SELECT model, count(*) AS samples_evaluated, {_MEAN} AS avg_mutation_score,
      avg(CAST(vuln_detected AS INT)) AS avg_vuln_detection, avg(coalesce(line_coverage, 0)) AS avg_line_coverage,
      {_RATE} AS secure_pass_rate, {_MEAN} * ({_RATE}) AS effective_mutation_score FROM v_result GROUP BY 1""",
    "a38_reference_summary": f"WITH {v.RESULT} " + " UNION ALL ".join(
        f"SELECT '{k}' AS dimension, coalesce({k}, 'unknown') AS value, {_SUMMARY} FROM v_result GROUP BY coalesce({k}, 'unknown')"
        for k in ("cwe", "difficulty", "model")
    ),
    "f13_survived_mutants": f"""WITH {v.MUTANT} SELECT sample_id, coalesce(o_orderpriority, 'unknown') AS cwe,
      o_orderstatus AS difficulty, seq, operator FROM v_mutant LEFT JOIN orders ON o_orderkey = sample_id WHERE NOT killed""",
    "j09_with_and_without": f"""WITH {v.RESULT},
      a AS (SELECT cwe, avg(mutation_score) AS with_score, count(*) AS with_n FROM v_result WHERE owner % 2 = 0 GROUP BY 1),
      b AS (SELECT cwe, avg(mutation_score) AS without_score, count(*) AS without_n FROM v_result WHERE owner % 2 = 1 GROUP BY 1)
      SELECT cwe, with_score, with_n, without_score, without_n, with_score - without_score AS delta FROM a JOIN b USING (cwe)""",
    "o01_weak_operators": f"""WITH {v.MUTANT} SELECT operator, survived, total, survival_rate FROM
      (SELECT operator, {_MUTANTS} FROM v_mutant GROUP BY 1) WHERE survived > 0 ORDER BY survival_rate DESC, operator LIMIT 5""",
    "o02_most_survivors": f"""WITH {v.MUTANT} SELECT sample_id, count(*) AS survived FROM v_mutant WHERE NOT killed
      GROUP BY 1 ORDER BY survived DESC, sample_id LIMIT 10""",
    "o04_leaderboard": f"""WITH {v.RESULT}, r AS (SELECT model, {_SUMMARY} FROM v_result GROUP BY 1)
      SELECT model, samples, effective_mutation_score, avg_vuln_detection,
        row_number() OVER (ORDER BY effective_mutation_score DESC, model) AS rank FROM r""",
}
