"""Hand-computed cases of the aggregates."""

import math

from pyspark.sql import functions as F

from sievekit.operators import metrics as m

SCHEMA = "sample_id bigint, cwe string, secure_passes boolean, vuln_detected boolean, mutation_attempted boolean, mutation_score double, mutants_total int, mutants_killed int, line_coverage double"


def results(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_three_results(spark):
    rows = [(1, "a", True, True, True, 1.0, 2, 2, None), (2, "a", True, False, True, 0.5, 2, 1, None), (3, None, False, False, True, None, 0, 0, None)]
    r = m.calculate(results(spark, rows)).first()
    assert (r.samples, r.valid_mutation_scores, r.samples_with_scores) == (3, 2, 3)
    assert r.avg_mutation_score == 0.75 and math.isclose(r.std_mutation_score, math.sqrt(0.125)) and math.isclose(r.secure_pass_rate, 2 / 3)
    assert math.isclose(r.effective_mutation_score, 0.5) and r.overall_mutation_score == 0.75 and r.avg_line_coverage == 0.0
    by = {x.cwe: x for x in m.calculate(results(spark, rows), "cwe").collect()}
    assert set(by) == {"a", "unknown"} and by["a"].low_confidence


def test_single_and_empty(spark):
    one = m.calculate(results(spark, [(1, "a", True, None, True, 0.5, 2, 1, None)])).first()
    assert one.std_mutation_score == 0.0 and one.avg_vuln_detection == 0.0
    assert m.calculate(results(spark, [])).count() == 0


def test_scores(spark):
    row = spark.range(1).select(
        m.mutation_score(F.lit(3), F.lit(3)).alias("a"), m.mutation_score(F.lit(0), F.lit(3)).alias("b"),
        m.mutation_score(F.lit(2), F.lit(4)).alias("c"), m.mutation_score(F.lit(0), F.lit(0)).alias("d"),
        m.improvement(F.lit(0.0), F.lit(0.4))[1].alias("e"),
    ).first()
    assert tuple(row) == (1.0, 0.0, 0.5, 0.0, math.inf)


def test_no_mutants_and_no_passes(spark):
    none = spark.createDataFrame([], "sample_id bigint, operator string, killed boolean, kill_type string, layer string")
    r = m.kill_breakdown(none).first()
    assert r.total_mutants == 0 and r.mutation_score is None and r.security_mutation_score_strict is None
    assert m.security_precision(results(spark, [(1, "a", False, False, True, None, 0, 0, None)])).first().security_precision is None
