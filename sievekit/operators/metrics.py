"""Grouped effectiveness metrics of results and mutants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Groups of fewer samples carry a low-confidence mark.
LOW_CONFIDENCE = 5


def ratio(top: Column, bottom: Column) -> Column:
    """top / bottom as double, 0.0 where bottom is not positive or null."""
    return F.when(bottom > 0, top * 1.0 / bottom).otherwise(F.lit(0.0))


def mutation_score(killed: Column, total: Column, equivalent: Column | None = None) -> Column:
    """killed / (total - equivalent), 0.0 where there is nothing to kill."""
    return ratio(killed, total if equivalent is None else total - equivalent)


def keyed(key: str) -> Column:
    """A group key with missing values as 'unknown'."""
    return F.coalesce(F.col(key), F.lit("unknown")).alias(key)


def summary() -> list[Column]:
    """The aggregates of a set of results."""
    score, passes = F.col("mutation_score"), F.coalesce("secure_passes", F.lit(False))
    total, killed = F.sum(F.coalesce("mutants_total", F.lit(0))), F.sum(F.coalesce("mutants_killed", F.lit(0)))
    mean = F.coalesce(F.avg(score), F.lit(0.0))
    passed = F.count_if(passes)
    rate = passed * 1.0 / F.count("*")
    return [
        F.count("*").alias("samples"),
        F.count(score).alias("valid_mutation_scores"),
        F.count_if(F.col("mutation_attempted")).alias("samples_with_scores"),
        mean.alias("avg_mutation_score"),
        F.coalesce(F.stddev_samp(score), F.lit(0.0)).alias("std_mutation_score"),
        (mean * rate).alias("effective_mutation_score"),
        rate.alias("secure_pass_rate"),
        passed.alias("secure_pass_count"),
        F.coalesce(F.avg(F.col("vuln_detected").cast("int")), F.lit(0.0)).alias("avg_vuln_detection"),
        F.coalesce(F.avg("line_coverage"), F.lit(0.0)).alias("avg_line_coverage"),
        total.alias("total_mutants"),
        killed.alias("total_killed"),
        (total - killed).alias("total_survived"),
        ratio(killed, total).alias("overall_mutation_score"),
        ratio(total - killed, total).alias("overall_survival_rate"),
    ]


def calculate(results: DataFrame, *keys: str) -> DataFrame:
    """Metrics of all results, or of each group; no row for no results."""
    if not keys:
        return results.agg(*summary()).where("samples > 0")
    return (
        results.withColumns({k: keyed(k) for k in keys}).groupBy(*keys).agg(*summary())
        .withColumn("low_confidence", F.col("samples") < LOW_CONFIDENCE)
    )


def calculate_by_each(results: DataFrame, *keys: str) -> DataFrame:
    """Metrics by each key on its own, in one pass: columns dimension, value and the metrics."""
    named = results.withColumns({k: keyed(k) for k in keys})
    sets = named.groupingSets([[k] for k in keys], *keys).agg(
        *summary(), *(F.grouping(k).alias(f"_{k}") for k in keys)
    )
    dimension, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for k in keys:
        dimension = F.when(F.col(f"_{k}") == 0, F.lit(k)).otherwise(dimension)
        value = F.when(F.col(f"_{k}") == 0, F.col(k).cast("string")).otherwise(value)
    out = sets.withColumns({"dimension": dimension, "value": value})
    return out.drop(*keys, *(f"_{k}" for k in keys))


def mutant_totals(mutants: DataFrame, *keys: str) -> DataFrame:
    """Totals and rates of mutants by keys."""
    killed = F.count_if(F.coalesce("killed", F.lit(False)))
    total = F.count("*")
    return mutants.withColumns({k: keyed(k) for k in keys}).groupBy(*keys).agg(
        total.alias("total"), killed.alias("killed"), (total - killed).alias("survived"),
        ratio(killed, total).alias("kill_rate"), ratio(total - killed, total).alias("survival_rate"),
    )


def survivors(mutants: DataFrame, results: DataFrame) -> DataFrame:
    """Mutants that no test killed, with their sample's context."""
    context = results.select("sample_id", "cwe", "difficulty").dropDuplicates(["sample_id"])
    alive = mutants.where(~F.coalesce("killed", F.lit(False)))
    return alive.join(context, "sample_id", "left").select(
        "sample_id", F.coalesce("cwe", F.lit("unknown")).alias("cwe"), "difficulty", "seq", "operator"
    )


def weak_operators(mutants: DataFrame, n: int = 5) -> DataFrame:
    """The n operators with the highest survival rate among those with survivors."""
    return (
        mutant_totals(mutants, "operator").where("survived > 0")
        .select("operator", "survived", "total", "survival_rate").orderBy(F.desc("survival_rate"), "operator").limit(n)
    )


def most_survivors(mutants: DataFrame, n: int = 10) -> DataFrame:
    """The n samples with most survivors."""
    alive = mutants.where(~F.coalesce("killed", F.lit(False)))
    return alive.groupBy("sample_id").agg(F.count("*").alias("survived")).orderBy(F.desc("survived"), "sample_id").limit(n)


def kill_breakdown(mutants: DataFrame, *keys: str) -> DataFrame:
    """Kills by type and layer with their scores; scores are null without mutants."""
    hit = F.coalesce("killed", F.lit(False))
    kind = F.coalesce("kill_type", F.lit("other"))
    total = F.count("*")
    kinds = ("semantic", "functional", "assertion_incidental", "crash")
    counts = {k: F.count_if(hit & (kind == k)) for k in kinds}
    layer = F.coalesce("layer", F.lit("operator_keyword"))
    layers = {
        k: F.count_if(hit & (kind == "semantic") & (layer == k))
        for k in ("mock_observability", "operator_keyword", "generic_keyword", "attack_payload")
    }

    def share(x: Column) -> Column:
        return F.try_divide(x * 1.0, total)

    columns = [
        total.alias("total_mutants"), F.count_if(hit).alias("total_killed"),
        counts["semantic"].alias("semantic_kills"), counts["functional"].alias("functional_kills"),
        counts["assertion_incidental"].alias("incidental_kills"), counts["crash"].alias("crash_kills"),
        F.count_if(hit & ~kind.isin(*kinds)).alias("other_kills"),
        *(v.alias(f"semantic_{k}") for k, v in layers.items()),
        share(F.count_if(hit)).alias("mutation_score"), share(counts["semantic"]).alias("security_mutation_score"),
        share(counts["semantic"] - layers["generic_keyword"]).alias("security_mutation_score_strict"),
        share(counts["functional"]).alias("functional_score"), share(counts["assertion_incidental"]).alias("incidental_score"),
        share(counts["crash"]).alias("crash_score"),
    ]
    return mutants.groupBy(*keys).agg(*columns) if keys else mutants.agg(*columns)


def security_precision(results: DataFrame, *keys: str) -> DataFrame:
    """Of samples whose tests pass on secure code, the share that detects the weakness; null without any."""
    passes = F.coalesce("secure_passes", F.lit(False))
    both = passes & F.coalesce("vuln_detected", F.lit(False))
    columns = [
        F.count_if(passes).alias("secure_passes"), F.count_if(both).alias("vuln_detected_count"),
        F.try_divide(F.count_if(both) * 1.0, F.count_if(passes)).alias("security_precision"),
    ]
    return results.groupBy(*keys).agg(*columns) if keys else results.agg(*columns)


def leaderboard(results: DataFrame, key: str = "model") -> DataFrame:
    """Models by effective score, best first, with their rank."""
    from pyspark.sql import Window as W

    order = W.orderBy(F.coalesce("effective_mutation_score", F.lit(0.0)).desc(), F.col(key))
    return calculate(results, key).select(
        key, "samples", "effective_mutation_score", "avg_vuln_detection", F.row_number().over(order).alias("rank")
    )


def model_averages(results: DataFrame, key: str = "model") -> DataFrame:
    """Averages of a model's run: null scores are left out, null coverage counts as 0."""
    mean = F.coalesce(F.avg("mutation_score"), F.lit(0.0))
    rate = F.avg(F.coalesce("secure_passes", F.lit(False)).cast("int"))
    return results.groupBy(key).agg(
        F.count("*").alias("samples_evaluated"), mean.alias("avg_mutation_score"),
        F.avg(F.coalesce("vuln_detected", F.lit(False)).cast("int")).alias("avg_vuln_detection"),
        F.avg(F.coalesce("line_coverage", F.lit(0.0))).alias("avg_line_coverage"),
        rate.alias("secure_pass_rate"), (mean * rate).alias("effective_mutation_score"),
    )


def delta_by_key(one: DataFrame, two: DataFrame, key: str = "cwe") -> DataFrame:
    """Averages of two runs side by side, and what the second lacks."""
    a = one.groupBy(key).agg(F.avg("mutation_score").alias("with_score"), F.count("*").alias("with_n"))
    b = two.groupBy(key).agg(F.avg("mutation_score").alias("without_score"), F.count("*").alias("without_n"))
    return a.join(b, key).withColumn("delta", F.col("with_score") - F.col("without_score"))


def improvement(base: Column, now: Column) -> tuple[Column, Column]:
    """Absolute and relative gain; infinite over a base of 0."""
    return now - base, F.when(base == 0, F.lit(float("inf"))).otherwise((now - base) / base)


def quadrants(results: DataFrame, *keys: str) -> DataFrame:
    """Counts by what tests do on secure and insecure code."""
    secure, insecure = F.col("secure_passes"), F.col("vuln_detected")
    kind = (
        F.when(secure.isNull() | insecure.isNull(), "no_tests").when(secure & insecure, "correct")
        .when(secure & ~insecure, "both_pass").when(~secure & insecure, "both_fail").otherwise("inverted")
    )
    return results.withColumn("quadrant", kind).groupBy(*keys, "quadrant").agg(F.count("*").alias("n"))
