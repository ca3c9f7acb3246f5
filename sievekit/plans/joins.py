"""Joins, set operations and reports of the inventory over the adapter views."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sievekit.operators import judges as j
from sievekit.operators import metrics as m
from sievekit.plans import judging
from sievekit.plans import views as v
from sievekit.session import table


def _responses(s, d):
    """Answers to a third of the benchmark's items, some of them failed, one repeated."""
    b = table(s, d, "benchmark").where("item_id % 3 < 2").select(
        F.concat_ws("__", F.col("item_id").cast("string"), F.lit("full")).alias("custom_id"), (F.col("item_id") % 4 != 0).alias("success"), F.col("text").alias("content")
    )
    return b.unionByName(b.where("custom_id = '1__full'"))


def _answers(s, d):
    requests = table(s, d, "benchmark").select("item_id", F.concat_ws("__", F.col("item_id").cast("string"), F.lit("full")).alias("custom_id"))
    return requests.join(_responses(s, d).dropDuplicates(["custom_id"]), "custom_id", "left")


QUERIES = {
    "j01_fill_from_benchmark": lambda s, d: v.sample(s, d).select("id", F.when(F.col("id") % 2 == 0, F.lit("")).otherwise("own").alias("code")).join(
        table(s, d, "benchmark").select(F.col("item_id").alias("id"), "text"), "id", "left"
    ).select("id", F.coalesce(F.nullif("code", F.lit("")), F.substring("text", 1, 20), F.lit("")).alias("code")),
    "j02_responses": lambda s, d: _answers(s, d).agg(F.count("*").alias("requests"), F.count_if(~F.coalesce("success", F.lit(False))).alias("failed")),
    "j06_parsed_ids": lambda s, d: _responses(s, d).select(F.regexp_extract("custom_id", "(?s)^(.*)__(.*)$", 1).cast("bigint").alias("item_id"), "success").join(table(s, d, "benchmark"), "item_id").groupBy("success").agg(F.count("*").alias("n")),
    "o03_by_count": lambda s, d: v.mutant(s, d).groupBy("operator").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "operator").withColumn("rank", F.row_number().over(W.orderBy(F.desc("n"), "operator"))),
    "o05_most_common": lambda s, d: v.sample(s, d).groupBy("source").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source").limit(15),
    "o08_truncated_lists": lambda s, d: v.finding(s, d).groupBy("cwe").agg(F.array_join(F.slice(F.sort_array(F.collect_set("rule")), 1, 6), ",").alias("rules")),
    "u04_category_sets": lambda s, d: v.finding(s, d).groupBy("cwe").agg(F.collect_set(F.when(F.col("tool") == "bandit", F.col("rule"))).alias("a"), F.collect_set(F.when(F.col("tool") == "semgrep", F.col("rule"))).alias("b")).select(
        "cwe", F.size(F.array_intersect("a", "b")).alias("both"), F.size(F.array_union("a", "b")).alias("any")
    ),
    "m03_judge_composite": lambda s, d: j.combine(v.judge(s, d, "user"), v.judge(s, d, "assistant")).where("composite > 0.5").select("sample_id", "composite"),
    "m07_improvement": lambda s, d: m.calculate(v.result(s, d), "model").select("model", m.improvement(F.lit(0.25), F.col("avg_mutation_score"))[0].alias("absolute"), m.improvement(F.lit(0.25), F.col("avg_mutation_score"))[1].alias("relative")),
}

_RESP = """resp AS (SELECT item_id, item_id % 4 <> 0 AS success FROM benchmark WHERE item_id % 3 < 2 UNION ALL SELECT 1, true FROM benchmark WHERE item_id = 1)"""

ORACLE = {
    "j01_fill_from_benchmark": """SELECT doc_id AS id, CASE WHEN doc_id % 2 = 1 THEN 'own' ELSE coalesce(substring(benchmark.text, 1, 20), '') END AS code
      FROM documents LEFT JOIN benchmark ON item_id = doc_id""",
    "j02_responses": f"WITH {_RESP}, d AS (SELECT DISTINCT * FROM resp) SELECT count(*) AS requests, count(*) FILTER (WHERE NOT coalesce(success, false)) AS failed FROM benchmark LEFT JOIN d USING (item_id)",
    "j06_parsed_ids": f"WITH {_RESP} SELECT success, count(*) AS n FROM resp GROUP BY 1",
    "o03_by_count": f"WITH {v.MUTANT}, g AS (SELECT operator, count(*) AS n FROM v_mutant GROUP BY 1) SELECT *, CAST(row_number() OVER (ORDER BY n DESC, operator) AS INT) AS rank FROM g",
    "o05_most_common": "SELECT source, count(*) AS n FROM documents GROUP BY 1 ORDER BY n DESC, source LIMIT 15",
    "o08_truncated_lists": f"WITH {v.FINDING} SELECT cwe, array_to_string(list_sort(list(DISTINCT rule))[1:6], ',') AS rules FROM v_finding GROUP BY 1",
    "u04_category_sets": f"""WITH {v.FINDING}, r AS (SELECT cwe, rule, bool_or(tool = 'bandit') AS a, bool_or(tool = 'semgrep') AS b FROM v_finding GROUP BY 1, 2)
      SELECT cwe, CAST(count(*) FILTER (WHERE a AND b) AS INT) AS both, CAST(count(*) AS INT) AS any FROM r GROUP BY 1""",
    "m03_judge_composite": f"WITH {judging.COMBINE} SELECT sample_id, composite FROM comb WHERE composite > 0.5",
    "m07_improvement": f"WITH {v.RESULT} SELECT model, avg(mutation_score) - 0.25 AS absolute, (avg(mutation_score) - 0.25) / 0.25 AS relative FROM v_result GROUP BY 1",
}
