"""Audits, similarity, mutation and event windows over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievekit.operators import audit as a
from sievekit.operators import mutation as mu
from sievekit.plans import views as v
from sievekit.session import table
from sievekit.streaming import progress

_CODE = """import json, hashlib
def run_{n}(cursor, user, path):
    if not user.is_authenticated:
        raise PermissionError("no")
    if len(path) > {n}:
        raise ValueError("long")
    cursor.execute("SELECT * FROM t WHERE a = ?", (user,))
    return hashlib.sha256(json.loads(path)).hexdigest()
"""


def _programs(s, d):
    parts = _CODE.split("{n}")
    n = F.col("item_id").cast("string")
    code = F.concat(F.lit(parts[0]), n, F.lit(parts[1]), n, F.lit(parts[2]))
    return table(s, d, "benchmark").select(
        F.col("item_id").alias("id"), F.when(F.col("item_id") % 2 == 0, "CWE-89").otherwise("CWE-502").alias("cwe"), F.lit("made").alias("source"),
        F.concat(F.lit("run_"), n).alias("entry_point"), code.alias("secure_code"),
        F.when(F.col("item_id") % 3 == 0, code).when(F.col("item_id") % 3 == 1, F.concat(code, F.lit("# x\n"))).otherwise(F.lit("def broken(:")).alias("insecure_code"),
        F.when(F.col("item_id") % 4 == 0, F.lit("pass")).otherwise(F.concat(F.lit("assert run_"), n)).alias("security_tests"),
        F.lit(None).cast("array<string>").alias("mutation_operators"),
    )


_ISSUES = """p AS (SELECT item_id AS id, CASE WHEN item_id % 2 = 0 THEN 'CWE-89' ELSE 'CWE-502' END AS cwe, 'made' AS source FROM benchmark),
iss AS (SELECT id, cwe, source, 'critical' AS severity, 'diff' AS category, 'codes differ in white space at most' AS message FROM p WHERE id % 3 = 0
  UNION ALL SELECT id, cwe, source, 'critical', 'diff', 'codes differ in comments at most' FROM p WHERE id % 3 = 1
  UNION ALL SELECT id, cwe, source, 'critical', 'tests', 'tests check nothing' FROM p WHERE id % 4 = 0
  UNION ALL SELECT id, cwe, source, 'warning', 'tests', 'tests don''t call the entry point' FROM p WHERE id % 4 = 0)"""


QUERIES = {
    "x29_issues": lambda s, d: a.issues(_programs(s, d)),
    "a33_health": lambda s, d: a.health(_programs(s, d), a.issues(_programs(s, d))),
    "f11_insecure_pattern": lambda s, d: v.sample(s, d).select("id", a.insecure_pattern(F.col("code"), F.col("cwe"), {"en": [r"TION", r"\d{4}"], "fr": ["eau"]}).alias("hit")),
    "x_py_compiles": lambda s, d: _programs(s, d).select("id", a.py_compiles("insecure_code").alias("ok")),
    "j07_operators_of_cwe": lambda s, d: mu.operators_of(_programs(s, d)).groupBy("cwe").agg(F.array_join(F.array_sort(F.collect_set("operator")), ",").alias("operators")),
    "a37_operator_count": lambda s, d: mu.operators_of(_programs(s, d)).groupBy("id").agg(F.count("*").alias("n")),
    "e01_tumbling": lambda s, d: progress.tumbling(table(s, d, "events")),
    "e02_sessions": lambda s, d: progress.sessions(table(s, d, "events")),
}

ORACLE = {
    "x29_issues": f"WITH {_ISSUES} SELECT * FROM iss",
    "a33_health": f"""WITH {_ISSUES}, c AS (SELECT count(*) FILTER (WHERE severity = 'critical') AS critical, count(*) FILTER (WHERE severity = 'warning') AS warnings, count(DISTINCT id) AS w FROM iss),
      n AS (SELECT count(*) AS samples FROM p) SELECT samples, samples - w AS clean, critical, warnings, greatest(0.0, (samples * 10 - critical * 2 - warnings * 0.5) * 1.0E0 / (samples * 10)) * 100 AS health FROM n, c""",
    "f11_insecure_pattern": r"""SELECT doc_id AS id, CASE lang WHEN 'en' THEN regexp_matches(text, '(?i)tion|\d{4}') WHEN 'fr' THEN regexp_matches(text, '(?i)eau') ELSE false END AS hit FROM documents""",
    "x_py_compiles": "SELECT item_id AS id, item_id % 3 < 2 AS ok FROM benchmark",
    "a37_operator_count": "SELECT item_id AS id, CASE WHEN item_id % 2 = 0 THEN 2 ELSE 1 END AS n FROM benchmark",
    "j07_operators_of_cwe": "SELECT cwe, operators FROM (VALUES ('CWE-89', 'PSQLI,RVALID'), ('CWE-502', 'DESERIAL')) AS t(cwe, operators)",
    "e01_tumbling": """SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n, sum(value) AS total FROM events GROUP BY 1, 2""",
    "e02_sessions": """WITH o AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL '30 minutes' THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
      g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM o)
      SELECT user_id, min(ts) AS start, max(ts) + INTERVAL '30 minutes' AS "end", count(*) AS n FROM g GROUP BY user_id, k""",
}
