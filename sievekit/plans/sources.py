"""Files and streams: pairs and examples made of the documents' texts, and streams of the events run to their end."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievekit.session import shared_path, table
from sievekit.sources import readers
from sievekit.streaming import progress


def _said():
    return F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z ]", " ")


def _files(s, d):
    """A task and a test file of each document, which quote its text; tasks without a marker and weaknesses that are skipped are among them."""
    n = F.col("doc_id").cast("string")
    stem = F.concat(F.lit("cwe_"), F.get(F.array(*map(F.lit, ("022", "089", "329", "78"))), (F.col("doc_id") % 4).cast("int")), F.lit("_"), n)
    mark = F.when(F.col("doc_id") % 5 == 0, "# END").otherwise("# BEGIN SOLUTION")
    task = F.concat(F.lit("import os\n\n\ndef run_"), n, F.lit("(x):\n    # "), _said(), F.lit("\n    "), mark, F.lit("\n    return os.path.basename(x)\n\n"))
    test = F.concat(F.lit("def run_"), n, F.lit("_unsafe(x):\n    y = '"), _said(), F.lit("'\n    return x\n\ndef test_run_unsafe():\n    pass\n\ndef other_unsafe(x):\n    return y\n"))
    rows = table(s, d, "documents").select(stem.alias("stem"), F.explode(F.array(F.struct(F.lit("_task").alias("kind"), task.alias("value")), F.struct(F.lit("_test").alias("kind"), test.alias("value")))).alias("f"))
    return rows.select(F.concat("stem", "f.kind").alias("name"), "f.value")


def _pairs(s, d):
    found = readers.pair_samples(_files(s, d))
    return found.select("id", "cwe", "original_id", "function", "unsafe", *(F.md5(F.col(c).cast("binary")).alias(c) for c in ("prompt", "secure_code", "insecure_code")))


def _examples(s, d):
    """Queries whose comments quote the documents' texts as bad examples."""
    text = F.concat(F.lit("select x // Bad: this\n// "), F.col("text"), F.lit("\n// GOOD\n"), F.col("lang"), F.lit("\n```Python\n* "), F.col("source"), F.lit("\n```\n// bad\nnever ended"))
    found = table(s, d, "documents").select("doc_id", readers.query_examples(text).alias("e"))
    return found.select("doc_id", F.size("e").alias("n"), F.md5(F.get("e", 0).cast("binary")).alias("h"), F.get("e", 1).alias("last"))


_TIME = "yyyy-MM-dd HH:mm:ss.SSSSSS"


def _jobs(events):
    """Users as jobs: a purchase ends one well, an error badly."""
    return events.select(
        F.col("user_id").cast("string").alias("job"), F.col("ts").cast("timestamp").alias("ts"), F.when(F.col("event_type") == "purchase", "completed").when(F.col("event_type") == "error", "failed").otherwise("running").alias("status")
    )


def _events(s, d):
    """The events as they arrive. A stream's path must be no single file, but may be a pattern."""
    path = f"{d}/events.parquet"
    return progress.stream(s, f"{path}*", s.read.parquet(path).schema)


def _outcomes(s, d):
    out = shared_path(s, "outcomes")
    progress.run_to_end(progress.outcomes(_jobs(_events(s, d)), "36 hours", "10 minutes"), out, f"{out}-checkpoint")
    return s.read.parquet(out).withColumn("at", F.date_format("at", _TIME))


def _progress(s, d):
    out = shared_path(s, "progress")
    rows = _events(s, d).select(F.col("event_id").alias("id"), F.col("event_type").alias("model"), "value")
    progress.progressive_to_end(rows, "id", out, f"{out}-checkpoint", "model")
    return progress.current(s, out).select("model", "n", F.round("avg_value", 6).alias("avg_value"))


QUERIES = {
    "s05_pair_samples": _pairs, "s07_query_examples": _examples, "s11_job_outcomes": _outcomes, "s11_progress": _progress,
    "s11_outcomes_so_far": lambda s, d: progress.outcomes_so_far(_jobs(table(s, d, "events")), "36 hours", "10 minutes").withColumn("at", F.date_format("at", _TIME)),
}

_OUTCOMES = """WITH e AS (SELECT CAST(user_id AS VARCHAR) AS job, ts, CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'running' END AS status FROM events),
  m AS (SELECT max(ts) - INTERVAL 10 MINUTE AS mark FROM e),
  f AS (SELECT job, min(ts) + INTERVAL 36 HOUR AS deadline, min(ts) FILTER (WHERE status <> 'running') AS final FROM e GROUP BY 1),
  o AS (SELECT job, final <= deadline AS intime, CASE WHEN final <= deadline THEN final ELSE deadline END AS t FROM f),
  k AS (SELECT o.job, CASE WHEN intime THEN (SELECT min(status) FROM e WHERE e.job = o.job AND e.ts = o.t AND status <> 'running') ELSE 'timed_out' END AS outcome, t FROM o, m WHERE t < mark)
  SELECT k.job, outcome, strftime(t, '%Y-%m-%d %H:%M:%S.%f') AS "at", (SELECT count(*) FROM e WHERE e.job = k.job AND e.ts <= t) AS events FROM k"""

ORACLE = {
    "s05_pair_samples": r"""WITH d AS (SELECT doc_id, 'cwe_' || (['022', '089', '329', '78'])[doc_id % 4 + 1] || '_' || doc_id AS stem, regexp_replace(coalesce(text, ''), '[^A-Za-z ]', ' ', 'g') AS said FROM documents),
      f AS (SELECT *, 'run_' || doc_id AS fn, 'CWE-' || (['22', '89', '329', '78'])[doc_id % 4 + 1] AS cwe, 'import os' || chr(10) || chr(10) || chr(10) AS imports FROM d WHERE doc_id % 4 <> 2 AND doc_id % 5 <> 0),
      u AS (SELECT *, 0 AS pos, fn || '_unsafe' AS unsafe, 'unsafe' AS suffix, 'def ' || fn || '(x):' || chr(10) || '    y = ' || chr(39) || said || chr(39) || chr(10) || '    return x' AS body FROM f
        UNION ALL SELECT *, 1, 'other_unsafe', 'other_unsafe', 'def ' || fn || '(x):' || chr(10) || '    return y' FROM f)
      SELECT substring(md5('cweval_' || stem || '_' || suffix || '_' || pos), 1, 12) AS id, cwe, stem AS original_id, fn AS function, unsafe, md5(regexp_replace('def ' || fn || '(x):' || chr(10) || '    # ' || said, '\s+$', '')) AS prompt,
        md5(imports || 'def ' || fn || '(x):' || chr(10) || '    # ' || said || chr(10) || '    # BEGIN SOLUTION' || chr(10) || '    return os.path.basename(x)') AS secure_code, md5(imports || body) AS insecure_code FROM u""",
    "s07_query_examples": r"""SELECT doc_id, CASE WHEN text IS NULL OR lang IS NULL OR source IS NULL THEN 0 ELSE 2 END AS n,
        CASE WHEN text IS NOT NULL AND lang IS NOT NULL AND source IS NOT NULL THEN md5(array_to_string(list_transform(string_split('// ' || text, chr(10)), lambda x: regexp_replace(regexp_replace(x, '^//\s*', ''), '^\*\s*', '')), chr(10))) END AS h,
        CASE WHEN text IS NOT NULL AND lang IS NOT NULL THEN source END AS last FROM documents""",
    "s11_job_outcomes": _OUTCOMES,
    "s11_outcomes_so_far": _OUTCOMES,
    "s11_progress": "SELECT event_type AS model, count(*) AS n, round(avg(value), 6) AS avg_value FROM (SELECT DISTINCT ON (event_id) * FROM events) GROUP BY 1",
}
