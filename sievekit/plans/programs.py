"""Coverage, parameters and audits of programs that quote the documents' texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievekit.operators import audit as a
from sievekit.operators import coverage as co
from sievekit.operators import variations as va
from sievekit.plans.rules import literal
from sievekit.session import table


def _said():
    return F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z ]", " ")


def _lines(s, d):
    """Programs of two lines and more: one for each line of the text, which every third run executes."""
    quoted = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.concat(F.lit("x = '"), F.regexp_replace(x, "[^A-Za-z ]", " "), F.lit("'\n# note\n")))
    code = F.concat(F.lit("import os\n\n"), F.array_join(quoted, ""), F.when(F.col("doc_id") % 7 == 0, "def broken(:\n").otherwise(""))
    docs = table(s, d, "documents").select(F.col("doc_id").alias("id"), code.alias("code"))
    ran = docs.select("id", F.explode(F.sequence(F.lit(1), F.size(F.split("code", "\n")))).alias("line")).where("line % 3 = id % 3")
    return co.line_coverage(docs, ran)


def _parameters(s, d):
    """A function whose parameters are the text's words, every second one with a type."""
    words = F.filter(F.split(F.lower(_said()), " +"), lambda w: w != "")
    listed = F.transform(words, lambda w, k: F.concat(w, F.when(k % 2 == 1, ": Config").otherwise("")))
    code = F.concat(F.lit("def run("), F.array_join(listed, ", "), F.lit("):\n    pass\n"))
    found = table(s, d, "documents").select("doc_id", co.classified_parameters(code, F.lit("run")).alias("p"))
    found = found.select("doc_id", F.transform("p", lambda p: p["class"]).alias("k"))
    return found.select("doc_id", *((F.size("k") - F.size(F.array_remove("k", k))).alias(k) for k in ("tainted", "infrastructure", "unknown")))


_CWES = ("CWE-89", "CWE-78", "CWE-79", "CWE-22", "CWE-502", "CWE-798", "CWE-611", "CWE-918", "CWE-862", "CWE-338", "CWE-95")
#: Code before the text, by the id: what the weaknesses' rules look for, or not.
_HEADS = (
    'q = "SELECT a WHERE b" + c', "os.system(x)", "y = html.escape(x)", "p = os.path.commonpath(x)", "pickle.loads(x)", 'password = "abc"', "import defusedxml", "if is_private(x): pass",
    "@login_required", "k = secrets.token_hex()", "eval(x) if allowed else 0", "x = 1", "",
)


def _programs(s, d):
    at = lambda values, n: F.get(F.array(*map(F.lit, values)), (F.col("doc_id") % n).cast("int"))
    note = F.concat(F.lit("\nnote = '"), _said(), F.lit("'\n"))
    insecure = F.when(F.col("doc_id") % 13 == 12, " \n").otherwise(F.concat(at(_HEADS, 13), note))
    secure = F.when(F.col("doc_id") % 3 == 0, F.concat(insecure, F.lit("  "))).when(F.col("doc_id") % 3 == 1, F.concat(at(_HEADS, 13), F.lit("\n"), note)).otherwise("x = 2")
    return table(s, d, "documents").select(
        F.col("doc_id").alias("id"), at(_CWES, 11).alias("cwe"), "source", F.concat(F.lit("run_"), (F.col("doc_id") % 50).cast("string")).alias("entry_point"), secure.alias("secure_code"), insecure.alias("insecure_code")
    )


def _varied(s, d):
    """Programs with a function each, but for some that define nothing or don't parse."""
    head = F.when(F.col("doc_id") % 11 == 0, "def broken(:\n").when(F.col("doc_id") % 7 == 0, "print(1)\n").otherwise(F.concat(F.lit("def run_"), F.col("doc_id").cast("string"), F.lit("(x):\n    # note\n    y = x\n    return y\n")))
    code = F.concat(head, F.lit("print('"), _said(), F.lit("')\n"))
    rows = table(s, d, "documents").select(F.col("doc_id").alias("id"), code.alias("secure_code"), F.concat(code, F.lit("pass\n")).alias("insecure_code"), F.concat(F.lit("run_"), F.col("doc_id").cast("string")).alias("entry_point"))
    found = va.variations(rows)
    same = F.regexp_extract("secure_code", r"(?s)print\('(.*)'\)", 1)
    return found.select("id", "strategy", "entry_point", F.array_join("steps", ",").alias("steps"), "skipped", F.md5(same.cast("binary")).alias("said"))


QUERIES = {
    "u13_variations": _varied,
    "a03_line_coverage": _lines,
    "x23_parameter_classes": _parameters,
    "x29_insecure_issues": lambda s, d: a.insecure_issues(_programs(s, d)),
    "x29_diff_issues": lambda s, d: a.diff_issues(_programs(s, d)).where("message <> 'nearly identical'"),
    "x29_repeated_entry_points": lambda s, d: a.repeated_entry_points(_programs(s, d)),
}

#: For each weakness of _CWES the heads that break its rule, the severity and what is said.
_BROKEN = (
    ({k for k in range(12) if k != 0}, "critical", "no SQL string formatting"), ({k for k in range(12) if k not in (1, 10)}, "warning", "no command injection pattern"), ({2}, "warning", "escapes HTML"), ({3}, "warning", "validates paths"),
    ({k for k in range(12) if k != 4}, "warning", "no unsafe deserialization"), ({k for k in range(12) if k != 5}, "info", "no hardcoded credential"), ({6}, "warning", "protects against external entities"), ({7}, "warning", "protects against request forgery"),
    ({8}, "info", "checks who asks"), ({9}, "critical", "uses secure random numbers"), ({10}, "info", "evaluates and sanitizes"),
)
_VALUES = ", ".join(f"({c}, {h}, {literal(sev)}, {literal(msg)})" for c, (heads, sev, msg) in enumerate(_BROKEN) for h in sorted(heads))
_CWE = f"(['{"', '".join(_CWES)}'])[doc_id % 11 + 1]"
#: Words of a text that by themselves are among what a rule looks for.
_TEXT_RULES = "(c = 7 AND regexp_matches(said, '(?i)private|internal|blocklist|blacklist|hostname.*not.*in|scheme.*not.*in')) OR (c = 8 AND regexp_matches(said, '(?i)authenticate')) OR (c = 2 AND regexp_matches(said, '(?i)bleach|markupsafe')) OR (c = 10 AND h = 10) OR (c = 6 AND contains(said, 'defusedxml')) OR (c = 9 AND contains(said, 'SystemRandom'))"

#: Each strategy's name for the function, and the steps that change such a program (hashed names are told by their start).
_VARIED = (("orders", "'order'", "domain_orders"), ("clinic", "'patient'", "domain_clinic"), ("bare_stock", "'shelf'", "bare,domain_stock"), ("wrapped_mail", "'folder'", "wrapped,domain_mail"), ("hashed_bare", "'v_' || substring(md5(doc_id || 'run_' || doc_id), 1, 8)", "hashed"))

ORACLE = {
    "u13_variations": " UNION ALL ".join(
        f"""SELECT doc_id AS id, '{name}' AS strategy, CASE WHEN ok THEN {entry} END AS entry_point, CASE WHEN ok THEN '{steps}' ELSE '' END AS steps,
          CASE WHEN doc_id % 11 = 0 THEN 'secure code does not parse' WHEN doc_id % 7 = 0 THEN 'nothing to change' END AS skipped, CASE WHEN ok THEN md5(regexp_replace(coalesce(text, ''), '[^A-Za-z ]', ' ', 'g')) END AS said
        FROM (SELECT *, doc_id % 11 <> 0 AND doc_id % 7 <> 0 AS ok FROM documents)"""
        for name, entry, steps in _VARIED
    ),
    "a03_line_coverage": """WITH t AS (SELECT doc_id AS id, len(string_split(coalesce(text, ''), chr(10))) AS n FROM documents),
      l AS (SELECT id, 1 AS line FROM t UNION ALL SELECT id, 1 + 2 * unnest(range(1, n + 1)) FROM t UNION ALL SELECT id, 3 + 2 * n FROM t WHERE id % 7 = 0)
      SELECT id, count(*) AS lines_total, count(*) FILTER (WHERE line % 3 = id % 3) AS lines_covered, count(*) FILTER (WHERE line % 3 = id % 3) * 1.0E0 / count(*) AS line_coverage FROM l GROUP BY 1""",
    "x23_parameter_classes": f"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(regexp_replace(coalesce(text, ''), '[^A-Za-z ]', ' ', 'g')), ' +'), lambda x: x <> '') AS w FROM documents),
      c AS (SELECT doc_id, list_transform(list_filter(w, lambda x: x NOT IN ('self', 'cls')), lambda x: x) AS w, w AS every FROM w),
      e AS (SELECT doc_id, unnest(every) AS x, generate_subscripts(every, 1) - 1 AS k FROM c),
      k AS (SELECT doc_id, CASE WHEN k % 2 = 1 OR x IN ({", ".join(map(literal, co.OWN_OBJECTS))}) THEN 'i' WHEN x IN ({", ".join(map(literal, co.TAINTED))}) THEN 't' ELSE 'u' END AS kind FROM e WHERE NOT (x IN ('self', 'cls') AND k % 2 = 0))
      SELECT d.doc_id, CAST(count(*) FILTER (WHERE kind = 't') AS INT) AS tainted, CAST(count(*) FILTER (WHERE kind = 'i') AS INT) AS infrastructure, CAST(count(*) FILTER (WHERE kind = 'u') AS INT) AS unknown FROM documents AS d LEFT JOIN k USING (doc_id) GROUP BY 1""",
    "x29_insecure_issues": f"""WITH r(c, h, severity, message) AS (VALUES {_VALUES}), d AS (SELECT doc_id AS id, {_CWE} AS cwe, source, doc_id % 11 AS c, doc_id % 13 AS h, regexp_replace(coalesce(text, ''), '[^A-Za-z ]', ' ', 'g') AS said FROM documents),
      b(c, severity, message) AS (SELECT DISTINCT c, severity, message FROM r)
      SELECT id, cwe, source, 'critical' AS severity, 'insecure_code' AS category, 'empty' AS message FROM d WHERE h = 12
      UNION ALL SELECT id, cwe, source, b.severity, 'insecure_code', b.message FROM d JOIN b USING (c) LEFT JOIN r ON r.c = d.c AND r.h = d.h WHERE d.h <> 12 AND (r.c IS NOT NULL OR (d.c IN (2, 6, 7, 8, 9) AND ({_TEXT_RULES.replace('(c =', '(d.c =').replace('h = 10', 'd.h = 10')})))""",
    "x29_diff_issues": f"""WITH d AS (SELECT doc_id AS id, {_CWE} AS cwe, source FROM documents WHERE doc_id % 13 <> 12)
      SELECT id, cwe, source, 'critical' AS severity, 'diff_quality' AS category, 'identical' AS message FROM d WHERE id % 3 = 0
      UNION ALL SELECT id, cwe, source, 'critical', 'diff_quality', 'differ in white space only' FROM d WHERE id % 3 = 1""",
    "x29_repeated_entry_points": f"""WITH d AS (SELECT doc_id AS id, {_CWE} AS cwe, source, doc_id % 50 AS e, CASE WHEN doc_id % 3 = 2 THEN 'x = 2' WHEN doc_id % 3 = 0 AND doc_id % 13 = 12 THEN ''
        ELSE (doc_id % 13) || regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g') END AS code FROM documents)
      SELECT id, cwe, source, 'warning' AS severity, 'entry_point' AS category, 'same as another sample' AS message FROM d QUALIFY id <> min(id) OVER (PARTITION BY cwe, e, code)""",
}
