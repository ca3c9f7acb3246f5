"""Kill classification, judge scores, findings and scalar functions over the adapter views."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievekit.functions import text as t
from sievekit.operators import curation as k
from sievekit.operators import findings as fi
from sievekit.operators import judges as j
from sievekit.operators import kills
from sievekit.operators import mutation as mu
from sievekit.plans import views as v
from sievekit.session import table

#: Words and payloads that texts of the tables have, dealt to the operators by their number.
_SIGNS = ("tion", "the [a-z]+ing", "eau", "sch", "password", "[0-9]{4}", "qu", "und ", "les ", "email")
_PAYLOADS = ("A", "zz", "(C)", "x@")
_OPERATORS = tuple(mu.TARGETS)


def _operator_rules() -> kills.Rules:
    """Rules for each of the operators: two signs, a payload, a mock."""
    return kills.Rules(
        keywords={n: [_SIGNS[k % 10], _SIGNS[(3 * k + 1) % 10]] for k, n in enumerate(_OPERATORS)},
        payloads={n: [_PAYLOADS[k % 4]] for k, n in enumerate(_OPERATORS)},
        mocks={n: {"db": ["last_query", "rows"]} if k % 2 else {"fs": ["path"]} for k, n in enumerate(_OPERATORS)},
    )


#: What comes before a text to make it a test's error, by the id.
_BEGINNINGS = ("AssertionError: ", "Assertion failed ", "", "TypeError: ", "Failed: DID NOT RAISE ", "AssertionError ", "AssertionError: assert ")


def _errors(s, d):
    """The documents' texts as errors of the operators' mutants."""
    number = F.col("doc_id") % len(_OPERATORS)
    begin = F.element_at(F.array(*map(F.lit, _BEGINNINGS)), (F.col("doc_id") % len(_BEGINNINGS) + 1).cast("int"))
    operator = F.when(F.col("doc_id") % 37 > 0, F.element_at(F.array(*map(F.lit, _OPERATORS)), (number + 1).cast("int")))
    access = F.when(F.col("doc_id") % 5 == 0, F.create_map(F.lit("db"), F.array(F.lit("rows")))).when(F.col("doc_id") % 5 == 1, F.create_map(F.lit("fs"), F.array(F.lit("size"))))
    return table(s, d, "documents").select("doc_id", F.concat(begin, "text").alias("error"), operator.alias("operator"), access.alias("mock_access"))


def _classified(s, d):
    return kills.classify(_errors(s, d), kills.rule_table(s, _operator_rules())).select("doc_id", "operator", "kill_type", "layer")


def _classified_sql() -> str:
    rules = ", ".join(f"({k}, '{n}', '{_SIGNS[k % 10]}', '{_SIGNS[(3 * k + 1) % 10]}', '{_PAYLOADS[k % 4].lower()}')" for k, n in enumerate(_OPERATORS))
    begin = " ".join(f"WHEN {k} THEN '{x}'" for k, x in enumerate(_BEGINNINGS))

    def any_of(column: str, words: tuple) -> str:
        quoted = (w.replace("'", "''") for w in words)
        return "(" + " OR ".join(f"contains({column}, '{w}')" for w in quoted) + ")"

    return f"""WITH r(k, operator, p1, p2, payload) AS (VALUES {rules}),
      e AS (SELECT doc_id, (CASE doc_id % {len(_BEGINNINGS)} {begin} END) || text AS error, CASE WHEN doc_id % 37 > 0 THEN doc_id % {len(_OPERATORS)} END AS k FROM documents),
      j AS (SELECT doc_id, operator, error, lower(error) AS low, e.k, p1, p2, payload FROM e LEFT JOIN r ON e.k = r.k),
      c AS (SELECT doc_id, operator, CASE WHEN coalesce(error, '') = '' THEN 'other none' WHEN {any_of('error', kills.CRASH_NAMES)} OR {any_of('low', kills.CRASH_FRAGMENTS)} THEN 'crash crash'
        WHEN contains(low, 'did not raise') THEN 'functional functional' WHEN NOT (contains(error, 'AssertionError') OR contains(error, 'Assertion failed')) THEN 'other none'
        WHEN k % 2 = 1 AND doc_id % 5 = 0 THEN 'semantic mock_observability' WHEN regexp_matches(low, p1) OR regexp_matches(low, p2) THEN 'semantic operator_keyword'
        WHEN {any_of('low', kills.GENERIC)} THEN 'semantic generic_keyword' WHEN contains(low, payload) THEN 'semantic attack_payload' ELSE 'assertion_incidental none' END AS x FROM j)
      SELECT doc_id, operator, split_part(x, ' ', 1) AS kill_type, split_part(x, ' ', 2) AS layer FROM c"""


def _answers(s, d):
    body = F.concat(F.lit('Here: {"score": '), (F.length("text") % 101).cast("string"), F.lit(', "cwe_addressed": true} done'))
    return table(s, d, "benchmark").select("item_id", F.when(F.col("item_id") % 5 == 0, "no answer").otherwise(body).alias("raw"))


def _fenced(s, d):
    b = table(s, d, "benchmark")
    response = F.when(F.col("item_id") % 3 == 0, F.concat(F.lit("x\n```python\n"), "text", F.lit("\n```\nand\n```\nb = 1\n```\n")))
    response = response.when(F.col("item_id") % 3 == 1, F.concat(F.lit("intro\ndef test_a():\n  "), "text")).otherwise(F.col("text"))
    return b.select("item_id", j.extract_code(response).alias("code"))


_TEST = "def test_x(v):\n    # note\n    assert True\n    assert v == {n}, 'message'\n    with pytest.raises(ValueError):\n        run('../x')\n    print(v)\n"


def _tests(s, d):
    n = (F.col("item_id") * 7).cast("string")
    code = F.concat(F.lit(_TEST.split("{n}")[0]), n, F.lit(_TEST.split("{n}")[1]))
    return table(s, d, "benchmark").select("item_id", F.when(F.col("item_id") % 4 == 0, "def test_y():\n    assert 1 == 1\n").otherwise(code).alias("code"))


def _found(s, d):
    samples = v.finding(s, d).select("sample_id", F.when(F.col("sample_id") % 2 == 0, "click").otherwise("purchase").alias("cwe")).distinct()
    return fi.detections(samples, v.finding(s, d))


_FOUND = f"""{v.FINDING}, sm AS (SELECT DISTINCT sample_id, CASE WHEN sample_id % 2 = 0 THEN 'click' ELSE 'purchase' END AS cwe FROM v_finding),
  hits AS (SELECT DISTINCT sample_id, cwe, tool FROM v_finding),
  found AS (SELECT sample_id, cwe, coalesce(bool_or(tool = 'bandit'), false) AS bandit, coalesce(bool_or(tool = 'semgrep'), false) AS semgrep,
    bool_or(tool IS NOT NULL) AS detected FROM sm LEFT JOIN hits USING (sample_id, cwe) GROUP BY 1, 2)"""


def _mutant_tests(s, d):
    m = v.mutant(s, d)
    return m.select(F.col("sample_id"), (F.col("seq") % 3).alias("mutant"), "seq", "kill_type", "layer")


QUERIES = {
    "x08_classify_kill": _classified,
    "w09_best_kill": lambda s, d: kills.best_kill(_mutant_tests(s, d), "sample_id", "mutant"),
    "f14_first_error": lambda s, d: v.mutant(s, d).groupBy("sample_id").agg(
        F.sort_array(F.collect_list(F.struct("seq", (~F.col("killed")).alias("passed"), F.concat("operator", F.lit("!")).alias("error")))).alias("t")
    ).select("sample_id", kills.first_error(F.when(F.col("sample_id") % 5 == 0, "own").otherwise(""), F.col("t")).alias("error")),
    "n01_json_blob": lambda s, d: _answers(s, d).select("item_id", j.json_blob(F.col("raw"))["score"].alias("score")),
    "n02_scaled": lambda s, d: _answers(s, d).select("item_id", j.scaled(j.json_blob(F.col("raw"))["score"]).alias("score")),
    "n03_repaired": lambda s, d: table(s, d, "benchmark").select(
        "item_id", F.from_json(j.repaired(F.concat(F.lit("```json\n{\"n\": "), F.col("item_id").cast("string"), F.lit(", // note\n \"l\": [1,2,],}\n```"))), "n int, l array<int>")["n"].alias("n")
    ),
    "j04_composite": lambda s, d: j.combine(v.judge(s, d, "user"), v.judge(s, d, "assistant")),
    "a32_judge_summary": lambda s, d: j.judge_summary(j.combine(v.judge(s, d, "user"), v.judge(s, d, "assistant"))),
    "m02_composite": lambda s, d: v.result(s, d).select(
        "sample_id", j.composite(mutation=F.col("mutation_score"), coverage=F.col("line_coverage"), security=F.lit(0.5)).alias("composite")
    ),
    "a30_multimodal": lambda s, d: v.result(s, d).select(j.composite(mutation=F.col("mutation_score"), coverage=F.col("line_coverage")).alias("c")).agg(
        F.avg("c").alias("mean"), F.min("c").alias("least"), F.max("c").alias("most")
    ),
    "x06_extract_code": _fenced,
    "x05_entry_point": lambda s, d: _tests(s, d).select("item_id", j.entry_point(F.col("code")).alias("name")),
    "f09_real_assertion": lambda s, d: _tests(s, d).select("item_id", j.has_real_assertion(F.col("code")).alias("ok")),
    "a13_static_summary": lambda s, d: fi.summary(_found(s, d), ["click"]),
    "j10_static_vs_tests": lambda s, d: fi.compare(_found(s, d), v.result(s, d)),
    "m12_detectability": lambda s, d: v.finding(s, d).groupBy("sample_id").agg(
        F.count_if(F.col("severity") == "HIGH").alias("a"), F.count_if(F.col("severity") == "LOW").alias("b")
    ).select("sample_id", fi.detectability(F.col("a"), F.col("b"))[0].alias("found"), fi.detectability(F.col("a"), F.col("b"))[1].alias("fixed")),
    "n05_parse_findings": lambda s, d: fi.parse_bandit(
        table(s, d, "benchmark").select(F.col("item_id").alias("sample_id"), F.format_string('{"results": [{"test_id": "B%d", "issue_severity": "LOW", "line_number": 3}]}', "item_id").alias("json"))
    ).select("sample_id", "test_id", "issue_severity", "line_number"),
    "n06_nested_default": lambda s, d: v.finding(s, d).select("ord", F.coalesce(F.get_json_object("props", "$.k").cast("int"), F.lit(-1)).alias("k")),
    "x01_normalise_cwe": lambda s, d: table(s, d, "benchmark").select(
        "item_id", fi.normalise_cwe(F.format_string("CWE-0%d", "item_id")).alias("a"), fi.normalise_cwe(F.format_string("xCWE-%d", "item_id")).alias("b")
    ),
    "h01_sha_id": lambda s, d: v.sample(s, d).select("id", t.short_hash(F.col("code"), 12, "sha256").alias("h")),
    "h02_mutant_id": lambda s, d: v.sample(s, d).select("id", t.mutant_id(F.col("source"), F.col("code")).alias("h")),
    "h03_md5_id": lambda s, d: v.sample(s, d).select("id", t.short_hash(F.col("code"), 12).alias("h")),
    "h05_hashed_identifier": lambda s, d: v.sample(s, d).select("id", t.hashed_identifier(F.col("source")).alias("name")),
    "o07_cwe_sort": lambda s, d: table(s, d, "benchmark").select(F.format_string("CWE-%d", F.col("item_id") * 37 % 101).alias("cwe")).orderBy(t.cwe_number(F.col("cwe")), "cwe").limit(7),
    "j11_any_of_first_three": lambda s, d: k.first_by(v.finding(s, d), ["cwe"], ["ord"], 3).groupBy("cwe").agg(F.bool_or(F.col("severity") == "HIGH").alias("any_high")),
    "j12_category_jaccard": lambda s, d: v.finding(s, d).where("tool = 'bandit'").groupBy("cwe").agg(F.collect_set("rule").alias("a")).join(
        v.finding(s, d).where("tool = 'semgrep'").groupBy("cwe").agg(F.collect_set("rule").alias("b")), "cwe"
    ).select("cwe", (F.size(F.array_intersect("a", "b")) * 1.0 / F.size(F.array_union("a", "b"))).alias("jaccard")),
    "j18_variants": lambda s, d: table(s, d, "benchmark").select("item_id").crossJoin(F.broadcast(s.createDataFrame([("none",), ("id",), ("full",)], "variant string"))).select(
        F.substring(F.concat_ws("__", F.col("item_id").cast("string"), "variant"), 1, 64).alias("custom_id")
    ),
}

COMBINE = f"""{v.judge_sql('user', 'sec')}, {v.judge_sql('assistant', 'qual')},
  comb AS (SELECT coalesce(sec.sample_id, qual.sample_id) AS sample_id, sec.raw / 100.0 AS security, qual.raw / 100.0 AS quality,
    coalesce(sec.raw / 100.0, 0) * 0.6 + coalesce(qual.raw / 100.0, 0) * 0.4 AS composite FROM sec FULL JOIN qual ON sec.sample_id = qual.sample_id)"""

ORACLE = {
    "x08_classify_kill": _classified_sql(),
    "w09_best_kill": f"""WITH {v.MUTANT}, p AS (SELECT sample_id, seq % 3 AS mutant, seq, kill_type, layer, row_number() OVER (PARTITION BY sample_id, seq % 3
      ORDER BY CASE kill_type WHEN 'semantic' THEN 5 WHEN 'functional' THEN 4 WHEN 'assertion_incidental' THEN 3 WHEN 'crash' THEN 2 ELSE 1 END DESC, seq) AS r FROM v_mutant)
      SELECT sample_id, mutant, kill_type, layer, seq AS test_seq FROM p WHERE r = 1""",
    "f14_first_error": f"""WITH {v.MUTANT} SELECT sample_id, CASE WHEN sample_id % 5 = 0 THEN 'own' ELSE min_by(operator, seq) FILTER (WHERE killed) || '!' END AS error
      FROM v_mutant GROUP BY 1""",
    "n01_json_blob": "SELECT item_id, CASE WHEN item_id % 5 <> 0 THEN CAST(length(text) % 101 AS INT) END AS score FROM benchmark",
    "n02_scaled": "SELECT item_id, coalesce(CASE WHEN item_id % 5 <> 0 THEN length(text) % 101 END, 0) / 100.0 AS score FROM benchmark",
    "n03_repaired": "SELECT item_id, CAST(item_id AS INT) AS n FROM benchmark",
    "j04_composite": f"WITH {COMBINE} SELECT * FROM comb",
    "a32_judge_summary": f"""WITH {COMBINE}, b AS (SELECT *, CASE WHEN security IS NOT NULL AND quality IS NOT NULL THEN composite END AS c FROM comb)
      SELECT count(security) AS n_security, count(quality) AS n_quality, count(c) AS n_both, avg(security) AS avg_security, avg(quality) AS avg_quality,
      avg(c) AS avg_composite, min(c) AS min_composite, max(c) AS max_composite FROM b""",
    "m02_composite": f"WITH {v.RESULT} SELECT sample_id, coalesce(mutation_score, 0) * 0.5 + 0.5 * 0.2 + coalesce(line_coverage, 0) * 0.15 AS composite FROM v_result",
    "a30_multimodal": f"""WITH {v.RESULT}, c AS (SELECT coalesce(mutation_score, 0) * 0.5 + coalesce(line_coverage, 0) * 0.15 AS c FROM v_result)
      SELECT avg(c) AS mean, min(c) AS least, max(c) AS most FROM c""",
    "x06_extract_code": """SELECT item_id, CASE item_id % 3 WHEN 0 THEN trim(text, ' ') || chr(10) || chr(10) || chr(10) || 'b = 1' || chr(10) WHEN 1 THEN 'def test_a():' || chr(10) || '  ' || rtrim(text, ' ')
      ELSE trim(text, ' ') END AS code FROM benchmark""",
    "x05_entry_point": "SELECT item_id, CASE WHEN item_id % 4 = 0 THEN 'test_y' ELSE 'test_x' END AS name FROM benchmark",
    "f09_real_assertion": "SELECT item_id, item_id % 4 <> 0 AS ok FROM benchmark",
    "a13_static_summary": f"""WITH {_FOUND} SELECT cwe, count(*) AS total, count(*) FILTER (WHERE detected) AS detected, count(*) FILTER (WHERE detected) * 1.0E0 / count(*) AS rate,
      count(*) FILTER (WHERE bandit) AS by_bandit, count(*) FILTER (WHERE semgrep) AS by_semgrep, CASE WHEN cwe = 'click' THEN 'static' ELSE 'dynamic' END AS kind FROM found GROUP BY 1""",
    "j10_static_vs_tests": f"""WITH {_FOUND}, {v.RESULT}, a AS (SELECT avg(CAST(detected AS INT)) AS static_rate FROM found), b AS (SELECT avg(CAST(vuln_detected AS INT)) AS test_rate FROM v_result)
      SELECT static_rate, test_rate, test_rate - static_rate AS absolute, CASE WHEN static_rate = 0 THEN 'inf'::DOUBLE ELSE (test_rate - static_rate) / static_rate END AS relative FROM a, b""",
    "m12_detectability": f"""WITH {v.FINDING}, c AS (SELECT sample_id, count(*) FILTER (WHERE severity = 'HIGH') AS a, count(*) FILTER (WHERE severity = 'LOW') AS b FROM v_finding GROUP BY 1)
      SELECT sample_id, a > 0 AS found, a > 0 AND b < a AS fixed FROM c""",
    "n05_parse_findings": "SELECT item_id AS sample_id, 'B' || item_id AS test_id, 'LOW' AS issue_severity, 3 AS line_number FROM benchmark",
    "n06_nested_default": "SELECT event_id AS ord, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS INT), -1) AS k FROM events",
    "x01_normalise_cwe": "SELECT item_id, 'CWE-' || item_id AS a, 'xCWE-' || item_id AS b FROM benchmark",
    "h01_sha_id": "SELECT doc_id AS id, substring(sha256(text), 1, 12) AS h FROM documents",
    "h02_mutant_id": "SELECT doc_id AS id, substring(md5(source || ':' || text), 1, 8) AS h FROM documents",
    "h03_md5_id": "SELECT doc_id AS id, substring(md5(text), 1, 12) AS h FROM documents",
    "h05_hashed_identifier": "SELECT doc_id AS id, 'var_' || substring(md5(source), 1, 6) AS name FROM documents",
    "o07_cwe_sort": "SELECT 'CWE-' || (item_id * 37 % 101) AS cwe FROM benchmark ORDER BY item_id * 37 % 101, 1 LIMIT 7",
    "j11_any_of_first_three": f"""WITH {v.FINDING} SELECT cwe, bool_or(severity = 'HIGH') AS any_high FROM
      (SELECT *, row_number() OVER (PARTITION BY cwe ORDER BY ord) AS r FROM v_finding) WHERE r <= 3 GROUP BY 1""",
    "j12_category_jaccard": f"""WITH {v.FINDING}, a AS (SELECT DISTINCT cwe, rule FROM v_finding WHERE tool = 'bandit'), b AS (SELECT DISTINCT cwe, rule FROM v_finding WHERE tool = 'semgrep')
      SELECT coalesce(a.cwe, b.cwe) AS cwe, count(*) FILTER (WHERE a.rule IS NOT NULL AND b.rule IS NOT NULL) * 1.0E0 / count(*) AS jaccard
      FROM a FULL JOIN b ON a.cwe = b.cwe AND a.rule = b.rule GROUP BY 1""",
    "j18_variants": "SELECT item_id || '__' || variant AS custom_id FROM benchmark, (VALUES ('none'), ('id'), ('full')) AS t(variant)",
}
