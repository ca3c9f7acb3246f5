"""Curation over the adapter views: contamination, deduplication, sampling, quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievekit.operators import contamination as c
from sievekit.operators import curation as k
from sievekit.plans import views as v
from sievekit.session import table

_TOK = r"""regexp_extract_all(lower(text), '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]')"""
_GRAMS = """list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) ELSE [] END)"""
_NGRAMS = f"""
tok AS (SELECT doc_id AS id, {_TOK} AS w FROM documents), sg AS (SELECT id, {_GRAMS} AS g FROM tok),
itok AS (SELECT item_id, {_TOK} AS w FROM benchmark), ig AS (SELECT item_id, {_GRAMS} AS g FROM itok),
sr AS (SELECT id, len(g) AS n_grams, unnest(g) AS gram FROM sg), ir AS (SELECT item_id, len(g) AS n_item, unnest(g) AS gram FROM ig)"""
PAIRS = f"""{_NGRAMS},
pairs AS (SELECT id, item_id, count(*) AS shared, count(*) * 1.0E0 / (any_value(n_grams) + any_value(n_item) - count(*)) AS overlap
  FROM sr JOIN ir USING (gram) GROUP BY 1, 2)"""
_AUDIT = f"""{PAIRS}, best AS (SELECT id, max(overlap) AS overlap FROM pairs GROUP BY 1),
audited AS (SELECT doc_id AS id, coalesce(overlap, 0.0) AS overlap, coalesce(overlap, 0.0) >= 0.3 AS flagged
  FROM documents LEFT JOIN best ON id = doc_id)"""


def _corpus(s, d):
    return table(s, d, "benchmark")


def _weights(s, d):
    return v.sample(s, d).groupBy("cwe").agg((F.length("cwe") * 7 + F.ascii("cwe") % 5).alias("weight"))


def _labelled(s, d):
    level = F.when(F.col("id") % 5 == 0, "Curated").when(F.col("id") % 3 == 0, "template").when(F.col("id") % 7 == 0, "reviewed").when(F.col("id") % 11 == 0, "odd")
    rows = v.sample(s, d).join(table(s, d, "labels").select(F.col("doc_id").alias("id"), (F.col("quality") == 1).alias("validation_passed")), "id", "left")
    return rows.withColumn("quality_level", level)


_LABELLED = f"""{v.SAMPLE}, lab AS (SELECT v_sample.*, quality = 1 AS validation_passed,
  CASE WHEN id % 5 = 0 THEN 'Curated' WHEN id % 3 = 0 THEN 'template' WHEN id % 7 = 0 THEN 'reviewed' WHEN id % 11 = 0 THEN 'odd' END AS quality_level
  FROM v_sample LEFT JOIN labels ON doc_id = id)"""
_RANK = "coalesce(CASE lower(quality_level) WHEN 'curated' THEN 4 WHEN 'template' THEN 3 WHEN 'reviewed' THEN 2 ELSE 1 END, 1)"
_SKEY = r"""array_to_string(list_transform(regexp_extract_all(code, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_]+'), lambda x: CASE WHEN regexp_matches(x, '^[\p{L}_]') THEN 'X' ELSE x END), '')"""


def _collections(s, d):
    rows = v.sample(s, d)
    return {"curated": rows.where("id % 3 = 0"), "template": rows.where("id % 3 <> 2"), "transformed": rows}


QUERIES = {
    "x03_char_ngrams": lambda s, d: _corpus(s, d).select("item_id", F.explode(c.char_ngrams(F.col("text"))).alias("gram")),
    "x04_token_ngrams": lambda s, d: c.ngram_rows(_corpus(s, d), "item_id", "text"),
    "u03_ngram_jaccard": lambda s, d: c.overlaps(v.sample(s, d), _corpus(s, d)),
    "j21_audit": lambda s, d: c.audit(v.sample(s, d), _corpus(s, d)),
    "a22_audit_summary": lambda s, d: c.audit_summary(c.audit(v.sample(s, d), _corpus(s, d))),
    "a23_fingerprint": lambda s, d: c.fingerprint(v.sample(s, d)),
    "a21_novelty": lambda s, d: c.novelty(v.sample(s, d), ["src0", "src1"], {"src2": "adapted_two", "src3": "adapted_three"}),
    "f04_temporal_filter": lambda s, d: c.temporal_halves(
        v.sample(s, d).select("id", F.format_string("CVE-%d-%d", F.col("id") % 9 + 2018, F.col("id")).alias("a")).withColumn("a", F.when(F.col("id") % 4 != 0, F.col("a"))), ["a"]
    )[0],
    "n10_cve_year": lambda s, d: v.sample(s, d).select("id", c.cve_year(F.lit("none"), F.format_string("x CVE-%d-1 y", F.col("id") % 9 + 2018)).alias("year")),
    "u07_complement": lambda s, d: c.temporal_halves(
        v.sample(s, d).select("id", F.when(F.col("id") % 3 > 0, F.format_string("CVE-%d-1", F.col("id") % 9 + 2018)).alias("a")), ["a"]
    )[1],
    "x12_swap_quotes": lambda s, d: table(s, d, "pages").select("page_id", F.md5(c.swap_quotes(F.col("html")).cast("binary")).alias("h")),
    "x13_restructure": lambda s, d: v.sample(s, d).select(
        "id", c.restructure(F.concat(F.lit("if not x:"), F.substring("code", 1, 50), F.lit("if ready == True:"))).alias("code")
    ),
    "h04_perturbation_hash": lambda s, d: v.sample(s, d).select("id", c.perturbation_hash(F.col("code")).alias("h")),
    "d01_exact": lambda s, d: k.exact_dedup(v.sample(s, d)).select("id"),
    "w01_exact_two_sources": lambda s, d: k.exact_dedup(v.sample(s, d), ["src1", "src2"]).select("id"),
    "d02_structural_key": lambda s, d: v.sample(s, d).select("id", F.md5(k.structural_key(F.col("code")).cast("binary")).alias("key")),
    "w02_structural": lambda s, d: k.structural_dedup(v.sample(s, d)).select("id"),
    "d06_normalised_equality": lambda s, d: v.sample(s, d).groupBy(F.md5(k.normalised(F.col("code")).cast("binary")).alias("key")).agg(F.count("*").alias("n")).where("n > 1"),
    "d07_without_comments": lambda s, d: v.sample(s, d).select("id", F.length(k.without_comments(F.col("code"))).alias("n")),
    "d08_hash_key": lambda s, d: v.sample(s, d).select("id", k.hash_key(F.col("cwe"), F.col("source"), code=F.col("code")).alias("key")),
    "w03_priority_dedup": lambda s, d: k.priority_dedup(_collections(s, d), F.md5(F.col("code").cast("binary"))).select("id", "collection"),
    "w04_quota": lambda s, d: k.quota_select(v.sample(s, d), _weights(s, d), 50).select("id", "picked"),
    "w05_stratified_sample": lambda s, d: k.stratified_sample(v.sample(s, d), 100).select("id", "cwe"),
    "w06_per_category": lambda s, d: k.first_by(v.sample(s, d), ["source"], k.hash_order("7"), 5).select("id", "source"),
    "w07_first_k": lambda s, d: k.first_by(v.sample(s, d), ["cwe"], ["ord"], 3).select("id", "cwe"),
    "o06_offset_limit": lambda s, d: v.sample(s, d).orderBy("ord").offset(20).limit(30).select("id"),
    "o09_shuffle": lambda s, d: v.sample(s, d).orderBy(*k.hash_order("42")).limit(25).select("id"),
    "f01_equality": lambda s, d: v.sample(s, d).where("difficulty = 'hard' AND cwe = 'de'").select("id"),
    "f02_exclusion": lambda s, d: k.exclude(v.sample(s, d), ["fr"], [1, 2, 3]).select("id"),
    "f03_usable_groups": lambda s, d: k.usable_groups(v.sample(s, d), ["en", "fr", "de"], 130)[1],
    "f05_quality_filter": lambda s, d: k.filter_quality(_labelled(s, d), "reviewed").select("id"),
    "f08_skip_invalid": lambda s, d: _labelled(s, d).where(F.coalesce("validation_passed", F.lit(True))).select("id"),
    "m09_confidence": lambda s, d: _labelled(s, d).select("id", k.confidence(F.col("quality_level")).alias("confidence")),
    "a18_quality_report": lambda s, d: k.quality_report(_labelled(s, d)),
    "a24_collection_stats": lambda s, d: k.collection_stats(v.sample(s, d), "cwe", "difficulty", "source"),
    "a25_drop_diagnostics": lambda s, d: k.top_drops(v.sample(s, d).withColumnRenamed("difficulty", "drop_type"), ["source"], 4),
    "a28_coverage_matrix": lambda s, d: k.coverage_matrix(v.sample(s, d), "source", "cwe", ["de", "en", "es", "fr"]),
    "a29_totals": lambda s, d: v.sample(s, d).groupBy("source").agg(F.count("*").alias("n")),
    "a34_duplicates": lambda s, d: k.duplicate_keys(v.sample(s, d).withColumn("h", F.md5(F.col("code").cast("binary"))), "cwe", "h"),
    "j16_merge_new": lambda s, d: k.merge_new(v.sample(s, d).where("id % 3 = 0"), v.sample(s, d).where("id % 2 = 0")).select("id"),
    "j17_top_up": lambda s, d: v.sample(s, d).join(v.sample(s, d).where("id % 2 = 0").select("id"), "id", "left_anti").orderBy(*k.hash_order("9")).limit(40).select("id"),
    "j20_enrichment": lambda s, d: v.sample(s, d).join(table(s, d, "labels").select(F.col("doc_id").alias("id"), "quality"), "id", "left").select("id", F.coalesce("quality", F.lit(-1)).alias("quality")),
    "u01_union": lambda s, d: v.sample(s, d).select("id", "source").unionByName(_corpus(s, d).select(F.col("item_id").alias("id")), allowMissingColumns=True),
    "u05_set_union": lambda s, d: v.sample(s, d).select("source").union(v.sample(s, d).select("cwe")).distinct(),
    "n07_ordered_distinct": lambda s, d: _corpus(s, d).select("item_id", F.array_join(F.array_distinct(F.split("text", " ")), " ").alias("words")),
}

_HASH = "md5('{seed}' || CAST(id AS VARCHAR)), id"
_SIZED = f"""WITH {v.SAMPLE}, q AS (SELECT *, row_number() OVER (PARTITION BY cwe ORDER BY {_HASH.format(seed=42)}) AS r,
  greatest(1, CAST(round_even(count(*) OVER (PARTITION BY cwe) * 1.0E0 / count(*) OVER () * 100, 0) AS INT)) AS quota FROM v_sample)
  SELECT id, cwe FROM q ORDER BY CAST(r > quota AS INT), {_HASH.format(seed=42)} LIMIT 100"""
_QUOTA = f"""WITH {v.SAMPLE}, w AS (SELECT DISTINCT cwe, length(cwe) * 7 + ascii(cwe) % 5 AS weight FROM v_sample),
  q AS (SELECT cwe, least(greatest(CAST(floor(weight * 50 * 1.0E0 / (SELECT sum(weight) FROM w)) AS BIGINT), 1), 20) AS quota FROM w),
  m AS (SELECT v_sample.*, quota, row_number() OVER (PARTITION BY cwe ORDER BY ord) <= quota AS picked FROM v_sample JOIN q USING (cwe)),
  r AS (SELECT *, row_number() OVER (PARTITION BY cwe ORDER BY {_HASH.format(seed=42)}) AS room FROM m WHERE NOT picked)
  SELECT id, picked FROM m WHERE picked UNION ALL SELECT id, picked FROM
  (SELECT * FROM r WHERE room <= 20 - quota ORDER BY {_HASH.format(seed=42)} LIMIT (SELECT greatest(0, 50 - count(*)) FROM m WHERE picked))"""


def _first(keys: str, order: str, n: int, columns: str, extra: str = "", where: str = "") -> str:
    return f"""WITH {v.SAMPLE}{extra} SELECT {columns} FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {order}) AS r
      FROM v_sample {where}) WHERE r <= {n}"""


ORACLE = {
    "x03_char_ngrams": r"""WITH t AS (SELECT item_id, regexp_replace(lower(text), '\s+', ' ', 'g') AS t FROM benchmark)
      SELECT item_id, unnest(list_distinct(list_transform(range(1, greatest(length(t) - 3, 1)), lambda i: substring(t, i, 5)))) AS gram FROM t""",
    "x04_token_ngrams": f"WITH {_NGRAMS} SELECT item_id, n_item AS n_grams, gram FROM ir",
    "u03_ngram_jaccard": f"WITH {PAIRS} SELECT * FROM pairs",
    "j21_audit": f"WITH {_AUDIT} SELECT * FROM audited",
    "a22_audit_summary": f"""WITH {_AUDIT} SELECT count(*) AS total, count(*) FILTER (WHERE flagged) AS flagged,
      avg(CAST(flagged AS INT)) AS rate, avg(overlap) AS avg_overlap FROM audited""",
    "a23_fingerprint": f"WITH {_NGRAMS} SELECT gram, count(*) AS df FROM sr GROUP BY 1 HAVING count(*) >= 3 ORDER BY df DESC, gram LIMIT 10000",
    "a21_novelty": """WITH b AS (SELECT CASE WHEN source IN ('src0', 'src1') THEN 'novel' WHEN source = 'src2' THEN 'adapted_two'
      WHEN source = 'src3' THEN 'adapted_three' ELSE 'adapted_other' END AS bucket FROM documents)
      SELECT bucket, count(*) AS n, count(*) * 1.0E0 / (SELECT count(*) FROM b) AS ratio,
        (SELECT count(*) FILTER (WHERE bucket = 'novel') * 1.0E0 / count(*) FROM b) >= 0.3 AS enough_novel FROM b GROUP BY 1""",
    "f04_temporal_filter": """SELECT doc_id AS id, CASE WHEN doc_id % 4 <> 0 THEN 'CVE-' || (doc_id % 9 + 2018) || '-' || doc_id END AS a
      FROM documents WHERE doc_id % 4 = 0 OR doc_id % 9 + 2018 >= 2024""",
    "n10_cve_year": "SELECT doc_id AS id, CAST(doc_id % 9 + 2018 AS INT) AS year FROM documents",
    "u07_complement": "SELECT doc_id AS id, 'CVE-' || (doc_id % 9 + 2018) || '-1' AS a FROM documents WHERE doc_id % 3 > 0 AND doc_id % 9 + 2018 < 2024",
    "x12_swap_quotes": r"""SELECT page_id, md5(regexp_replace(html, '"([^"\\'']+)"', '''\1''', 'g')) AS h FROM pages""",
    "x13_restructure": r"""SELECT doc_id AS id, regexp_replace(regexp_replace('if not x:' || substring(text, 1, 50) || 'if ready == True:',
      'if not ([0-9A-Za-z_]+):', 'if \1 is None or not \1:', 'g'), 'if ([0-9A-Za-z_]+) == True:', 'if \1:', 'g') AS code FROM documents""",
    "h04_perturbation_hash": "SELECT doc_id AS id, substring(sha256(text), 1, 16) AS h FROM documents",
    "d01_exact": _first("cwe, source, code", "ord", 1, "id"),
    "w01_exact_two_sources": f"{_first('cwe, source, code', 'ord', 1, 'id', '', '''WHERE source IN ('src1', 'src2')''')} UNION ALL SELECT id FROM v_sample WHERE source NOT IN ('src1', 'src2')",
    "d02_structural_key": f"WITH {v.SAMPLE} SELECT id, md5({_SKEY}) AS key FROM v_sample",
    "w02_structural": _first("cwe, source, key", "ord", 2, "id").replace(
        "FROM v_sample ", f"FROM (SELECT *, {_SKEY} AS key FROM v_sample) "
    ),
    "d06_normalised_equality": r"SELECT md5(regexp_replace(text, '\s+', '', 'g')) AS key, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1",
    "d07_without_comments": r"""SELECT doc_id AS id, length(regexp_replace(regexp_replace(regexp_replace(text, '(?s)""" + '"""' + r""".*?""" + '"""' + r"""|''''''.*?''''''', '', 'g'),
      '(?m)#.*$', '', 'g'), '\s+', '', 'g')) AS n FROM documents""",
    "d08_hash_key": "SELECT doc_id AS id, lang || '_' || source || '_' || substring(md5(text), 1, 8) AS key FROM documents",
    "w03_priority_dedup": f"""WITH {v.SAMPLE}, e AS (SELECT *, 'curated' AS collection, 0 AS p FROM v_sample WHERE id % 3 = 0
      UNION ALL SELECT *, 'template', 1 FROM v_sample WHERE id % 3 <> 2 UNION ALL SELECT *, 'transformed', 2 FROM v_sample)
      SELECT id, collection FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY p, ord) AS r FROM e) WHERE r = 1""",
    "w04_quota": _QUOTA,
    "w05_stratified_sample": _SIZED,
    "w06_per_category": _first("source", _HASH.format(seed=7), 5, "id, source"),
    "w07_first_k": _first("cwe", "ord", 3, "id, cwe"),
    "o06_offset_limit": "SELECT doc_id AS id FROM documents ORDER BY doc_id LIMIT 30 OFFSET 20",
    "o09_shuffle": f"WITH {v.SAMPLE} SELECT id FROM v_sample ORDER BY {_HASH.format(seed=42)} LIMIT 25",
    "f01_equality": "SELECT doc_id AS id FROM documents WHERE n_chars >= 5000 AND lang = 'de'",
    "f02_exclusion": "SELECT doc_id AS id FROM documents WHERE lang <> 'fr' AND doc_id NOT IN (1, 2, 3)",
    "f03_usable_groups": """SELECT lang AS cwe, count(*) AS n, concat_ws(', ', CASE WHEN lang NOT IN ('en', 'fr', 'de') THEN 'no operators' END,
      CASE WHEN count(*) < 130 THEN 'only ' || count(*) || ' samples' END) AS reason FROM documents GROUP BY 1 HAVING reason <> ''""",
    "f05_quality_filter": f"WITH {_LABELLED} SELECT id FROM lab WHERE {_RANK} >= 2 AND coalesce(validation_passed, true)",
    "f08_skip_invalid": f"WITH {_LABELLED} SELECT id FROM lab WHERE coalesce(validation_passed, true)",
    "m09_confidence": f"""WITH {_LABELLED} SELECT id, CAST(coalesce(CASE lower(quality_level) WHEN 'template' THEN 0.95 WHEN 'curated' THEN 0.99
      WHEN 'reviewed' THEN 0.80 ELSE 0.50 END, 0.50) AS DOUBLE) AS confidence FROM lab""",
    "a18_quality_report": f"""WITH {_LABELLED} SELECT 'level' AS dimension, coalesce(quality_level, 'unknown') AS value, count(*) AS n FROM lab GROUP BY 2
      UNION ALL SELECT 'source', source, count(*) FROM lab GROUP BY 2
      UNION ALL SELECT 'validation', CASE WHEN coalesce(validation_passed, true) THEN 'passed' ELSE 'failed' END, count(*) FROM lab GROUP BY 2""",
    "a24_collection_stats": f"WITH {v.SAMPLE} " + " UNION ALL ".join(f"SELECT '{x}' AS dimension, {x} AS value, count(*) AS n FROM v_sample GROUP BY {x}" for x in ("cwe", "difficulty", "source")),
    "a25_drop_diagnostics": f"""WITH {v.SAMPLE} SELECT drop_type, source, n FROM (SELECT *, row_number() OVER (PARTITION BY drop_type ORDER BY n DESC, source) AS r FROM
      (SELECT difficulty AS drop_type, source, count(*) AS n FROM v_sample GROUP BY 1, 2)) WHERE r <= 4""",
    "a28_coverage_matrix": "SELECT source, " + ", ".join(f"count(*) FILTER (WHERE lang = '{x}') AS {x}" for x in ("de", "en", "es", "fr")) + " FROM documents GROUP BY 1",
    "a29_totals": "SELECT source, count(*) AS n FROM documents GROUP BY 1",
    "a34_duplicates": """SELECT lang AS cwe, md5(text) AS h, count(*) AS n, array_to_string(list_sort(list(doc_id)), ',') AS ids FROM documents
      GROUP BY 1, 2 HAVING count(*) > 1""",
    "j16_merge_new": "SELECT doc_id AS id FROM documents WHERE doc_id % 3 = 0 OR doc_id % 2 = 0",
    "j17_top_up": f"WITH {v.SAMPLE} SELECT id FROM v_sample WHERE id % 2 <> 0 ORDER BY {_HASH.format(seed=9)} LIMIT 40",
    "j20_enrichment": "SELECT documents.doc_id AS id, coalesce(quality, -1) AS quality FROM documents LEFT JOIN labels USING (doc_id)",
    "u01_union": "SELECT doc_id AS id, source FROM documents UNION ALL SELECT item_id, NULL FROM benchmark",
    "u05_set_union": "SELECT source FROM documents UNION SELECT lang FROM documents",
    "n07_ordered_distinct": """WITH w AS (SELECT item_id, string_split(text, ' ') AS w FROM benchmark), p AS
      (SELECT item_id, unnest(w) AS x, unnest(range(0, len(w))) AS i FROM w), f AS (SELECT item_id, x, min(i) AS i FROM p GROUP BY 1, 2)
      SELECT item_id, string_agg(x, ' ' ORDER BY i) AS words FROM f GROUP BY 1""",
}
