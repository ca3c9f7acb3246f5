"""URL filters against plain Python."""

import random
import re

from pyspark.sql import functions as F

from sievekit.llm.urls import RULES, cascade, is_listed, judge, op10_url_filters

URLS = [
    None, "", "no scheme", "http://A.Example.COM/en/x?y#z", "http://www.example.com/en/", "https://example.net/es/1", "http://x.net", "http://net/es/",
    "http://spam-farm.example.org/q", "http://a.spam-farm.example.org:80/", "ftp://xspam-farm.example.org/", "http://h?://b/en/", "http://a.com#x", "http://a.com/", "http://ÄB.org/é",
]


def verdict(url, listed):
    m = re.search(r"://([^/?#]*)([^?#]*)", url or "")
    host = re.sub("[A-Z]", lambda c: c[0].lower(), m[1]) if m else ""
    path = m[2] if m else ""
    fits = [(len(h + p), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fits:
        return host, path, max(fits)[1], max(fits)[2]
    parts = host.split(".")
    hit = any(".".join(parts[k:]) in listed for k in range(len(parts)))
    return host, path, None, "block" if hit else "allow"


def test_equals_plain_python(spark):
    rng = random.Random(1)
    hosts = [f"{'www.' * (k % 2)}h{k}.{rng.choice(['org', 'io', 'net'])}" for k in range(600)]
    listed = {h.removeprefix("www.") for h in hosts[::7]} | {"spam-farm.example.org", "absent.org"}
    rows = [(k, u, "clash") for k, u in enumerate(URLS + [f"http://{h}/p{k}" for k, h in enumerate(hosts)])]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, other string").repartition(3)
    keys = spark.createDataFrame([(k,) for k in [*listed, *sorted(listed)[:3], None]], "key string")
    want = {k: verdict(u, listed) for k, u, _ in rows}
    for most in (1000, 40):
        got = judge(pages, keys, max_keys=most)
        assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got.collect()} == want


def test_cascade_is_exact(spark):
    universe = spark.range(20_000).select(F.format_string("key%d", "id").alias("key"))
    listed = universe.where("pmod(xxhash64(key), 11) = 0")
    levels = cascade(universe, listed)
    assert len(levels) > 2
    wrong = universe.select(is_listed(levels, F.col("key")).alias("got"), F.expr("pmod(xxhash64(key), 11) = 0").alias("want")).where("got <> want")
    assert wrong.count() == 0


def test_levels_follow_the_list_not_the_corpus(spark):
    universe = spark.range(300_000).select(F.format_string("key%d", "id").alias("key"))
    listed = spark.range(0, 300_000, 3000).select(F.format_string("key%d", "id").alias("key"))
    levels = cascade(universe, listed)
    assert sum(v.bits for v in levels) < 100 * 50 and len(levels) > 2
    assert universe.where(is_listed(levels, F.col("key"))).count() == 100


def test_a_hundred_thousand_keys_in_two_shares(spark):
    hosts = spark.range(250_000).select(F.col("id").alias("page_id"), F.format_string("http://www.h%d.org/x", "id").alias("url"))
    hosts = hosts.withColumns({"host": F.lit("clash"), "rule": F.lit(1)})
    listed = spark.range(0, 500_000, 5).select(F.format_string("h%d.org", "id").alias("key"))
    got = judge(hosts, listed, max_keys=60_000)
    assert got.columns == ["page_id", "url", "host", "path", "rule", "verdict"]
    wrong = got.where((F.col("verdict") == "block") != (F.col("page_id") % 5 == 0))
    assert wrong.count() == 0 and got.where("verdict = 'block'").count() == 50_000


def test_null_list(spark):
    pages = spark.createDataFrame([(1, "http://a.org/")], "page_id bigint, url string")
    assert judge(pages, spark.createDataFrame([(None,)], "key string")).first().verdict == "allow"


def test_empty(spark, tmp_path):
    assert cascade(spark.createDataFrame([], "key string"), spark.createDataFrame([], "key string")) == []
    spark.createDataFrame([], "page_id bigint, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert op10_url_filters(spark, str(tmp_path)).count() == 0
