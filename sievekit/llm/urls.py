"""URL filters: ordered prefix rules, then a cascade of Bloom filters.

Level 0 of the cascade encodes the listed keys; level 1 encodes those keys of the
corpus that level 0 hits though they are not listed; level 2 the listed keys that level
1 hits, and so on, until a level has no false positive. Over the complete universe of
keys the parity of the first level that misses is exact membership, and the test of a
page is an expression of built-in functions, without a join.

A key is a host or one of its parent domains; a url is blocked when any of its keys is
listed. Level 0's rate of false positives follows from the two counts, so that it hits some
sqrt(2) times as many other keys as there are listed ones, however large the corpus: all
levels are in proportion to the list, and grow with the logarithm of the corpus only. A
list of more than MAX_KEYS keys is split by hash, and the pages go through one share's
cascade after the other, so that no plan carries more than one share's literals.

Defined results: a null url, or one without "://", has an empty host and path, fits no
rule and is allowed; repeated rows are judged once each; an empty list allows all that
no rule blocks; null keys of the list are left out; columns host, path, rule and verdict of
the pages are replaced by the results', further ones are kept as they are.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievekit.llm.common import materialize

#: (verdict, host, path): fixed values of the production query.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: The production query's list of blocked domains.
BLOCKED = tuple(
    f"{name}.example.{top}"
    for name in ("spam-farm", "cheap-pills", "casino-bonus", "link-wheel")
    for top in ("com", "net", "org")
)
#: Most listed keys of one cascade; its literals stay under some 8 MB.
MAX_KEYS = 1 << 20
#: Share of false positives of the levels but the first, and the least of that.
RATE, LEAST_RATE = 1 / 8, 2.0**-40

_URL = r"://([^/?#]*)([^?#]*)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """The host in lower case (A-Z), or empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """The path, or empty."""
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def matching_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, as text, and its verdict; null if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, h, p in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r[1], r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule = F.when(fits, F.lit(h + p)).otherwise(rule)
        verdict = F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def keys_of(host: Column) -> Column:
    """The host and its parent domains, as an array."""
    parts = F.split(host, r"\.")
    return F.transform(
        F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), ".")
    )


@dataclass(frozen=True)
class Level:
    """One Bloom filter: its bits as 64-bit words."""

    salt: int
    bits: int
    hashes: int
    words: tuple[int, ...]

    def places(self, key: Column) -> list[Column]:
        return [F.pmod(F.xxhash64(key, F.lit(self.salt), F.lit(k)), F.lit(self.bits)) for k in range(self.hashes)]

    def hits(self, key: Column) -> Column:
        """Whether all of the key's bits are set."""
        words = F.from_json(F.lit(json.dumps(self.words)), "array<bigint>")
        out = F.lit(True)
        for place in self.places(key):
            word = F.get(words, F.shiftright(place, 6).cast("int"))
            out = out & (F.getbit(word, (place % 64).cast("int")) == 1)
        return out


def build_level(keys: DataFrame, n: int, salt: int, rate: float) -> Level:
    """The Bloom filter of n keys (column key)."""
    bits = max(64, math.ceil(-n * math.log(rate) / math.log(2) ** 2))
    bare = Level(salt, bits, max(1, round(bits / n * math.log(2))), ())
    place = F.explode(F.array(*bare.places(F.col("key"))))
    rows = (
        keys.select(place.alias("place"))
        .groupBy(F.shiftright("place", 6).alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(place % 64 as int))")).alias("bits"))
        .collect()
    )
    words = [0] * (bits // 64 + 1)
    for row in rows:
        words[row["word"]] = row["bits"]
    return Level(salt, bits, bare.hashes, tuple(words))


def first_rate(listed: int, others: int) -> float:
    """Share of the other keys that level 0 may hit: about sqrt(2) times as many as are listed."""
    return min(RATE, max(LEAST_RATE, math.sqrt(2) * listed / max(others, 1)))


def cascade(universe: DataFrame, listed: DataFrame) -> list[Level]:
    """Levels that give exact membership of listed for all keys of universe.

    Both have one column, key. listed should have MAX_KEYS keys at most: see shares().
    """
    listed = materialize(listed.where(F.col("key").isNotNull()).distinct(), "listed")
    others = universe.join(listed, "key", "left_anti")
    sides, sizes = [listed, others], [listed.count(), others.count()]
    rate = first_rate(*sizes)
    levels: list[Level] = []
    while True:
        side = len(levels) % 2
        n = sizes[side]
        if n == 0:
            return levels
        level = build_level(sides[side], n, len(levels), RATE if levels else rate)
        levels.append(level)
        sides[1 - side] = materialize(sides[1 - side].where(level.hits(F.col("key"))), "hit")
        sizes[1 - side] = sides[1 - side].count()


def share_of(key: Column, n: int) -> Column:
    """The share that a key is dealt to."""
    return F.pmod(F.xxhash64(key, F.lit("share")), F.lit(n))


def is_listed(levels: Sequence[Level], key: Column) -> Column:
    """Exact membership: the parity of the first level that misses."""
    out = F.lit(len(levels) % 2 == 1)
    for k in range(len(levels) - 1, -1, -1):
        out = F.when(levels[k].hits(key), out).otherwise(F.lit(k % 2 == 1))
    return out


def universe_of(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """All distinct keys of the pages' hosts."""
    hosts = pages.select(host_of(F.col(url_col)).alias("host")).distinct()
    return hosts.select(F.explode(keys_of(F.col("host"))).alias("key")).distinct()


def _any_listed(levels: Sequence[Level], keys: Column) -> Column:
    return F.exists(keys, lambda key: is_listed(levels, key))


def _in_share(k: int, n: int) -> Callable[[Column], Column]:
    return lambda key: share_of(key, n) == k


def judge(
    pages: DataFrame,
    listed: DataFrame,
    rules: Sequence[tuple[str, str, str]] = RULES,
    url_col: str = "url",
    max_keys: int = MAX_KEYS,
) -> DataFrame:
    """Add host, path, rule, verdict to each page. listed: column key."""
    listed = listed.select("key").where(F.col("key").isNotNull())
    listed = materialize(listed.distinct(), "listed")
    shares = max(1, -(-listed.count() // max_keys))
    universe = materialize(universe_of(pages, url_col), "universe")
    url = F.col(f"`{url_col}`")
    kept = [F.col(f"`{c}`") for c in pages.columns if c not in ("host", "path", "rule", "verdict") or c == url_col]
    hit = "__listed"
    out = pages.select(*kept, host_of(url).alias("host"), path_of(url).alias("path"), F.lit(False).alias(hit))
    for k in range(shares):
        if shares == 1:
            found = _any_listed(cascade(universe, listed), keys_of(F.col("host")))
        else:
            own = share_of(F.col("key"), shares) == k
            keys = F.filter(keys_of(F.col("host")), _in_share(k, shares))
            found = _any_listed(cascade(universe.where(own), listed.where(own)), keys)
        out = out.withColumn(hit, F.col(hit) | found)
        if k + 1 < shares:
            out = materialize(out, "judged")
    rule, said = matching_rule(F.col("host"), F.col("path"), rules)
    verdict = F.coalesce(said, F.when(F.col(hit), F.lit("block")).otherwise(F.lit("allow")))
    return out.withColumns({"rule": rule, "verdict": verdict}).drop(hit)


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's url."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    listed = spark.createDataFrame([(k,) for k in BLOCKED], "key string")
    return judge(pages, listed).select("page_id", "host", "path", "rule", "verdict")


def _oracle() -> str:
    rules = sorted(RULES, key=lambda r: (-len(r[1]) - len(r[2]), r[1], r[2]))
    fits = [(f"(host = '{h}' OR suffix(host, '.{h}')) AND starts_with(path, '{p}')", h + p, v) for v, h, p in rules]
    rule = " ".join(f"WHEN {c} THEN '{r}'" for c, r, _ in fits)
    said = " ".join(f"WHEN {c} THEN '{v}'" for c, _, v in fits)
    listed = " OR ".join(f"host = '{k}' OR suffix(host, '.{k}')" for k in BLOCKED)
    return f"""
WITH parts AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(url, '{_URL}', 1), ''), '{_UPPER}', '{_LOWER}') AS host,
    coalesce(regexp_extract(url, '{_URL}', 2), '') AS path
  FROM pages
)
SELECT page_id, host, path,
  CASE {rule} END AS rule,
  CASE {said} WHEN {listed} THEN 'block' ELSE 'allow' END AS verdict
FROM parts
"""


QUERIES = {"op10_url_filters": op10_url_filters}
ORACLE = {"op10_url_filters": _oracle()}
