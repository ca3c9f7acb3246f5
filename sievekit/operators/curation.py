"""Deduplication, selection and filters of a sample collection; order is always explicit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rank of quality levels from worst to best, and the confidence that each gives.
LEVELS = ("auto", "reviewed", "template", "curated")
CONFIDENCE = {"template": 0.95, "curated": 0.99, "reviewed": 0.80, "auto": 0.50}
PRIORITY = ("curated", "template", "transformed")


def first_by(rows: DataFrame, keys: list, order: list, n: int = 1) -> DataFrame:
    """The first n rows of each group."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")


def exact_dedup(samples: DataFrame, sources: list[str] | None = None) -> DataFrame:
    """One row for equal code within (cwe, source), told by its digest; sources limits what is deduplicated."""
    keys = ["cwe", "source", F.sha2(F.col("code").cast("binary"), 256)]
    if sources is None:
        return first_by(samples, keys, ["ord"])
    mine = F.coalesce(F.col("source").isin(*sources), F.lit(False))
    return samples.where(~mine).unionByName(first_by(samples.where(mine), keys, ["ord"]))


def structural_key(code: Column) -> Column:
    """Code with every identifier-like word as X."""
    return F.regexp_replace(code, r"(?<![\p{L}\p{N}_])[\p{L}_][\p{L}\p{N}_]*", "X")


def structural_dedup(samples: DataFrame, most: int = 2) -> DataFrame:
    """At most so many rows of one structure within (cwe, source)."""
    keyed = samples.withColumn("_key", F.md5(structural_key(F.col("code")).cast("binary")))
    return first_by(keyed, ["cwe", "source", "_key"], ["ord"], most).drop("_key")


def hash_key(*parts: Column, code: Column) -> Column:
    """Parts and eight digits of the code's hash."""
    return F.concat_ws("_", *parts, F.substring(F.md5(code.cast("binary")), 1, 8))


def priority_dedup(collections: dict[str, DataFrame], key: Column) -> DataFrame:
    """Union of collections; of rows with one key that of the first name in PRIORITY, then of least ord."""
    names = [n for n in PRIORITY if n in collections] + sorted(set(collections) - set(PRIORITY))
    parts = [collections[n].withColumns({"collection": F.lit(n), "_p": F.lit(k)}) for k, n in enumerate(names)]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part, allowMissingColumns=True)
    return first_by(every.withColumn("_key", key), ["_key"], ["_p", "ord"]).drop("_p", "_key")


def normalised(code: Column) -> Column:
    """Code without white space."""
    return F.regexp_replace(code, r"\s+", "")


def without_comments(code: Column) -> Column:
    """Code without comments, docstrings and white space."""
    bare = F.regexp_replace(code, r"(?s)\"\"\".*?\"\"\"|'''.*?'''", "")
    return normalised(F.regexp_replace(bare, r"(?m)#.*$", ""))


def quota_select(samples: DataFrame, weights: DataFrame, target: int, cap: int = 20, seed: str = "42") -> DataFrame:
    """Weighted quotas by cwe, then a top-up in hash order within the cap.

    A cwe's quota is min(max(1, floor(weight * target / all weights)), rows, cap).
    """
    total = weights.agg(F.sum("weight").alias("_all"))
    quotas = weights.crossJoin(F.broadcast(total)).select(
        "cwe", F.least(F.greatest(F.floor(F.col("weight") * target / F.col("_all")), F.lit(1)), F.lit(cap)).alias("quota")
    )
    # Constant bounds on the ranks let each task keep its own first rows before the shuffle.
    ranked = samples.withColumn("_rank", F.row_number().over(W.partitionBy("cwe").orderBy("ord"))).where(F.col("_rank") <= cap)
    picked = ranked.join(quotas, "cwe").where(F.col("_rank") <= F.col("quota")).select(*samples.columns)
    # Past the quota a cwe has room up to the cap; of those the first in hash order fill what lacks.
    # A cwe's first 2 * cap in hash order hold cap that are not picked, if it has so many.
    order = hash_order(seed)
    late = samples.withColumn("_late", F.row_number().over(W.partitionBy("cwe").orderBy(*order))).where(F.col("_late") <= 2 * cap)
    rest = late.join(picked.select("id"), "id", "left_anti").join(quotas, "cwe", "left")
    rest = rest.withColumn("_room", F.row_number().over(W.partitionBy("cwe").orderBy("_late")))
    rest = rest.where(F.col("_room") <= cap - F.coalesce("quota", F.lit(0))).orderBy(*order).limit(target)
    lacking = picked.agg((F.lit(target) - F.count("*")).alias("_lacking"))
    rest = rest.withColumn("_nth", F.row_number().over(W.orderBy(*order))).crossJoin(F.broadcast(lacking)).where(F.col("_nth") <= F.col("_lacking"))
    return picked.withColumn("picked", F.lit(True)).unionByName(rest.select(*samples.columns, F.lit(False).alias("picked")))


def hash_order(seed: str, key: str = "id") -> list[Column]:
    """A shuffle that any engine can repeat: by the hash of seed and key."""
    return [F.md5(F.concat(F.lit(seed), F.col(key).cast("string")).cast("binary")), F.col(key)]


def stratified_sample(samples: DataFrame, k: int, key: str = "cwe", seed: str = "42") -> DataFrame:
    """k rows, of each group its share and one at least; trimmed or topped up in hash order."""
    order = hash_order(seed)
    sizes = samples.groupBy(key).agg(F.count("*").alias("_n"))
    total = samples.agg(F.count("*").alias("_all"))
    # No group gives more than k rows, which lets each task keep its own first ones before the shuffle.
    ranked = samples.withColumn("_rank", F.row_number().over(W.partitionBy(key).orderBy(*order))).where(F.col("_rank") <= k)
    shares = sizes.crossJoin(F.broadcast(total)).select(
        key, F.greatest(F.lit(1), F.bround(F.col("_n") * 1.0 / F.col("_all") * k).cast("int")).alias("_quota")
    )
    marked = ranked.join(shares, key).withColumn("_late", (F.col("_rank") > F.col("_quota")).cast("int"))
    return marked.orderBy("_late", *order).limit(k).select(*samples.columns)


def usable_groups(samples: DataFrame, mapped: list[str], least: int) -> tuple[DataFrame, DataFrame]:
    """Rows of groups that are mapped and large enough; and for each other group why it went."""
    sizes = samples.groupBy("cwe").agg(F.count("*").alias("n"))
    why = sizes.withColumn(
        "reason",
        F.concat_ws(
            ", ",
            F.when(~F.col("cwe").isin(*mapped), "no operators"),
            F.when(F.col("n") < least, F.format_string("only %d samples", "n")),
        ),
    )
    good = why.where("reason = ''").select("cwe")
    return samples.join(good, "cwe", "left_semi"), why.where("reason <> ''")


def exclude(samples: DataFrame, cwes: list[str], ids: list) -> DataFrame:
    """Rows of none of the cwes and ids."""
    return samples.where(~F.coalesce(F.col("cwe").isin(*cwes), F.lit(False)) & ~F.coalesce(F.col("id").isin(*ids), F.lit(False)))


def merge_new(existing: DataFrame, new: DataFrame, key: str = "id", order: str = "ord") -> DataFrame:
    """existing and those of new (one a key) whose key it lacks."""
    fresh = first_by(new, [key], [order]).join(existing.select(key), key, "left_anti")
    return existing.unionByName(fresh)


def quality_rank(level: Column) -> Column:
    """Place of a level in LEVELS; unknown ones count as the worst."""
    return F.greatest(F.array_position(F.array(*map(F.lit, LEVELS)), F.lower(level)), F.lit(1))


def filter_quality(samples: DataFrame, least: str, need_valid: bool = True) -> DataFrame:
    """Rows of a level and better; validation that is missing counts as passed."""
    good = F.coalesce(quality_rank(F.col("quality_level")), F.lit(1)) >= LEVELS.index(least) + 1
    return samples.where(good & F.coalesce("validation_passed", F.lit(True))) if need_valid else samples.where(good)


def filter_and_count(samples: DataFrame, least: str, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """Rows of a level and better that are valid (and with strict without warnings), and counts by level of all rows before that.

    Columns: quality_level, validation_passed, warnings (an array).
    """
    level = F.lower(F.coalesce("quality_level", F.lit(LEVELS[0])))
    counts = samples.groupBy(level.alias("level")).agg(F.count("*").alias("n"))
    kept = filter_quality(samples, least)
    return (kept.where(F.greatest(F.size("warnings"), F.lit(0)) == 0) if strict else kept), counts


def confidence(level: Column) -> Column:
    """The confidence that a level gives."""
    out = F.lit(CONFIDENCE["auto"])
    for name, value in CONFIDENCE.items():
        out = F.when(F.lower(level) == name, value).otherwise(out)
    return out


def quality_report(samples: DataFrame) -> DataFrame:
    """Counts by level, source and validation: columns dimension, value, n."""
    passed = F.when(F.coalesce("validation_passed", F.lit(True)), "passed").otherwise("failed")
    parts = {
        "level": F.coalesce("quality_level", F.lit("unknown")),
        "source": F.coalesce("source", F.lit("unknown")),
        "validation": passed,
    }
    pairs = F.array(*(F.struct(F.lit(k).alias("dimension"), x.alias("value")) for k, x in parts.items()))
    rows = samples.select(F.explode(pairs).alias("x"))
    return rows.groupBy("x.dimension", "x.value").agg(F.count("*").alias("n"))


def duplicate_keys(samples: DataFrame, *keys: str) -> DataFrame:
    """Keys of several rows, with the ids that have them."""
    return samples.groupBy(*keys).agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_list("id")), ",").alias("ids")).where("n > 1")


def collection_stats(samples: DataFrame, *keys: str) -> DataFrame:
    """Counts by each key on its own: dimension, value, n; one pass."""
    pairs = F.array(*(F.struct(F.lit(k).alias("dimension"), F.coalesce(F.col(k).cast("string"), F.lit("unknown")).alias("value")) for k in keys))
    return samples.select(F.explode(pairs).alias("x")).groupBy("x.dimension", "x.value").agg(F.count("*").alias("n"))


def coverage_matrix(samples: DataFrame, row: str, column: str, values: list[str]) -> DataFrame:
    """Counts of row by column's values, 0 where there is none."""
    return samples.groupBy(row).pivot(column, values).count().fillna(0)


def top_drops(drops: DataFrame, keys: list[str], n: int = 10) -> DataFrame:
    """The n most frequent causes within each type of drop."""
    counts = drops.groupBy("drop_type", *keys).agg(F.count("*").alias("n"))
    return first_by(counts, ["drop_type"], [F.desc("n"), *keys], n)
