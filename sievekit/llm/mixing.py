"""Mixing sources to target weights: subset-sum budget fitting.

A document's size is its number of words. Sources in order of their names share a budget by
weight; none takes more than MOST times its own size, and what is above that goes to the
others by weight until none is above. A source takes all its documents as often as fits its
target, and of the rest of the target documents counted by exact size: of each size the same
share, then one more of some sizes, and the last words by a bounded knapsack over sizes and
counts: up to DP_WORDS it comes as near as any choice of what is left; where documents are so
long that more words are left, long ones are dealt in coarser units first. Which documents of a
size go in is up to a seeded hash of their ids.

A size's documents are told apart by their place in one order over all documents, dealt by
ranges, so no task holds a source or a size. A source's sizes meet in one task: distinct sizes
add up to no more than its words, so W words have at most sqrt(2 * W) of them.

Defined results: a null or empty text, or one without words, has size 0 and takes 0 words; a
null source is a source and comes last; null ids are hashed like others; repeated rows are
documents of their own, any of which may go in; a source without words has target 0; an empty
table gives no row. Further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievekit.llm.common import looked_up, materialize, numbered

#: Weights of the sources in order, repeated; share of all words that the mix has; most times that a document goes in.
WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2
#: Words of a source's budget that the knapsack may decide on.
DP_WORDS = 1 << 16
SEED = 42
#: Most rows (a source and a size each, of fixed length) that are broadcast.
MAX_BROADCAST = 200_000

_WORDS = r"[^\x20\x09-\x0D]+"


def knapsack(sizes: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many of each size make the sum nearest to the budget (ties: the smaller sum); time and memory grow with the budget."""
    take = np.zeros(len(sizes), dtype=np.int64)
    some = counts > 0
    if budget <= 0 or not some.any():
        return take
    # A sum above the budget by more than the largest size, or by more than the budget, is never nearest.
    width = budget + 1 + min(int(sizes[some].max()), budget)
    reach = np.zeros(width, dtype=bool)
    reach[0] = True
    by = np.full(width, -1, dtype=np.int32)
    chunks: list[tuple[int, int]] = []
    for k in np.argsort(-counts, kind="stable").tolist():
        size = int(sizes[k])
        left, part = min(int(counts[k]), (width - 1) // size), 1
        while left > 0 and not reach[budget]:
            n = min(part, left)
            left, part = left - n, part * 2
            new = reach[: width - n * size] & ~reach[n * size :]
            by[n * size :][new] = len(chunks)
            reach[n * size :] |= new
            chunks.append((k, n))
        if reach[budget]:
            break
    sums = np.flatnonzero(reach)
    at = int(sums[np.abs(sums - budget).argmin()])
    while at:
        k, n = chunks[by[at]]
        take[k] += n
        at -= n * int(sizes[k])
    return take


def fit(sizes: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each size (distinct, above 0) go in, so that their words come near the budget."""
    sizes, counts = sizes.astype(np.int64), counts.astype(np.int64)
    total = int((sizes * counts).sum())
    if budget >= total:
        return counts.copy()
    # The knapsack decides on some of the longest documents too, so that they don't spoil the sum.
    reserve = max(0, min(budget, max(DP_WORDS // 2, 4 * int(sizes.max(initial=0)))))
    share = counts * ((budget - reserve) / total) if total else counts * 0.0
    take = np.minimum(share.astype(np.int64), counts)
    rest = budget - int((take * sizes).sum())
    more = np.argsort(take - share, kind="stable")
    more = more[take[more] < counts[more]]
    sums = np.cumsum(sizes[more])
    fits = int(np.searchsorted(sums, rest - reserve, "right"))
    if fits:
        take[more[:fits]] += 1
        rest -= int(sums[fits - 1])
    return take + _nearest(sizes, counts - take, rest)


def _nearest(sizes: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """knapsack() up to DP_WORDS; beyond, long documents are dealt in coarser units first, with and without words kept back for the others."""
    if budget <= DP_WORDS:
        return knapsack(sizes, counts, budget)
    unit = -(-budget // DP_WORDS)
    long = np.where(sizes >= 8 * unit, counts, 0)
    best, apart = np.zeros(len(sizes), dtype=np.int64), budget
    for kept in (0, DP_WORDS // 2):
        take = knapsack((sizes + unit // 2) // unit, long, (budget - kept) // unit)
        rest = budget - int((take * sizes).sum())
        if 0 < rest <= DP_WORDS:
            take = take + knapsack(sizes, counts - take, rest)
            rest = budget - int((take * sizes).sum())
        if abs(rest) < apart:
            best, apart = take, abs(rest)
    return best


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED) -> DataFrame:
    """doc_id, source, size, and the document's seeded hash; written."""
    return materialize(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.col(source_col).alias("source"),
            F.coalesce(F.regexp_count(text_col, F.lit(_WORDS)), F.lit(0)).cast("bigint").alias("size"),
            F.xxhash64(F.lit(seed), F.col(id_col)).alias("__hash"),
            F.monotonically_increasing_id().alias("__row"),
        ),
        "mixing-sizes",
    )


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """source, source_size, and target: share times all sizes, dealt by weight up to most times a source's own size.

    What a target is without a cap, a level times its weight, rises as long as some are capped; each
    round is one sum over the sources, and only sums come to the driver.
    """
    ranked = numbered(materialize(sources.select("source", "source_size"), "mixing-sources"), [F.col("source").asc_nulls_last()], "mixing-order")
    own = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.pmod(F.col("__nth") - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = materialize(ranked.select("source", "source_size", own.alias("__weight"), (F.col("source_size") * float(most)).alias("__most")), "mixing-weights")
    level, capped = 0.0, -1
    while True:
        over = F.col("__most") < F.lit(level) * F.col("__weight") if capped >= 0 else F.lit(False)
        s = ranked.agg(
            F.sum("source_size").alias("all"), F.count_if(over).alias("n"),
            F.sum(F.when(over, F.col("__most")).otherwise(0.0)).alias("taken"), F.sum(F.when(over, 0.0).otherwise(F.col("__weight"))).alias("weight"),
        ).first()
        if s["all"] is None or s["n"] == capped:
            break
        capped = s["n"]
        if not s["weight"]:
            level = float("inf")
            break
        level = (share * s["all"] - s["taken"]) / s["weight"]
    target = F.least(F.col("__most"), F.lit(level) * F.col("__weight"))
    return ranked.select("source", "source_size", target.alias("target"))


def _key(source: Column, size: Column) -> Column:
    """One text of fixed length for a source (null: one of its own) and a size."""
    return F.md5(F.concat(size.cast("string"), F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))).cast("binary"))


def mix(
    docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, seed: int = SEED,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """doc_id, source, size, source_size, target, copies (how often the mix has the document) and taken of each row."""
    order = [F.col("source").asc_nulls_last(), "size", "__hash", "doc_id", "__row"]
    placed = numbered(sized(docs, id_col, text_col, source_col, seed), order, "mixing-places")
    counts = materialize(placed.groupBy("source", "size").agg(F.count("*").alias("n"), F.min("__nth").alias("first")), "mixing-counts")
    shares = targets(counts.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, share, most)
    rows = counts.withColumnRenamed("source", "__source").join(shares, F.col("__source").eqNullSafe(F.col("source")))

    def decide(part: pd.DataFrame) -> pd.DataFrame:
        own = part.sort_values("size")
        size, target = int(own["source_size"].iloc[0]), float(own["target"].iloc[0])
        whole = min(int(target // size), most) if size else 0
        sizes, n = own["size"].to_numpy(), own["n"].to_numpy()
        some = np.flatnonzero(sizes > 0)
        extra = np.zeros(len(own), dtype=np.int64)
        if whole < most:
            extra[some] = fit(sizes[some], n[some], round(target - whole * size))
        return own.assign(whole=whole, extra=extra)[["key", "first", "source_size", "target", "whole", "extra"]]

    rows = rows.select("source", "size", "n", "first", "source_size", "target", _key(F.col("source"), F.col("size")).alias("key"))
    plan = rows.groupBy("source").applyInPandas(decide, "key string, first bigint, source_size bigint, target double, whole bigint, extra bigint")
    found = looked_up(placed.withColumn("key", _key(F.col("source"), F.col("size"))), materialize(plan, "mixing-plan"), "key", MAX_BROADCAST, ["__row"])
    copies = F.col("whole") + (F.col("__nth") - F.col("first") < F.col("extra")).cast("bigint")
    return found.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def repeated(mixed: DataFrame) -> DataFrame:
    """The rows of mix(), each as often as the mix has it, with the number of the copy."""
    return mixed.where("copies > 0").select("*", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))


def op12_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes."""
    mixed = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


QUERIES = {"op12_source_mixing": op12_source_mixing}
ORACLE: dict[str, str] = {}
