"""Quality rules: a decision list learned by sequential covering.

Each document is reduced to counts; a list of conjunctions of thresholds over ratios of
them is learned from labelled documents and emitted as one ordered conditional
expression of Spark. Growing takes the condition of best information gain, pruning
drops last conditions as long as that helps on rows kept aside.

Fitting uses MAX_TRAIN labelled rows at most, those of the smallest hash of their id.
Counts and verdicts cover all rows and whole texts.

Defined results: a null or empty text has no words and fails the base rule; repeated
rows are judged once each; empty tables and labels that are all alike give an empty
list, which keeps what the base keeps; null labels are not learned from; further
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievekit.llm.common import mix, output, slices, small_batches, WHITE, Words

#: Most labelled rows that a list is fitted on, and the share kept aside for pruning.
MAX_TRAIN = 20_000
PRUNE_SHARE = 3
MAX_RULES, MAX_CONDITIONS, MAX_THRESHOLDS = 12, 4, 48
#: A rule must be right this often on the rows kept aside, and cover so many of them.
LEAST_PRECISION, LEAST_COVER = 0.8, 8

#: Base limits.
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[list(b"0123456789")] = True
_UPPER = np.zeros(256, dtype=bool)
_UPPER[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")] = True
_STOP = np.zeros(256, dtype=bool)
_STOP[list(b".!?")] = True
_CHAR = np.ones(256, dtype=bool)
_CHAR[0x80:0xC0] = False

COUNTS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "n_lines", "n_distinct_words", "n_digits", "n_upper", "n_stops",
)



def features() -> dict[str, Column]:
    """Spark expressions of the ratios, by name; defined for empty texts too."""
    words = F.greatest(F.col("n_words"), F.lit(1))
    chars = F.greatest(F.col("word_chars"), F.lit(1))
    lines = F.greatest(F.col("n_lines"), F.lit(1))
    return {
        "words": F.col("n_words").cast("double"),
        "word_length": F.col("word_chars") / words,
        "symbols_per_word": F.col("n_symbols") / words,
        "dup_line_share": F.col("n_dup_lines") / lines,
        "repeat_share": F.col("n_repeat_words") / words,
        # The share of distinct words falls with length; this ratio of logarithms hardly does.
        "distinctness": F.log(F.col("n_distinct_words") + 1.0) / F.log(words + 1.0),
        "words_per_line": F.col("n_words") / lines,
        "digit_share": F.col("n_digits") / chars,
        "upper_share": F.col("n_upper") / chars,
        "stops_per_word": F.col("n_stops") / words,
    }


def count_texts(texts: list[bytes]) -> dict[str, np.ndarray]:
    """The COUNTS of each text."""
    w = Words(texts, lower=False)
    n = len(texts)
    of = w.text_of_word()
    inside = np.zeros(len(w.data) + 1, dtype=np.int8)
    inside[w.start] += 1
    inside[w.end] -= 1
    inside = np.cumsum(inside[:-1], dtype=np.int8).astype(bool)

    def per_text(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask)])
        return total[w.bounds[1:]] - total[w.bounds[:-1]]

    def repeated(keys: np.ndarray) -> np.ndarray:
        order = np.argsort(keys)
        same = keys[order][1:] == keys[order][:-1]
        out = np.zeros(len(keys), dtype=bool)
        out[order[1:][same]] = True
        out[order[:-1][same]] = True
        return out

    salt = mix(np.arange(1, n + 1, dtype=np.uint64))
    windows, at = w.shingles(3)
    again = at[repeated(windows ^ salt[of[at]])]
    marked = np.zeros(len(of) + 2, dtype=bool)
    for k in range(3):
        marked[again + k] = True
    distinct = np.unique(w.hash ^ salt[of], return_index=True)[1]
    lines = [[x for x in t.split(b"\n") if x.strip(WHITE)] for t in texts]
    full = np.array([len(x) for x in lines], dtype=np.int64)
    return {
        "n_words": np.bincount(of, minlength=n),
        "word_chars": per_text(inside & _CHAR[w.data]),
        "n_symbols": per_text(_SYMBOL[w.data]),
        "n_dup_lines": full - np.array([len(set(x)) for x in lines], dtype=np.int64),
        "n_repeat_words": np.bincount(of, weights=marked[: len(of)], minlength=n).astype(np.int64),
        "n_lines": full,
        "n_distinct_words": np.bincount(of[distinct], minlength=n),
        "n_digits": per_text(_DIGIT[w.data]),
        "n_upper": per_text(_UPPER[w.data]),
        "n_stops": per_text(_STOP[w.data]),
    }


def count(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the COUNTS of each row's whole text."""
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType
    fields = f"doc_id {kind.simpleString()}, " + ", ".join(f"{c} bigint" for c in COUNTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches, "text"):
            found = count_texts(texts)
            schema = pa.schema([("doc_id", part.column(0).type), *((c, pa.int64()) for c in COUNTS)])
            yield output(schema, doc_id=part.column(0), **found)

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, fields)


@dataclass(frozen=True)
class Condition:
    """feature <= threshold, or > if not below."""

    feature: str
    below: bool
    threshold: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] <= self.threshold if self.below else x[self.feature] > self.threshold

    def column(self, found: dict[str, Column]) -> Column:
        c = found[self.feature]
        return c <= F.lit(self.threshold) if self.below else c > F.lit(self.threshold)

    def __str__(self) -> str:
        return f"{self.feature} {'<=' if self.below else '>'} {self.threshold:.6g}"


def _covers(rule: list[Condition], x: dict[str, np.ndarray], n: int) -> np.ndarray:
    out = np.ones(n, dtype=bool)
    for c in rule:
        out &= c.holds(x)
    return out


def _grow(x: dict[str, np.ndarray], y: np.ndarray) -> list[Condition]:
    rule: list[Condition] = []
    live = np.ones(len(y), dtype=bool)
    while len(rule) < MAX_CONDITIONS and not y[live].all():
        p0 = y[live].sum()
        base = np.log2(p0 / live.sum())
        best, found = 1e-9, None
        for name in sorted(x):
            v, t = x[name][live], y[live]
            u = np.unique(v)
            if len(u) < 2:
                continue
            at = np.searchsorted(u, np.quantile(v, np.linspace(0, 1, MAX_THRESHOLDS + 2)[1:-1], method="lower"))
            at = np.unique(np.minimum(at, len(u) - 2))
            cuts = (u[at] + u[at + 1]) / 2
            order = np.argsort(v, kind="stable")
            upto = np.searchsorted(v[order], cuts, side="right")
            right = np.concatenate([[0], np.cumsum(t[order])])[upto]
            for below in (True, False):
                p = right if below else p0 - right
                n = upto if below else len(v) - upto
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(p > 0, p * (np.log2(p / n) - base), 0)
                k = int(np.argmax(gain))
                if gain[k] > best:
                    best, found = gain[k], Condition(name, below, float(cuts[k]))
        if found is None:
            break
        rule.append(found)
        live &= found.holds(x)
    return rule


def learn(x: dict[str, np.ndarray], y: np.ndarray, aside: np.ndarray) -> list[list[Condition]]:
    """The ordered rules for rows where y is true; aside marks the rows kept for pruning."""
    rules: list[list[Condition]] = []
    left = np.ones(len(y), dtype=bool)
    while len(rules) < MAX_RULES:
        grow, prune = left & ~aside, left & aside
        if not y[grow].any() or not y[prune].any():
            break
        rule = _grow({k: v[grow] for k, v in x.items()}, y[grow])
        px, py = {k: v[prune] for k, v in x.items()}, y[prune]

        def worth(r: list[Condition], px: dict = px, py: np.ndarray = py) -> float:
            c = _covers(r, px, len(py))
            return (2 * py[c].sum() - c.sum()) / c.sum() if c.any() else -1.0

        while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
            rule = rule[:-1]
        covered = _covers(rule, px, len(py)) if rule else np.zeros(len(py), dtype=bool)
        if covered.sum() < LEAST_COVER or py[covered].mean() < LEAST_PRECISION:
            break
        rules.append(rule)
        left &= ~_covers(rule, x, len(y))
    return rules


def training_rows(docs: DataFrame, labels: DataFrame, label_col: str, most: int = MAX_TRAIN) -> DataFrame:
    """COUNTS and label of a bounded sample of labelled documents.

    The sample is chosen by hash among all labelled ids, so it has most rows at most and
    its ids can be broadcast. Of rows that repeat an id the least text counts.
    """
    ids = (
        labels.where(F.col(label_col).isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("doc_id").agg(F.max(label_col).alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    )
    chosen = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id", "left_semi")
    one = chosen.groupBy("doc_id").agg(F.min("text").alias("text"))
    return count(one).join(F.broadcast(ids), "doc_id")


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", bad: int = 0) -> list[list[Condition]]:
    """Learn the rules that reject: conjunctions that documents labelled bad fulfil."""
    names = features()
    rows = training_rows(docs, labels, label_col).select(
        F.xxhash64("doc_id").alias("h"), "label", *(c.alias(k) for k, c in names.items())
    ).toPandas().sort_values("h", kind="stable")
    x = {k: rows[k].to_numpy(dtype=float) for k in names}
    y = (rows["label"] == bad).to_numpy()
    aside = np.arange(len(rows)) % PRUNE_SHARE == 0
    return learn(x, y, aside)


def verdict(rules: list[list[Condition]]) -> Column:
    """The rules as one ordered conditional: the number of the first that holds, else null."""
    out = None
    found = features()
    for k, rule in enumerate(rules):
        both = reduce(lambda a, b: a & b, (c.column(found) for c in rule))
        out = F.when(both, F.lit(k)) if out is None else out.when(both, F.lit(k))
    return F.lit(None).cast(T.IntegerType()) if out is None else out.otherwise(F.lit(None)).cast("int")


def judge(docs: DataFrame, rules: list[list[Condition]]) -> DataFrame:
    """Counts, the base's and the list's verdicts; rule is the number of the rule that rejects."""
    failed = (F.col("n_words") < MIN_WORDS) | (
        F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT
    )
    return (
        count(docs)
        .withColumn("base_failed", failed)
        .withColumn("rule", verdict(rules))
        .withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())
    )


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return judge(docs, fit(docs, labels)).select(
        "doc_id", *COUNTS[:5], "base_failed", "kept", "rule", *COUNTS[5:]
    )


QUERIES = {"op7_quality_rules": op7_quality_rules}
ORACLE: dict[str, str] = {}
