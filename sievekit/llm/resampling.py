"""Target-distribution importance resampling over n-gram buckets.

Features are runs of one to three words. Dictionaries of distinct n-gram strings with their counts
are built over all documents; each distinct string is hashed once into a bucket, and buckets
are summed. A bucket's gain is the logarithm of how much likelier the target texts have it than
the documents. Gains are joined back to the per-document feature counts and summed; Gumbel noise
from a seeded hash of the id is added, and the highest scores are drawn: a sample without
replacement by importance.

A dictionary covers a slice of texts of some MB, not the whole corpus: most three-word strings are
seen once, so a shuffle of all distinct strings costs several times the input, while only
BUCKETS sums are wanted of it. Strings enter a slice's dictionary by the entries that they are made
of: words, then pairs of words, then pairs with a word; their CRC-32 is put together from
those of the parts. Words are told apart by 64-bit hashes, pairs and triples exactly.

Defined results: null texts, and texts without words, have no features and weight 0; null ids
hash like an empty one and come last among ties; repeated rows are documents of their own, each
counted and drawn by itself; empty tables count as zero occurrences; of N documents with enough
words fewer than 100 / percent draw none. Further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievekit.llm.common import materialize, numbered, output, slices, small_batches, span_hash

BUCKETS = 10_000
NGRAMS = 3
#: Documents with fewer words are not drawn; percent of the others that are.
MIN_WORDS, PERCENT = 20, 5
SEED = 42

#: Words of a slice that are taken into a dictionary at once.
STRETCH = 1 << 20

_WORD = np.zeros(256, dtype=bool)
_WORD[list(b"0123456789abcdefghijklmnopqrstuvwxyz")] = True
_WORD[0x80:] = True

_zeros: dict[int, np.ndarray] = {}


def _after(table: np.ndarray, crc: np.ndarray) -> np.ndarray:
    """The CRCs as table (4 x 256) moves them on."""
    low = np.uint32(255)
    return table[0][crc & low] ^ table[1][crc >> np.uint32(8) & low] ^ table[2][crc >> np.uint32(16) & low] ^ table[3][crc >> np.uint32(24)]


def zero_bytes(n: int) -> np.ndarray:
    """What n more bytes make of a CRC-32, by its bytes; what follows comes by exclusive or."""
    if n not in _zeros:
        if n == 1:
            byte = np.array([zlib.crc32(bytes([v])) ^ zlib.crc32(b"\0") for v in range(256)], dtype=np.uint32)
            value = np.arange(256, dtype=np.uint32)
            _zeros[1] = np.stack([byte, *(value << np.uint32(8 * k) for k in range(3))])
        else:
            half = zero_bytes(n // 2)
            both = np.stack([_after(half, half[k]) for k in range(4)])
            _zeros[n] = both if n % 2 == 0 else np.stack([_after(zero_bytes(1), both[k]) for k in range(4)])
    return _zeros[n]


def _joined(left: np.ndarray, right: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """CRC-32 of strings made of two parts, from those of the parts and the sizes of the right ones."""
    kinds, of = np.unique(sizes, return_inverse=True)
    tables = np.stack([zero_bytes(int(n)) for n in kinds]) if len(kinds) else np.zeros((0, 4, 256), dtype=np.uint32)
    low = np.uint32(255)
    moved = tables[of, 0, left & low]
    for k in (1, 2, 3):
        moved = moved ^ tables[of, k, left >> np.uint32(8 * k) & low]
    return moved ^ right


def dictionaries(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Of the texts, for runs of 1, 2, 3 words (of each stretch of words): the distinct strings' CRC-32 and counts, and for each occurrence its string's place and its text."""
    joined = (b"\n".join(texts) + b"\n").lower()
    data = np.frombuffer(joined, dtype=np.uint8)
    inside = _WORD[data]
    change = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if inside[0]:
        change = np.concatenate([[0], change])
    start, end = change[0::2], change[1::2]
    if not len(start):
        return
    hashes = span_hash(data, start, end)
    ends = np.cumsum([len(t) + 1 for t in texts])
    text = np.searchsorted(ends, start, side="right")
    for begin in range(0, len(start), STRETCH):
        upto = min(begin + STRETCH + NGRAMS - 1, len(start))
        own = min(STRETCH, len(start) - begin)
        _, first, word, counts = np.unique(hashes[begin:upto], return_index=True, return_inverse=True, return_counts=True)
        spans = [joined[a:b] for a, b in zip(start[begin + first].tolist(), end[begin + first].tolist(), strict=True)]
        crc = np.array([zlib.crc32(w) for w in spans], dtype=np.uint32)
        space = zlib.crc32(b" ")
        after = np.array([zlib.crc32(w, space) for w in spans], dtype=np.uint32)
        sizes = np.array([len(w) + 1 for w in spans], dtype=np.int64)
        of = text[begin:upto]
        if upto - begin > own:
            counts = np.bincount(word[:own], minlength=len(crc))
        yield crc, counts, word[:own], of[:own]
        entry, held = word.astype(np.int64), crc
        for n in range(2, NGRAMS + 1):
            # entry: the place of the string of n - 1 words that starts at each word.
            whole = np.flatnonzero(of[: len(of) - n + 1] == of[n - 1 :])
            keys, place = np.unique(entry[whole] << 32 | word[whole + n - 1], return_inverse=True)
            held = _joined(held[keys >> 32], after[keys & 0xFFFFFFFF], sizes[keys & 0xFFFFFFFF])
            entry = np.zeros(len(of), dtype=np.int64)
            entry[whole] = place
            place, at = place[whole < own], whole[whole < own]
            yield held, np.bincount(place, minlength=len(held)), place, of[at]


def bucket_counts(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """bucket and n: occurrences of all features of the texts, summed by task before the shuffle."""
    small_batches(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS)
        for _, part in slices(batches, "text"):
            for crc, counts, _, _ in dictionaries(part):
                total += np.bincount(crc % BUCKETS, weights=counts, minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield output(pa.schema([("bucket", pa.int64()), ("n", pa.int64())]), bucket=at, n=total[at].astype(np.int64))

    found = texts.select(F.col(text_col).alias("text")).mapInArrow(run, "bucket bigint, n bigint")
    return found.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame) -> DataFrame:
    """bucket and gain of every bucket, from (bucket, n) rows of both sides."""
    every = corpus.sparkSession.range(BUCKETS).withColumnRenamed("id", "bucket")
    for rows, name in ((corpus, "own"), (target, "wanted")):
        every = every.join(rows.groupBy("bucket").agg(F.sum("n").alias(name)), "bucket", "left").fillna(0, [name])
    sums = every.agg(F.sum("own").alias("all_own"), F.sum("wanted").alias("all_wanted"))
    own, wanted, all_own, all_wanted = (F.col(c).cast("double") for c in ("own", "wanted", "all_own", "all_wanted"))
    ratio = (wanted + 1) * (all_own + BUCKETS) / ((own + 1) * (all_wanted + BUCKETS))
    return every.crossJoin(F.broadcast(sums)).select("bucket", F.floor(1000 * F.log(ratio)).cast("bigint").alias("gain"))


def weigh(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_features and weight of each document; written. The gains, BUCKETS numbers, go to every task."""
    small_batches(docs.sparkSession)
    gain = np.zeros(BUCKETS)
    for r in gains(bucket_counts(docs, text_col), bucket_counts(target, text_col)).collect():
        gain[r["bucket"]] = r["gain"]
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches, "text"):
            words = np.zeros(len(texts), dtype=np.int64)
            features = np.zeros(len(texts), dtype=np.int64)
            weight = np.zeros(len(texts))
            for k, (crc, _, place, of) in enumerate(dictionaries(texts)):
                n = np.bincount(of, minlength=len(texts))
                words += n if k % NGRAMS == 0 else 0
                features += n
                weight += np.bincount(of, weights=gain[crc % BUCKETS][place], minlength=len(texts))
            schema = pa.schema([("doc_id", part.column(0).type), ("n_words", pa.int64()), ("n_features", pa.int64()), ("weight", pa.int64())])
            yield output(schema, doc_id=part.column(0), n_words=words, n_features=features, weight=weight.astype(np.int64))

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    found = rows.mapInArrow(run, f"doc_id {kind}, n_words bigint, n_features bigint, weight bigint")
    return materialize(found.withColumn("__row", F.monotonically_increasing_id()), "resampling-weights")


def noise(id_column: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, from the id's hash."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_column.cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("bigint")


def draw(weighed: DataFrame, percent: int = PERCENT, least: int = MIN_WORDS, seed: int = SEED) -> DataFrame:
    """weighed (a written table) with score, and rank of those drawn: the highest scores of documents with enough words."""
    scored = weighed.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    fit = F.col("n_words") >= least
    most = scored.where(fit).count() * percent // 100
    ranked = numbered(scored.where(fit), [F.desc("score"), F.col("doc_id").asc_nulls_last(), "__row"], "resampling-order")
    ranked = ranked.withColumn("rank", F.when(F.col("__nth") <= most, F.col("__nth"))).drop("__nth")
    return ranked.unionByName(scored.where(~fit).withColumn("rank", F.lit(None).cast("bigint"))).drop("__row")


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's weight and score towards the benchmark, and the rank of those drawn."""
    docs, target = (spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in ("documents", "benchmark"))
    return draw(weigh(docs, target)).select("doc_id", "n_features", "weight", "score", "rank", "n_words")


QUERIES = {"op13_importance_resampling": op13_importance_resampling}
ORACLE: dict[str, str] = {}
