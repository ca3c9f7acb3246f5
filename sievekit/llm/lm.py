"""LM scoring: online logistic mixing of hashed-context bit predictors.

A text is a sequence of bytes and an end symbol, each coded as eight binary decisions
from the highest bit. For each order of ORDERS a predictor keeps, in hashed slots, how
often a decision went either way after the last bytes and the bits so far; these counts
are gathered from all training texts. A mixer adds the predictors' log-odds with weights
that are gated by the bit's place and the longest context seen before, and that are
learned online, decision by decision in small blocks, on one of TUNE_SHARE training texts.
While the mixer learns, these texts are kept out of the counts, so that they are new to the
predictors; after that their counts are added. They are dealt into shares of some
TUNE_BYTES that learn beside each other, and the shares' weights are averaged by their
bytes. For each text the mixer's answer is refined adaptively: sharper and flatter
versions of it are weighted by how well they did on the text so far (Bayes' rule). The
sum of the decisions' costs is the text's total; over its bytes it gives bits per byte.

The costs of a byte depend on it and the bytes before that the longest context holds, so
within a slice of texts each distinct such run of bytes is worked out once.

What goes beyond the longest context is found by segments. A text is cut after the pairs
of words whose hash says so, one of CUT, and at its end; how often each segment occurs in
all training texts is kept in a table that grows with them, by 64-bit hashes of whole
segments, and is joined by a shuffle. A segment's probability is the mixture of the mixer's
and of its share among the training segments, with the weight that did best on the texts
set aside while they were left out of the counts. Cuts depend on what is before them only,
so that no segment begins another and the mixture is a distribution. A training text's own
segments don't count for itself: it would only say that it was learned from. Segments that
make more than one of FREQUENT are broadcast, so that none is a hot key of the join.

Besides there is a unigram score over words, with counts of all training words.

The bit predictors' tables have a fixed number of slots. The words' counts are broadcast
up to MAX_BROADCAST distinct words; beyond, they are joined by a shuffle.

Defined results: a null or empty text is the end symbol alone; a null id belongs to the
training side; repeated rows are scored once each, and count for each other; without
training texts all counts are 0 and all decisions even; further columns are ignored.
Texts are scored whole.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievekit.llm.common import materialize, mix, output, slices, small_batches, span_hash, Words

ORDERS = (1, 2, 3, 4, 5)
LONGEST = max(ORDERS)
#: Slots of each order's table, as powers of two.
SLOT_BITS = {1: 16, 2: 20, 3: 21, 4: 21, 5: 21}
_BASE_OF = dict(zip(ORDERS, np.cumsum([0, *(1 << SLOT_BITS[o] for o in ORDERS[:-1])]).tolist(), strict=True))
N_SLOTS = sum(1 << SLOT_BITS[o] for o in ORDERS)
BLOCK = 1 << 17
#: Added to both counts of a decision.
ADDED = 0.4
#: The end of a text, and what is before its beginning; never a byte of UTF-8.
END = 0xFF
#: Training texts that the mixer learns from (one of so many), bytes of a share of them.
TUNE_SHARE, TUNE_BYTES = 20, 1 << 19
TUNE_BLOCK, RATE, EPOCHS = 1024, 0.02, 2
#: Decisions of so many bytes are made ready at once for the mixer.
TUNE_CODES = 1 << 17
#: Factors of the log-odds among which each text's weights choose.
FACTORS = (0.7, 1.0, 1.3)
MAX_LOGIT = 14.0
#: Most distinct words that are broadcast, 16 bytes each.
MAX_BROADCAST = 8_000_000
#: One of so many pairs of words ends a segment.
CUT = 32
#: Segments that make more than one of so many are broadcast: there are fewer than that.
FREQUENT = 4096
SLICE = 4 << 20
#: Codes that are worked on at once, so that their arrays stay in the processor's cache.
AT_ONCE = 1 << 15


def _codes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For each byte and end, the run of LONGEST bytes before it and it as an integer; bounds of the texts."""
    gap = bytes([END]) * LONGEST
    data = np.frombuffer(gap + gap.join(texts) + gap, dtype=np.uint8)
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    bounds = np.concatenate([[0], np.cumsum(sizes + 1)])
    # Of a gap only the first byte, the end, is coded.
    coded = np.ones(len(data) - LONGEST if texts else 0, dtype=bool)
    ends = np.cumsum(sizes + LONGEST) - LONGEST
    coded[(ends[:, None] + np.arange(1, LONGEST)).ravel()] = False
    out = np.empty(bounds[-1], dtype=np.uint64)
    at = 0
    for first in range(0, len(coded), AT_ONCE):
        some = coded[first : first + AT_ONCE]
        code = np.zeros(len(some), dtype=np.uint64)
        for k in range(LONGEST + 1):
            code <<= np.uint64(8)
            code |= data[first + k : first + k + len(some)]
        code = code[some]
        out[at : at + len(code)] = code
        at += len(code)
    return out, bounds


def _slots(code: np.ndarray) -> dict[int, np.ndarray]:
    """Hash of each order's context."""
    before = code >> np.uint64(8)
    return {
        o: mix((before & np.uint64((1 << 8 * o) - 1)) + np.uint64(o << 56)) for o in ORDERS
    }


def _place(context: np.ndarray, order: int, node: np.ndarray) -> np.ndarray:
    """The slot of a decision: node is the bits of the byte so far, after a leading one."""
    h = (context ^ node * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xD6E8FEB86659FD93)
    return (h >> np.uint64(64 - SLOT_BITS[order])).astype(np.int64) + _BASE_OF[order]


def _decisions(code: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The place of the bit, the node and the bit, of all codes' last bytes."""
    byte = code & np.uint64(0xFF)
    for k in range(8):
        node = np.uint64(1 << k) | byte >> np.uint64(8 - k)
        yield k, node, (byte >> np.uint64(7 - k) & np.uint64(1)).astype(np.int64)


#: Tasks whose counts are summed at first, and groups that the mixer's weights are summed in.
SUMMED = 64


def _count(docs: DataFrame, aside: DataFrame) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """Log-odds and (in quarters of a doubling) count of each slot, from docs, and from docs and aside."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(N_SLOTS * 2, dtype=np.uint32)
        any_ = False
        for _, texts in slices(batches, "text", SLICE):
            any_ = True
            number, code = pd.factorize(_codes(texts)[0])
            times = np.bincount(number).astype(np.uint32)
            for first in range(0, len(code), AT_ONCE):
                some_codes, some_times = code[first : first + AT_ONCE], times[first : first + AT_ONCE]
                contexts = _slots(some_codes)
                for _, node, bit in _decisions(some_codes):
                    for o in ORDERS:
                        np.add.at(table, _place(contexts[o], o, node) * 2 + bit, some_times)
        if any_:
            for block in range(0, len(table), BLOCK):
                part = table[block : block + BLOCK]
                at = np.flatnonzero(part)
                if len(at):
                    raw = at.astype(np.uint32).tobytes() + part[at].tobytes()
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([block // BLOCK], pa.int32()), pa.array([zlib.compress(raw, 1)], pa.binary())],
                        names=["block", "blob"],
                    )

    def packed(key: tuple[int, bool], total: np.ndarray) -> pa.RecordBatch:
        at = np.flatnonzero(total)
        blob = zlib.compress(at.astype(np.uint32).tobytes() + total[at].tobytes(), 1)
        return pa.RecordBatch.from_arrays(
            [pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.bool_()), pa.array([blob], pa.binary())], names=["block", "late", "blob"]
        )

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, np.zeros(BLOCK, dtype=np.uint64)
        for batch in batches:
            for *key, blob in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if now is not None and key != now:
                    yield packed((now[0], now[1]), total)
                    total[:] = 0
                raw = np.frombuffer(zlib.decompress(blob), dtype=np.uint32)
                total[raw[: len(raw) // 2]] += raw[len(raw) // 2 :]
                now = key
        if now is not None:
            yield packed((now[0], now[1]), total)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for block, late, blob in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                raw = zlib.decompress(blob)
                at = np.frombuffer(raw[: len(raw) // 3], dtype=np.uint32)
                n = np.frombuffer(raw[len(raw) // 3 :], dtype=np.uint64)
                if block not in total:
                    total[block] = [np.zeros(BLOCK, dtype=np.uint64) for _ in range(2)]
                total[block][int(late)][at] += n
        for block, (first, rest) in total.items():
            for whole, sums in ((False, first), (True, first + rest)):
                # Log-odds and the logarithm of the count are all that predictors use.
                two = sums.reshape(-1, 2).astype(np.float64)
                odds = np.log((two[:, 1] + ADDED) / (two[:, 0] + ADDED)).astype(np.float16)
                seen = np.minimum(np.log2(1 + two.sum(axis=1)) * 4, 255).astype(np.uint8)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([block], pa.int32()),
                        pa.array([whole], pa.bool_()),
                        pa.array([zlib.compress(odds.tobytes(), 1)], pa.binary()),
                        pa.array([zlib.compress(seen.tobytes(), 1)], pa.binary()),
                    ],
                    names=["block", "whole", "odds", "seen"],
                )

    parts = [
        d.select("text").mapInArrow(run, "block int, blob binary").select("block", F.lit(late).alias("late"), F.floor(F.spark_partition_id() / F.lit(SUMMED)).alias("group"), "blob")
        for late, d in ((False, docs), (True, aside))
    ]
    # Two steps, so that no task reads what all tasks have counted in a block.
    keys = ["block", "late", "group"]
    parts = parts[0].unionByName(parts[1]).repartition(*keys).sortWithinPartitions(*keys)
    parts = parts.mapInArrow(some, "block int, late boolean, blob binary").repartition(64, "block")
    tables = [(np.zeros(N_SLOTS, dtype=np.float16), np.zeros(N_SLOTS, dtype=np.uint8)) for _ in range(2)]
    half = BLOCK // 2
    for row in parts.mapInArrow(add, "block int, whole boolean, odds binary, seen binary").collect():
        at = row["block"] * half
        odds, seen = tables[int(row["whole"])]
        o = np.frombuffer(zlib.decompress(bytes(row["odds"])), dtype=np.float16)
        s = np.frombuffer(zlib.decompress(bytes(row["seen"])), dtype=np.uint8)
        odds[at : at + half] = o[: len(odds) - at]
        seen[at : at + half] = s[: len(seen) - at]
    return tables[0], tables[1]


@dataclass
class Model:
    """odds, seen: of each slot; weights: [gates, orders + 1], the last one of a constant."""

    odds: np.ndarray | None
    seen: np.ndarray | None
    weights: np.ndarray

    @cached_property
    def packed(self) -> np.ndarray:
        """The log-odds' bits as 32-bit floats, whose last bit, unused by half floats, says whether a slot was seen twice at least."""
        found = self.odds.astype(np.float32).view(np.uint32)
        found |= self.seen >= 7
        return found

    def shed(self) -> Model:
        """This model without what packed is made of: costs need no more, and workers keep it between tasks."""
        if self.odds is not None:
            _ = self.packed
            self.odds = self.seen = None
        return self

    def inputs(self, contexts: dict[int, np.ndarray], k: int, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The predictors' log-odds and the gate of each decision."""
        x = np.empty((len(ORDERS) + 1, len(node)), dtype=np.float32)
        gate = np.zeros(len(node), dtype=np.uint32)
        raw = x.view(np.uint32)
        for row, o in enumerate(ORDERS):
            found = self.packed.take(_place(contexts[o], o, node))
            np.maximum(gate, (found & np.uint32(1)) * np.uint32(row + 1), out=gate)
            np.bitwise_and(found, np.uint32(0xFFFFFFFE), out=raw[row])
        x[-1] = 0.3
        return x, gate.astype(np.int64) * 8 + k

    def costs(self, code: np.ndarray) -> np.ndarray:
        """[factors, codes]: bits that the last byte of each code costs."""
        out = np.empty((len(FACTORS), len(code)), dtype=np.float32)
        for first in range(0, len(code), AT_ONCE):
            out[:, first : first + AT_ONCE] = self._costs(code[first : first + AT_ONCE])
        return out

    def _costs(self, code: np.ndarray) -> np.ndarray:
        # The product of eight decisions' 1 / p is e to the power 8 * 1.3 * MAX_LOGIT at most, so one logarithm does.
        product = np.ones((len(FACTORS), len(code)))
        contexts = _slots(code)
        columns = np.ascontiguousarray(self.weights.T)
        for k, node, bit in _decisions(code):
            x, gate = self.inputs(contexts, k, node)
            logit = np.zeros(len(code), dtype=np.float32)
            for row in range(len(x)):
                logit += columns[row].take(gate) * x[row]
            signed = np.clip(logit, -MAX_LOGIT, MAX_LOGIT) * (1 - 2 * bit).astype(np.float32)
            for row, f in enumerate(FACTORS):
                product[row] *= np.exp(signed * np.float32(f)).astype(np.float64) + 1
        return np.log2(product)

    def bits(self, texts: list[bytes]) -> np.ndarray:
        """The total of each text."""
        bounds = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
        return self.segment_bits(texts, bounds[:-1], np.arange(len(texts)))

    def segment_bits(self, texts: list[bytes], start: np.ndarray, of: np.ndarray) -> np.ndarray:
        """The total of each segment, given what is before it; start: its first code, of: its text."""
        number, distinct = pd.factorize(_codes(texts)[0])
        costs = self.costs(distinct)
        total = np.stack([np.add.reduceat(c[number].astype(np.float64), start) for c in costs])
        # Up to each segment's end, from the text's beginning.
        total = np.cumsum(total, axis=1)
        first = np.flatnonzero(np.diff(of, prepend=-1))
        before = np.concatenate([np.zeros((len(costs), 1)), total], axis=1)[:, first]
        total -= before[:, of]
        # Weights by Bayes' rule before each decision: the mixture of the versions' totals.
        least = total.min(axis=0)
        mixed = least - np.log2(np.exp2(least - total).mean(axis=0))
        out = np.diff(mixed, prepend=0.0)
        out[first] = mixed[first]
        return out


def tune(odds: np.ndarray, seen: np.ndarray, texts: list[bytes]) -> Model:
    """Learn the mixer's weights online, in blocks of TUNE_BLOCK bytes."""
    gates = (len(ORDERS) + 1) * 8
    model = Model(odds, seen, np.full((gates, len(ORDERS) + 1), 0.35, dtype=np.float32))
    model.weights[:, -1] = 0  # nothing learned, nothing preferred
    past = np.full(model.weights.shape, 1e-3)
    codes = _codes(texts)[0] if texts else np.zeros(0, dtype=np.uint64)
    for first in range(0, len(codes), TUNE_CODES):
        code = codes[first : first + TUNE_CODES]
        contexts = _slots(code)
        # The inputs don't depend on the weights.
        ready = [(*model.inputs(contexts, k, node), bit) for k, node, bit in _decisions(code)]
        for _ in range(EPOCHS):
            for begin in range(0, len(code), TUNE_BLOCK):
                for xs, gate_of, bits in ready:
                    x, gate, bit = (a[..., begin : begin + TUNE_BLOCK] for a in (xs, gate_of, bits))
                    logit = (model.weights[gate].T * x).sum(axis=0)
                    off = bit - 1 / (1 + np.exp(-np.clip(logit, -MAX_LOGIT, MAX_LOGIT)))
                    step = np.zeros_like(past)
                    for row in range(len(x)):
                        step[:, row] = np.bincount(gate, weights=off * x[row], minlength=gates)
                    past += step * step
                    model.weights += (RATE * step / np.sqrt(past)).astype(np.float32)
    return model


def _tune_shares(aside: DataFrame, odds: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """The mixer's weights from all texts of aside (doc_id, text)."""
    sent = aside.sparkSession.sparkContext.broadcast((odds, seen))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = [t for _, part in slices(batches, "text", SLICE) for t in part]
        if texts:
            weights = tune(*sent.value, texts).weights
            yield pa.RecordBatch.from_arrays(
                [pa.array([sum(len(t) + 1 for t in texts)]), pa.array([weights.tobytes()], pa.binary())], names=["n", "weights"]
            )

    size = aside.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 1)).first()[0] or 0
    dealt = aside.repartition(-(-size // TUNE_BYTES) or 1, "doc_id", "text").sortWithinPartitions("doc_id", "text")
    shares = dealt.mapInArrow(run, "n bigint, weights binary")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, total = 0, 0.0
        for batch in batches:
            for n, weights in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                size, total = size + n, total + n * np.frombuffer(weights, dtype=np.float32).astype(np.float64)
        if size:
            yield pa.RecordBatch.from_arrays([pa.array([size]), pa.array([total.tobytes()], pa.binary())], names=["n", "weights"])

    # Sums of SUMMED groups come here, however many shares there are; in an order of their own, so that reruns agree.
    groups = shares.repartition(SUMMED, "weights").sortWithinPartitions("n", "weights").mapInArrow(add, "n bigint, weights binary")
    rows = sorted((r["n"], bytes(r["weights"])) for r in groups.collect())
    sent.unpersist()
    if not rows:
        return tune(odds, seen, []).weights
    total = sum(np.frombuffer(w, dtype=np.float64) for _, w in rows) / sum(n for n, _ in rows)
    return total.reshape(-1, len(ORDERS) + 1).astype(np.float32)


def _aside() -> Column:
    """The training texts that weights are learned from."""
    return F.coalesce(F.pmod(F.xxhash64("doc_id"), F.lit(TUNE_SHARE)) == 0, F.lit(False))


def fit(docs: DataFrame) -> Model:
    """Counts of all texts, and a mixer learned on a share of them while their counts were left out."""
    small_batches(docs.sparkSession)
    aside = materialize(docs.where(_aside()).select("doc_id", "text"), "aside")
    first, whole = _count(docs.where(~_aside()), aside)
    return Model(*whole, _tune_shares(aside, *first))


def _segments(words: Words, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first code and text of each segment; words: those of the texts, lower-cased.

    A segment ends after the byte, or the end, that follows its last word.
    """
    of = words.text_of_word()
    before = np.zeros(len(words.hash), dtype=np.uint64)
    before[1:] = np.where(of[1:] == of[:-1], words.hash[:-1], np.uint64(0))
    cut = mix(words.hash + before * np.uint64(3)) % np.uint64(CUT) == 0
    stop = np.unique(np.concatenate([words.end[cut] + 1, words.bounds[1:]]))
    start = np.concatenate([[0], stop[:-1]])
    end = bytes([END])
    data = np.frombuffer(end.join(texts) + end, dtype=np.uint8)
    return span_hash(data, start, stop), start, np.searchsorted(words.bounds, start, side="right") - 1


def count_table(docs: DataFrame) -> DataFrame:
    """segment, h, n, late: how often each lower-cased word or segment occurs, by its 64-bit hash.

    late is the part of n that is in texts set aside.
    """

    def flush(held: dict[bool, list[tuple]]) -> Iterator[pa.RecordBatch]:
        for segment, parts in held.items():
            if parts:
                number, found = pd.factorize(np.concatenate([p[0] for p in parts]))
                n, late = (np.bincount(number, weights=np.concatenate([p[k] for p in parts])).astype(np.int64) for k in (1, 2))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(found), segment)), pa.array(found.view(np.int64)), pa.array(n), pa.array(late)],
                    names=["segment", "h", "n", "late"],
                )
                parts.clear()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bool, list[tuple]] = {False: [], True: []}
        size = 0
        for part, texts in slices(batches, "text", SLICE):
            aside = part.column(1).to_numpy(zero_copy_only=False)
            words = Words(texts, lower=True)
            hashes, _, of = _segments(words, texts)
            for segment, (h, text) in enumerate(((words.hash, words.text_of_word()), (hashes, of))):
                number, found = pd.factorize(h)
                late = np.bincount(number, weights=aside[text], minlength=len(found))
                held[bool(segment)].append((found, np.bincount(number, minlength=len(found)), late))
                size += len(found)
            if size > 2_000_000:
                yield from flush(held)
                size = 0
        yield from flush(held)

    rows = docs.select("text", _aside().alias("late")).mapInArrow(run, "segment boolean, h bigint, n bigint, late bigint")
    return rows.groupBy("segment", "h").agg(F.sum("n").alias("n"), F.sum("late").alias("late"))


@dataclass
class Repeats:
    """total: training segments; weight: of the segments' shares; keys, counts: the frequent ones, by hash."""

    total: int
    weight: float
    keys: np.ndarray
    counts: np.ndarray

    def gain(self, bits: np.ndarray, count: np.ndarray, total: np.ndarray) -> np.ndarray:
        """Bits that a segment of so many bits costs less if it occurs count times among total."""
        miss = np.log2(1 - self.weight)
        hit = np.log2(self.weight * np.maximum(count, 1) / np.maximum(total, 1)) if self.weight else miss
        return np.where(count > 0, bits + np.logaddexp2(miss - bits, hit), miss)

    def gain_column(self, bits: Column, count: Column, total: Column) -> Column:
        """The same of columns."""
        miss = F.lit(float(np.log2(1 - self.weight)))
        low, high = miss - bits, F.log2(F.lit(self.weight) * count / total)
        most = F.greatest(low, high)
        both = most + F.log2(F.pow(F.lit(2.0), low - most) + F.pow(F.lit(2.0), high - most))
        return F.when(count > 0, bits + both).otherwise(miss)


def repeats(segments: DataFrame) -> Repeats:
    """The weight that did best on what was set aside, and the frequent segments (h, n, late)."""
    total, late, hits = segments.agg(
        F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("late"), F.lit(0)),
        F.coalesce(F.sum(F.when(F.col("n") > F.col("late"), F.col("late"))), F.lit(0)),
    ).first()
    found = segments.where(F.col("n") * FREQUENT > F.lit(total)).select("h", "n").toArrow()
    keys = found.column("h").to_numpy().view(np.uint64)
    order = np.argsort(keys)
    weight = (hits + 0.5) / (late + 1) if total else 0.0
    return Repeats(total, weight, keys[order], found.column("n").to_numpy()[order])


def held_out() -> Column:
    """The documents that nothing is learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1, F.lit(False))


def _score(rows: DataFrame, model: Model, words: tuple | None, ends: int, whole: float, segments: DataFrame) -> DataFrame:
    """doc_id, _row, held_out, n_tokens, n_known, base_score (of the end alone without words), score, bits_per_byte."""
    known_ = repeats(segments)
    sent = rows.sparkSession.sparkContext.broadcast((model, words, known_))
    kind = rows.schema["doc_id"].dataType.simpleString()
    fields = (
        f"doc_id {kind}, held_out boolean, _row bigint, n_tokens bigint, n_known bigint, base_score double, n_bytes bigint, "
        "h bigint, bits double, gain double, own bigint, total bigint"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, words, known_segments = sent.value
        model.shed()
        for part, texts in slices(batches, "text", SLICE):
            w = Words(texts, lower=True)
            n = np.diff(w.first)
            known = np.full(len(texts), int(ends > 0))
            base = np.full(len(texts), np.log10((ends + 0.5) / whole))
            if words is not None and len(w.hash):
                number, found = pd.factorize(w.hash)
                count = lookup(words, found)
                of = w.text_of_word()
                known += np.bincount(of, weights=(count > 0)[number], minlength=len(n)).astype(np.int64)
                base += np.bincount(of, weights=np.log10((count + 0.5) / whole)[number], minlength=len(n))
            hashes, start, of = _segments(w, texts)
            del w
            bits = model.segment_bits(texts, start, of)
            # What the text itself gave to the counts.
            learned = ~part.column(1).to_numpy(zero_copy_only=False)[of]
            number, _ = pd.factorize(mix(hashes + of.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
            own = np.bincount(number)[number] * learned
            total = known_segments.total - np.bincount(of)[of] * learned
            count = lookup((known_segments.keys, known_segments.counts), hashes)
            done = count > 0
            gain = np.bincount(
                of[done], weights=known_segments.gain(bits[done], (count - own)[done], total[done]), minlength=len(texts)
            )
            row = part.column(2).to_numpy()
            schema = pa.schema(
                [("doc_id", part.column(0).type), ("held_out", pa.bool_()), ("_row", pa.int64()), ("n_tokens", pa.int64()),
                 ("n_known", pa.int64()), ("base_score", pa.float64()), ("n_bytes", pa.int64()), ("h", pa.int64()),
                 ("bits", pa.float64()), ("gain", pa.float64()), ("own", pa.int64()), ("total", pa.int64())]
            )
            none = {f.name: pa.nulls(len(texts), f.type) for f in schema}
            # A key of its own, so that these rows are spread over the join's tasks.
            yield output(schema, **(none | {
                "doc_id": part.column(0), "held_out": part.column(1), "_row": part.column(2), "n_tokens": n + 1,
                "n_known": known, "base_score": base, "n_bytes": np.array([max(1, len(t)) for t in texts]),
                "h": mix(row.view(np.uint64)).view(np.int64), "bits": np.bincount(of, weights=bits), "gain": gain,
            }))
            left = ~done
            none = {f.name: pa.nulls(int(left.sum()), f.type) for f in schema}
            yield output(schema, **(none | {
                "_row": row[of[left]], "h": hashes[left].view(np.int64), "bits": bits[left], "own": own[left], "total": total[left],
            }))

    out = rows.select("doc_id", "held_out", "_row", "text").mapInArrow(run, fields)
    out = out.join(segments.select("h", "n"), "h", "left")
    count = F.coalesce("n", F.lit(0)) - F.col("own")
    text = F.col("n_tokens").isNotNull()
    gain = F.when(text, F.col("gain")).otherwise(known_.gain_column(F.col("bits"), count, F.col("total")))
    names = ("doc_id", "held_out", "n_tokens", "n_known", "base_score", "n_bytes")
    out = out.groupBy("_row").agg(
        *(F.max(name).alias(name) for name in names), (F.sum(F.when(text, F.col("bits"))) - F.sum(gain)).alias("bits")
    )
    return out.select(
        "doc_id", "_row", "held_out", "n_tokens", "n_known", "base_score",
        (-F.col("bits") * F.lit(float(np.log10(2.0)))).alias("score"), (F.col("bits") / F.col("n_bytes")).alias("bits_per_byte"),
    )


def lookup(words: tuple[np.ndarray, np.ndarray], found: np.ndarray) -> np.ndarray:
    """The count of each word; words: sorted hashes and their counts."""
    keys, counts = words
    if not len(keys):
        return np.zeros(len(found), dtype=np.int64)
    at = np.minimum(np.searchsorted(keys, found), len(keys) - 1)
    return np.where(keys[at] == found, counts[at], 0)


def _base_by_join(rows: DataFrame, words: DataFrame, whole: float) -> DataFrame:
    """_row, known, base: over each row's words, by a shuffled join."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches, "text", SLICE):
            w = Words(texts, lower=True)
            row = part.column(0).to_numpy()[w.text_of_word()]
            yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(w.hash.view(np.int64))], names=["_row", "h"])

    tokens = rows.select("_row", "text").mapInArrow(run, "_row bigint, h bigint").groupBy("_row", "h").agg(F.count("*").alias("tf"))
    c = F.coalesce("n", F.lit(0))
    return (
        tokens.join(words, "h", "left").groupBy("_row")
        .agg(
            F.sum(F.when(c > 0, F.col("tf")).otherwise(0)).alias("known"),
            F.sum(F.col("tf") * F.log10((c + 0.5) / F.lit(whole))).alias("base"),
        )
    )


def score(docs: DataFrame, model: Model, train: DataFrame, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """Both scores of docs (doc_id, text, held_out); words and segments are counted in train (doc_id, text)."""
    small_batches(docs.sparkSession)
    counted = materialize(count_table(train), "counts")
    words, segments = counted.where("NOT segment").select("h", "n"), counted.where("segment").select("h", "n", "late")
    n, v = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    ends = train.count()
    tokens, distinct = n + ends, v + (ends > 0)
    whole = tokens + 0.5 * (distinct + 1)
    rows = docs.select("doc_id", "text", "held_out", F.monotonically_increasing_id().alias("_row"))
    if v <= max_broadcast:
        found = words.toArrow()
        keys = found.column("h").to_numpy().view(np.uint64)
        order = np.argsort(keys)
        sent = (keys[order], found.column("n").to_numpy()[order])
        out = _score(rows, model, sent, ends, whole, segments)
    else:
        rows = materialize(rows, "rows")  # both sides of the join must number rows alike
        base = _base_by_join(rows, words, whole)
        out = (
            _score(rows, model, None, ends, whole, segments).join(base, "_row", "left")
            .withColumn("n_known", F.col("n_known") + F.coalesce("known", F.lit(0)))
            .withColumn("base_score", F.col("base_score") + F.coalesce("base", F.lit(0.0)))
        )
    return out.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("bigint").alias("train_tokens"),
        "base_score", "score", "bits_per_byte",
    )


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both scores of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", held_out().alias("held_out"))
    train = docs.where(~F.col("held_out"))
    return score(docs, fit(train), train)


QUERIES = {"op9_lm_scoring": op9_lm_scoring}
ORACLE: dict[str, str] = {}
