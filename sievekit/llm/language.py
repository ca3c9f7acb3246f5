"""Language ID: script ranges narrow the candidates, Viterbi labels spans of words.

A model holds, for each language, the log-probabilities of hashed character n-grams and
the scripts that it is written in. A word's script leaves the languages that use it; the
word's n-grams score these. Over the words of a text the Viterbi path, with a penalty
for each switch, labels spans; the text's language is the one with most letters. Letters
are those of Unicode; scripts without a range of their own go together as one.

The model is fitted on MAX_TRAIN documents at most, those of the smallest hash of their
id among the labelled ones that the fold allows, and knows every language of theirs.
Predictions use whole texts and nothing but the text.

Defined results: a null text or one without letters is "und" with score 0; ties go to
the language that sorts first; repeated rows are predicted once each; without labelled
rows all texts are "und"; further columns are ignored. A text of any length is labelled
whole, in segments whose transfer is kept for every label before them, so the path is
that of the undivided text.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievekit.llm.common import output, slices, small_batches, Words

#: Most labelled documents that the model is fitted on.
MAX_TRAIN = 20_000
#: Slots of hashed n-grams; sizes of n-grams; added to each count.
SLOTS, SIZES, ADDED = 1 << 17, (1, 2, 3, 4), 0.5
#: Log-odds that a single word can give, those lost by a switch, and a script's least share.
MOST_PER_WORD, SWITCH, LEAST_SHARE = 6.0, 14.0, 0.01
#: Words of a segment, and most languages for which texts are cut into segments: these cost
#: the square of the languages. Beyond, texts go undivided, and slices are smaller.
SEGMENT, MAX_SEGMENTED = 256, 64
SLICE = 1 << 20
UNKNOWN = "und"

#: First and last code points of letters by script: fixed values.
SCRIPTS = (
    ("latin", ((0x41, 0x5A), (0x61, 0x7A), (0xAA, 0xAA), (0xBA, 0xBA), (0xC0, 0xD6), (0xD8, 0xF6), (0xF8, 0x24F), (0x1E00, 0x1EFF))),
    ("greek", ((0x370, 0x373), (0x376, 0x377), (0x37B, 0x37D), (0x386, 0x386), (0x388, 0x3FF), (0x1F00, 0x1FBC))),
    ("cyrillic", ((0x400, 0x481), (0x48A, 0x52F))),
    ("armenian", ((0x531, 0x556), (0x561, 0x587))),
    ("hebrew", ((0x5D0, 0x5EA),)),
    ("arabic", ((0x620, 0x64A), (0x671, 0x6D3))),
    ("devanagari", ((0x904, 0x939),)),
    ("bengali", ((0x985, 0x9B9),)),
    ("tamil", ((0xB85, 0xBB9),)),
    ("thai", ((0xE01, 0xE30),)),
    ("georgian", ((0x10A0, 0x10FA),)),
    ("hangul", ((0x1100, 0x11FF), (0xAC00, 0xD7A3))),
    ("kana", ((0x3041, 0x3096), (0x30A1, 0x30FA))),
    ("han", ((0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0x20000, 0x2FA1F))),
)

#: Letters of all other scripts.
OTHER = len(SCRIPTS) + 1


def _script_table() -> np.ndarray:
    table = np.zeros(sys.maxunicode + 1, dtype=np.uint8)
    table[[k for k in range(len(table)) if unicodedata.category(chr(k))[0] == "L"]] = OTHER
    for k, (_, ranges) in enumerate(SCRIPTS):
        for a, b in ranges:
            part = table[a : b + 1]
            part[part > 0] = k + 1  # a range also holds signs that are no letters
    return table


_SCRIPT_OF = _script_table()


def script_of(points: np.ndarray) -> np.ndarray:
    """The script of each code point, counted from 1; OTHER for letters of none of these, 0 for what is no letter."""
    return _SCRIPT_OF[points]


class Vocabulary:
    """The distinct words of some texts as code points, and their n-gram slots."""

    def __init__(self, texts: list[bytes]) -> None:
        low = [t.decode("utf-8", "replace").lower().encode() for t in texts]
        self.words = w = Words(low, lower=False)
        _, at, self.of = np.unique(w.hash, return_index=True, return_inverse=True)
        start, size = w.start[at], w.end[at] - w.start[at] + 1
        upto = np.concatenate([[0], np.cumsum(size)])
        take = np.arange(upto[-1]) + np.repeat(start - upto[:-1], size)
        data = w.data[take].copy()
        data[upto[1:] - 1] = 0x20
        points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), dtype=np.uint32)
        ends = np.flatnonzero(points == 0x20)
        self.n = len(at)
        script = script_of(points)
        # What is no letter becomes a boundary; a boundary comes before and after each word.
        self.points = np.concatenate([[0], np.where(script > 0, points, 0)]).astype(np.uint64)
        self.first = np.concatenate([[0], ends[:-1] + 1])
        self.last = ends + 1  # of the boundary after the word, in self.points
        total = np.concatenate([[0], np.cumsum(script > 0)])
        self.letters = total[ends] - total[self.first]
        # The script of a word is that of its last letter.
        seen = np.maximum.accumulate(np.where(script > 0, np.arange(len(script)), -1))
        place = seen[ends - 1] if self.n else seen[:0]
        self.script = np.where(place >= self.first, script[np.maximum(place, 0)], 0)

    def slots(self, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Slots of the n-grams at each place, and for each word the first and end place."""
        n = len(self.points) - size + 1
        code = np.zeros(max(n, 0), dtype=np.uint64)
        for k in range(size):
            code = code * np.uint64(0x9E3779B97F4A7C15) + self.points[k : k + max(n, 0)] + np.uint64(1)
        code ^= code >> np.uint64(29)
        code *= np.uint64(0xBF58476D1CE4E5B9)
        slot = (code >> np.uint64(40)) % np.uint64(SLOTS)
        begin = self.first + (size == 1)
        end = np.maximum(self.last - size + 2 - (size == 1), begin)
        return slot.astype(np.int64), begin, end


@dataclass(frozen=True)
class Model:
    """languages; table: [sizes, SLOTS, languages] log-probabilities; uses: [scripts + 1, languages]."""

    languages: tuple[str, ...]
    table: np.ndarray
    uses: np.ndarray

    def scores(self, v: Vocabulary) -> np.ndarray:
        """Log-odds of each distinct word in each language: 0 for the best, MOST_PER_WORD below it at most."""
        out = np.zeros((v.n, len(self.languages)), dtype=np.float32)
        for k, size in enumerate(SIZES):
            slot, begin, end = v.slots(size)
            for j in range(len(self.languages)):
                total = np.concatenate([[0.0], np.cumsum(self.table[k, :, j][slot], dtype=np.float64)])
                end_ = np.minimum(end, len(slot))
                out[:, j] += total[np.maximum(end_, begin)] - total[begin] if len(slot) else 0
        out = np.where(self.uses[v.script], out, -np.inf)
        best = out.max(axis=1, keepdims=True)
        out = np.maximum(out - best, -MOST_PER_WORD)
        out[v.letters == 0] = 0
        return out


def viterbi(e: np.ndarray, first: np.ndarray, penalty: float = SWITCH, segment: int = SEGMENT) -> np.ndarray:
    """The best label of each word; e: scores by word and label, first: bounds of the texts.

    Texts are cut into segments that go side by side; each keeps the best path for every
    label of the word before it, and these are joined afterwards.
    """
    sizes = np.diff(first)
    labels = e.shape[1]
    kind = np.uint8 if labels <= 256 else np.uint16
    parts = -(-sizes // segment)
    n = int(parts.sum())
    if n == 0:
        return np.zeros(0, dtype=kind)
    text = np.repeat(np.arange(len(sizes)), parts)
    base = np.cumsum(parts) - parts
    nth = np.arange(n) - base[text]
    start = first[:-1][text] + nth * segment
    length = np.minimum(segment, first[1:][text] - start)
    order = np.argsort(-length, kind="stable")
    start, length, nth_o = start[order], length[order], nth[order]
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.arange(n)
    longest = int(length[0])
    alive = np.searchsorted(-length, -np.arange(1, longest + 1), side="right")
    own = np.arange(labels, dtype=kind)
    if n == (parts > 0).sum():  # no text is divided: nothing is before a segment
        v = e[start][:, None, :].copy()
    else:
        enter = np.where(np.eye(labels, dtype=bool), 0.0, -penalty).astype(np.float32)
        v = np.where((nth_o == 0)[:, None, None], np.float32(0), enter[None]) + e[start][:, None, :]
    back = []
    for t in range(1, longest):
        k = alive[t]
        now = v[:k]
        top = now.max(axis=2, keepdims=True)
        arg = now.argmax(axis=2).astype(kind)[:, :, None]
        switch = top - penalty > now
        back.append(np.where(switch, arg, own))
        v[:k] = np.where(switch, top - penalty, now) + e[start[:k] + t][:, None, :]
    # Join the segments of each text.
    before = np.zeros(n, dtype=kind)
    by_parts = np.argsort(-parts, kind="stable")
    by_parts = by_parts[: np.searchsorted(-parts[by_parts], 0, side="left")]
    most = parts[by_parts]
    best = v[rank[base[by_parts]]][:, 0, :].astype(np.float64)
    args = []
    for k in range(1, int(most[0])):
        m = np.searchsorted(-most, -(k + 1), side="right")
        way = best[:m, :, None] + v[rank[base[by_parts[:m]] + k]]
        args.append(way.argmax(axis=1).astype(kind))
        best[:m] = way.max(axis=1)
    cur = best.argmax(axis=1).astype(kind)
    last = np.zeros(n, dtype=kind)
    for k in range(int(most[0]) - 1, -1, -1):
        m = np.searchsorted(-most, -(k + 1), side="right")
        seg = rank[base[by_parts[:m]] + k]
        last[seg] = cur[:m]
        if k:
            cur[:m] = args[k - 1][np.arange(m), cur[:m]]
            before[seg] = cur[:m]
    # Follow the segments back.
    out = np.zeros(int(first[-1]), dtype=kind)
    cur = last.copy()
    rows = np.arange(n)
    for t in range(longest - 1, -1, -1):
        k = alive[t]
        out[start[:k] + t] = cur[:k]
        if t:
            cur[:k] = back[t - 1][rows[:k], before[:k], cur[:k]]
    return out


def label(texts: list[bytes], model: Model) -> tuple[list[str], np.ndarray, Vocabulary, np.ndarray]:
    """The language and score of each text, the words, and the label of each word."""
    v = Vocabulary(texts)
    n, names = len(texts), model.languages
    if not names:
        return [UNKNOWN] * n, np.zeros(n), v, np.zeros(len(v.of), dtype=np.uint8)
    most = int(np.diff(v.words.first).max(initial=1))
    segment = SEGMENT if len(names) <= MAX_SEGMENTED else max(1, most)
    path = viterbi(model.scores(v)[v.of], v.words.first, segment=segment)
    of = v.words.text_of_word()
    letters = np.bincount(of * len(names) + path.astype(np.int64), weights=v.letters[v.of], minlength=n * len(names)).reshape(n, -1)
    every = letters.sum(axis=1)
    best = letters.argmax(axis=1)
    score = letters.max(axis=1) / np.maximum(every, 1)
    found = [names[k] for k in best]
    for k in np.flatnonzero(every < 3):
        if not any(c.isalpha() for c in texts[k].decode("utf-8", "replace")):
            found[k], score[k] = UNKNOWN, 0.0
    return found, score, v, path


def _count(docs: DataFrame) -> DataFrame:
    """lang, size number (-1: letters of scripts), slot, n: over docs with text, lang."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, np.ndarray] = {}
        scripts: dict[str, np.ndarray] = {}
        for part, texts in slices(batches, "text"):
            langs = part.column(1).to_pylist()
            for lang in set(langs):
                own = Vocabulary([t for t, k in zip(texts, langs, strict=True) if k == lang])
                times = np.bincount(own.of, minlength=own.n)
                table = found.setdefault(lang, np.zeros((len(SIZES), SLOTS)))
                seen = scripts.setdefault(lang, np.zeros(OTHER + 1))
                seen += np.bincount(own.script, weights=times * own.letters, minlength=len(seen))
                for k, size in enumerate(SIZES):
                    slot, begin, end = own.slots(size)
                    end = np.minimum(end, len(slot))
                    weight = np.zeros(len(slot) + 1)
                    np.add.at(weight, begin, times)
                    np.add.at(weight, np.maximum(end, begin), -times)
                    table[k] += np.bincount(slot, weights=np.cumsum(weight)[:-1], minlength=SLOTS)
        for lang in found:
            for k, row in [*enumerate(found[lang]), (-1, scripts[lang])]:
                at = np.flatnonzero(row)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([lang] * len(at), type=pa.string()),
                        pa.array(np.full(len(at), k), type=pa.int32()),
                        pa.array(at, type=pa.int32()),
                        pa.array(row[at].astype(np.int64)),
                    ],
                    names=["lang", "k", "slot", "n"],
                )

    rows = docs.select("text", "lang").mapInArrow(run, "lang string, k int, slot int, n bigint")
    return rows.groupBy("lang", "k", "slot").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, most: int = MAX_TRAIN) -> Model:
    """Learn from the documents with a text and a lang: most ids at most, and one row of an id, that of the least text."""
    small_batches(docs.sparkSession)
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    ids = known.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    chosen = known.join(F.broadcast(ids), "doc_id", "left_semi")
    one = chosen.groupBy("doc_id").agg(F.min(F.struct("text", "lang")).alias("one")).select("one.*")
    rows = _count(one).toPandas()
    size = rows[rows.k == -1].groupby("lang").n.sum()
    names = sorted(size.index)
    table = np.zeros((len(SIZES), SLOTS, len(names)), dtype=np.float32)
    uses = np.zeros((OTHER + 1, len(names)), dtype=bool)
    for j, lang in enumerate(names):
        own = rows[rows.lang == lang]
        for k in range(len(SIZES)):
            counts = np.zeros(SLOTS)
            part = own[own.k == k]
            counts[part.slot] = part.n
            table[k, :, j] = np.log((counts + ADDED) / (counts.sum() + ADDED * SLOTS))
        seen = np.zeros(OTHER + 1)
        part = own[own.k == -1]
        seen[part.slot] = part.n
        uses[:, j] = seen > LEAST_SHARE * seen.sum()
    uses[~uses.any(axis=1)] = True
    uses[0] = True
    return Model(tuple(names), table, uses)


def identify(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """keep's columns (default doc_id) of docs, with lang_pred, score and n_spans.

    The model has SLOTS x n-gram sizes numbers a language (2 MB) and is broadcast.
    """
    small_batches(docs.sparkSession)
    keep = keep or ["doc_id"]
    sent = docs.sparkSession.sparkContext.broadcast(model)
    most = SLICE * MAX_SEGMENTED // max(MAX_SEGMENTED, len(model.languages))
    own = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("n_spans", T.LongType())]
    out = T.StructType(docs.select(*keep).schema.fields + own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches, "_text", most):
            found, score, v, path = label(texts, sent.value)
            # A span ends where the label changes or the text does.
            of = v.words.text_of_word()
            first = np.ones(len(of), dtype=bool)
            first[1:] = (of[1:] != of[:-1]) | (path[1:] != path[:-1])
            spans = np.bincount(of, weights=first, minlength=len(texts)).astype(np.int64)
            schema = pa.schema(
                [*list(part.schema)[:-1], ("lang_pred", pa.string()), ("score", pa.float64()), ("n_spans", pa.int64())]
            )
            kept = dict(zip(part.schema.names[:-1], part.columns[:-1], strict=True))
            yield output(schema, **kept, lang_pred=found, score=score, n_spans=spans)

    return docs.select(*keep, F.col("text").alias("_text")).mapInArrow(run, out)


def held_out() -> Column:
    """The documents that nothing is learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs.where(~held_out()))
    return identify(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "n_spans")


QUERIES = {"op2_language_id": op2_language_id}
ORACLE: dict[str, str] = {}
