"""Benchmark decontamination: pigeonhole edit matching.

A test item of n normalised characters may be hit with k = n // CHARS_PER_ERROR edits.
Cut into k + 1 pieces, one of them stays exact in every such hit, so an Aho-Corasick
automaton of all pieces finds the candidates; each window that a piece points at is
verified by Myers' bit-parallel edit distance.

Normalised: lower case, white space runs as one space, none at the ends.

The items go to the tasks in slices of SLICE_CHARS characters at most; more items take
more passes over the documents, none is left out.

Defined results: null and empty texts or items give no hit; items of fewer than
CHARS_PER_ERROR characters must be hit exactly; repeated documents or items are reported
once each row; an empty table gives an empty result; further columns are ignored. Texts
are searched whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from sievekit.llm.common import small_batches

CHARS_PER_ERROR = 12
SLICE_CHARS = 8_000_000


def normalise(text: str) -> str:
    """Lower case, single spaces, none at the ends."""
    return " ".join(text.lower().split())


def budget(n: int) -> int:
    """Edits allowed in an item of n characters."""
    return n // CHARS_PER_ERROR


def pieces(item: str, errors: int) -> list[tuple[int, str]]:
    """errors + 1 pieces of near-equal length that make up item, with their offsets."""
    n = len(item)
    cuts = [n * k // (errors + 1) for k in range(errors + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


@dataclass(frozen=True)
class Pattern:
    """What Myers' algorithm needs of an item."""

    item_id: int
    text: str
    errors: int
    masks: dict[str, int]

    @classmethod
    def of(cls, item_id: int, text: str) -> Pattern:
        masks: dict[str, int] = {}
        for k, c in enumerate(text):
            masks[c] = masks.get(c, 0) | 1 << k
        return cls(item_id, text, budget(len(text)), masks)

    def search(self, window: str) -> tuple[int, int]:
        """The least edit distance of the item to a substring of window, and the first end that has it."""
        m = len(self.text)
        full, high = (1 << m) - 1, m - 1
        pv, mv, score = full, 0, m
        best, end = m, 0
        masks = self.masks
        for at, c in enumerate(window, 1):
            eq = masks.get(c, 0)
            xv = eq | mv
            xh = (((eq & pv) + pv) ^ pv) | eq
            ph = mv | (full & ~(xh | pv))
            mh = pv & xh
            score += (ph >> high) - (mh >> high & 1)
            if score < best:
                best, end = score, at
            ph = ph << 1 & full
            mh = mh << 1 & full
            pv = mh | (full & ~(xv | ph))
            mv = ph & xv
        return best, end


class Matcher:
    """Finds items in texts."""

    def __init__(self, items: list[tuple[int, str]]) -> None:
        import ahocorasick

        self.patterns = [Pattern.of(k, n) for k, t in items if (n := normalise(t))]
        places: dict[str, list[tuple[int, int]]] = {}
        for number, p in enumerate(self.patterns):
            for offset, piece in pieces(p.text, p.errors):
                places.setdefault(piece, []).append((number, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, where in places.items():
            self.automaton.add_word(piece, (len(piece), where))
        if places:
            self.automaton.make_automaton()

    def find(self, text: str) -> list[tuple[int, int, int, int]]:
        """item_id, distance, budget and end (in the normalised text) of the best hit of each item."""
        if not self.patterns:
            return []
        text = normalise(text)
        starts: dict[int, set[int]] = {}
        for last, (size, where) in self.automaton.iter(text):
            for number, offset in where:
                starts.setdefault(number, set()).add(last + 1 - size - offset)
        out = []
        for number, begins in starts.items():
            p = self.patterns[number]
            best = None
            for a, b in self._windows(sorted(begins), p):
                distance, end = p.search(text[max(0, a) : max(0, b)])
                if distance <= p.errors and (best is None or distance < best[0]):
                    best = (distance, max(0, a) + end)
            if best:
                out.append((p.item_id, best[0], p.errors, best[1]))
        return out

    @staticmethod
    def _windows(begins: list[int], p: Pattern) -> Iterator[tuple[int, int]]:
        """Stretches that hold all hits whose pieces begin there; near ones are searched as one."""
        size = len(p.text) + p.errors
        a = b = None
        for begin in begins:
            if a is not None and begin - p.errors <= b:
                b = begin + size
            else:
                if a is not None:
                    yield a, b
                a, b = begin - p.errors, begin + size
        if a is not None:
            yield a, b



def _slices(items: DataFrame, id_col: str, text_col: str, most: int) -> Iterator[list[tuple[int, str]]]:
    known = items.where(F.col(text_col).isNotNull()).select(
        F.col(id_col).alias("item_id"), F.col(text_col).alias("text")
    )
    total = known.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-total // most)
    for k in range(n):
        rows = known.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).collect()
        yield [(r.item_id, r.text) for r in rows]


def matches(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    slice_chars: int = SLICE_CHARS,
) -> DataFrame:
    """doc_id, item_id, distance, budget, end: the best hit of each item in each document that has one."""
    spark = docs.sparkSession
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    item = items.schema["item_id"].dataType
    fields = f"doc_id {kind}, item_id {item.simpleString()}, distance int, budget int, end bigint"
    item_type = to_arrow_type(item)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def searched(part: list[tuple[int, str]]) -> DataFrame:
        sent = spark.sparkContext.broadcast(part)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(sent.value)
            for batch in batches:
                keys, found = [], []
                for k, text in enumerate(batch.column(1).to_pylist()):
                    hits = matcher.find(text) if text else []
                    keys += [k] * len(hits)
                    found += hits
                columns = list(zip(*found, strict=True)) or [[]] * 4
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(keys, type=pa.int64())),
                        *(
                            pa.array(c, type=t)
                            for c, t in zip(columns, (item_type, pa.int32(), pa.int32(), pa.int64()), strict=True)
                        ),
                    ],
                    names=["doc_id", "item_id", "distance", "budget", "end"],
                )

        return rows.mapInArrow(run, fields)

    parts = [searched(p) for p in _slices(items, "item_id", "text", slice_chars)]
    if not parts:
        return spark.createDataFrame([], fields)
    return reduce(DataFrame.unionByName, parts)


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents that hold a benchmark item, with the item and the edit distance."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return matches(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES = {"op6_benchmark_decontamination": op6_benchmark_decontamination}
ORACLE: dict[str, str] = {}
