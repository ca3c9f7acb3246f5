"""Helpers shared by the operators: storage, batching and vectorised word hashing."""

from __future__ import annotations

import ctypes
import re
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but these bytes (space, tab, LF, VT, FF, CR).
WHITE = bytes([0x20, *range(0x09, 0x0E)])

_MASK = (1 << 64) - 1


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; set here only where it is unset.

    Without the setting it is made beside the warehouse; on a cluster that must not be a
    machine's own folder.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        found = f"{spark.conf.get('spark.sql.warehouse.dir')}/_shared"
        if not spark.sparkContext.master.startswith("local") and found.startswith(("file:", "/")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


_scopes: list[list[str]] = []


@contextmanager
def scratch() -> Iterator[list[str]]:
    """The paths that new_path() gives meanwhile, so that the caller can delete them when they are done with."""
    made: list[str] = []
    _scopes.append(made)
    try:
        yield made
    finally:
        _scopes.remove(made)


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder."""
    path = f"{shared_dir(spark)}/sievekit/{name}-{uuid.uuid4().hex}"
    for made in _scopes:
        made.append(path)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it again.

    This cuts the lineage in a way that survives the loss of executors.
    """
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared storage, through Hadoop's file system."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


#: Shares that a hot key's rows are dealt into where a lookup table is too large to broadcast.
SALTS = 32


def looked_up(rows: DataFrame, lookup: DataFrame, key: str, most: int, spread: list[str]) -> DataFrame:
    """rows left-joined with lookup, a table of one row a key.

    Up to most rows it is broadcast. Beyond, both sides are dealt by key and a salt (the hash
    of the columns spread), so that a key that many rows share makes SALTS tasks, not one.
    """
    if lookup.limit(most + 1).count() <= most:
        return rows.join(F.broadcast(lookup), key, "left")
    salted = lookup.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = rows.withColumn("__salt", F.pmod(F.xxhash64(*spread), F.lit(SALTS)).cast("int"))
    return dealt.join(salted, [key, "__salt"], "left").drop("__salt")


def numbered(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """rows with __nth, their place from 1 in the order, without a window over all of them.

    They are dealt by ranges of the order, sorted and written; what comes to the driver is one
    number a partition. rows must read alike twice (a written table), and the order must tell
    equal rows apart, or all of them go to one range.
    """
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    own = F.monotonically_increasing_id()
    dealt = dealt.withColumn("__part", F.shiftright(own, 33)).withColumn("__at", own.bitwiseAND(F.lit((1 << 33) - 1)))
    dealt = materialize(dealt, name)
    before, starts = 1, []
    for part, n in sorted((r["__part"], r["n"]) for r in dealt.groupBy("__part").agg(F.count("*").alias("n")).collect()):
        starts.append((part, before))
        before += n
    starts = rows.sparkSession.createDataFrame(starts, "__part bigint, __start bigint")
    return dealt.join(F.broadcast(starts), "__part").withColumn("__nth", F.col("__start") + F.col("__at")).drop("__part", "__at", "__start")


_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def release() -> None:
    """Give the system back what this worker has freed: workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


#: What a worker remembers for later tasks of one kind, by the kind.
_remembered: dict[str, object] = {}


def remembered(kind: str, make: Callable[[], object]) -> object:
    """What this worker remembers for tasks of that kind; made if there is nothing."""
    if kind not in _remembered:
        _remembered[kind] = make()
    return _remembered[kind]


def _forget_others(kind: str | None) -> None:
    """Forget what tasks of other kinds have left in this worker: workers go on from stage to stage."""
    for other in [k for k in _remembered if k != kind]:
        del _remembered[other]


#: Most bytes of a batch that a task hands to its Python worker.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound the batches that go to Python workers by bytes: texts can be long."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key, None)
    if now is None or int(re.sub(r"\D", "", now) or 0) != BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def slices(
    batches: Iterator[pa.RecordBatch], column: str, max_bytes: int = 4 << 20, kind: str | None = None
) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Parts of the batches of some max_bytes of text each, with the texts as UTF-8 (null: empty).

    A single longer text makes a part of its own. kind: of what the task remembers; the rest is forgotten.
    """
    _forget_others(kind)
    parts = 0
    for batch in batches:
        at = batch.schema.get_field_index(column)
        texts = batch.column(at).cast(pa.large_binary()).to_pylist()
        begin = size = 0
        for k, text in enumerate(texts):
            size += len(text or b"") + 1
            if size >= max_bytes or k + 1 == len(texts):
                yield batch.slice(begin, k + 1 - begin), [t or b"" for t in texts[begin : k + 1]]
                begin, size, parts = k + 1, 0, parts + 1
                if parts % 8 == 0:
                    release()
    release()


def stretches(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of rows whose sizes add up to no more than most, or of a single larger row."""
    begin, total = 0, 0
    for k, n in enumerate(sizes.tolist()):
        if total and total + n > most:
            yield begin, k
            begin, total = k, 0
        total += n
    if begin < len(sizes):
        yield begin, len(sizes)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser that spreads each bit of a uint64 over all others."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BASE = 0x9E3779B97F4A7C15
_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE)) | np.uint64(1)
_IS_WHITE = np.zeros(256, dtype=bool)
_IS_WHITE[list(WHITE)] = True
#: Powers of the base and of its inverse modulo 2**64 are put together from those up to _STEP and its multiples:
#: whole tables would stay in each worker, 16 bytes for each byte of its largest slice.
_STEP = 1 << 12
_BASES = (_BASE, pow(_BASE, -1, 1 << 64))


def _accumulated(base: int, n: int) -> np.ndarray:
    """The first n powers of the base."""
    steps = np.full(n, base & _MASK, dtype=np.uint64)
    steps[:1] = 1
    return np.multiply.accumulate(steps)


_LOW = [_accumulated(base, _STEP) for base in _BASES]


def _high(k: int, n: int) -> np.ndarray:
    """Powers of base k by the multiples of _STEP up to n."""
    return _accumulated(pow(_BASES[k], _STEP, 1 << 64), n // _STEP + 1)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, n of each at least."""
    up, down = ((_high(k, n)[:, None] * _LOW[k]).ravel() for k in range(2))
    return up, down


def span_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A uint64 hash of data[start:end] for each span."""
    n = len(data)
    up, down = _high(0, n), _high(1, n)
    total = np.zeros(n + 1, dtype=np.uint64)
    for first in range(0, n, _STEP):
        part = total[first + 1 : first + 1 + _STEP]
        np.multiply(_BYTES[data[first : first + _STEP]], _LOW[0][: len(part)], out=part)
        part *= up[first // _STEP]
    np.cumsum(total, out=total)
    length = (end - start).astype(np.uint64)
    begun = down[start // _STEP] * _LOW[1][start % _STEP]
    return mix((total[end] - total[start]) * begun + length * np.uint64(_BASE))


class Words:
    """The words of some texts: their hashes, places, and the text that each is in.

    hash: uint64 a word; start, end: byte offsets in data; first: index of the first
    word of each text, and the number of words at its end.
    """

    def __init__(self, texts: list[bytes], lower: bool) -> None:
        joined = b"\n".join(texts) + b"\n"
        if lower:
            joined = joined.lower()
        self.data = np.frombuffer(joined, dtype=np.uint8)
        white = _IS_WHITE[self.data]
        change = np.flatnonzero(white[1:] != white[:-1]) + 1
        if not white[0]:
            change = np.concatenate([[0], change])
        self.start, self.end = change[0::2], change[1::2]
        self.hash = span_hash(self.data, self.start, self.end)
        sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + 1
        self.bounds = np.concatenate([[0], np.cumsum(sizes)])
        self.first = np.searchsorted(self.start, self.bounds)

    def text_of_word(self) -> np.ndarray:
        """For each word the index of its text."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def shingles(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all windows of size words within a text, and the index of their first word."""
        n = len(self.hash) - size + 1
        if n <= 0:
            return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
        of = self.text_of_word()
        whole = np.flatnonzero(of[:n] == of[size - 1 :])
        h = np.zeros(n, dtype=np.uint64)
        for k in range(size):
            h = h * np.uint64(0xD6E8FEB86659FD93) + self.hash[k : k + n]
        return mix(h[whole] + np.uint64(size)), whole


def word_hash(word: bytes) -> int:
    """The hash that Words gives to one word."""
    return int(Words([word], lower=False).hash[0])


def output(schema: pa.Schema, **columns) -> pa.RecordBatch:
    """A batch with the schema's types from arrays or lists by name."""
    return pa.RecordBatch.from_arrays(
        [
            c if isinstance(c := columns[f.name], pa.Array) else pa.array(c, type=f.type)
            for f in schema
        ],
        schema=schema,
    )
