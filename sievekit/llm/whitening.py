"""Embedding whitening: principal components of the distinct rounded vectors.

An entry c becomes x = floor(256 * c), saturated to 64 bits. The fit list, each distinct x
vector once, is a written table of vectors packed in as few bytes as their entries need.
Each partition gathers count, local mean and centred scatter; Chan's formula merges them pair by
pair in treeReduce, so the driver gets some FAN_IN states of dimension^2 numbers, whatever the
rows. The driver finds the eigenvectors, and a second pass over the fit list gathers the
covariance of the whitened values the same way: its largest distance from the identity is
reported.

Defined results: rows whose vector is null, empty, or holds null or non-finite entries are left
out; so are rows of another length than the commonest of the fit list (ties: the longest).
Repeated rows give repeated results, null ids stay null. A component without variance (fewer
distinct vectors than dimensions, constant entries) is told by whitened = null and explained = 0;
if no component has any, explained is null. An empty table gives no row. deviation is null where
it does not fit 64 bits. Further columns are ignored.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievekit.llm.common import materialize, output, small_batches

SCALE = 256
COMPONENTS = 4
#: States that one merging step takes in, on the driver too.
FAN_IN = 16
#: A component whose eigenvalue is below this share of the largest, times the dimensions, is rounding.
NO_VARIANCE = 16 * np.finfo(np.float64).eps

_LIMIT = 1 << 62


@dataclass
class Moments:
    """Count, exact sums, mean and centred scatter of some vectors."""

    n: int
    sums: list[int] | None
    mean: np.ndarray
    scatter: np.ndarray

    def merge(self, other: Moments) -> Moments:
        """Of both together, by Chan's formula."""
        if not self.n or not other.n:
            return self if self.n else other
        n = self.n + other.n
        apart = other.mean - self.mean
        sums = None if self.sums is None else [a + b for a, b in zip(self.sums, other.sums, strict=True)]
        scatter = self.scatter + other.scatter + np.outer(apart, apart) * (self.n / n * other.n)
        return Moments(n, sums, self.mean + apart * (other.n / n), scatter)


def _nothing(dim: int) -> Moments:
    return Moments(0, [0] * dim, np.zeros(dim), np.zeros((dim, dim)))


def _gathered(rows: np.ndarray) -> Moments:
    """Of the rows of a matrix; the sums are exact if it holds integers."""
    sums = None
    if rows.dtype != np.float64:
        safe = int(np.abs(rows.astype(np.float64)).max(initial=0)) * len(rows) < _LIMIT
        sums = [int(s) for s in (rows if safe else rows.astype(object)).sum(axis=0)]
    own = rows.astype(np.float64)
    mean = own.mean(axis=0)
    own = own - mean
    # The mean is rounded, so what is left of it goes too.
    left = own.mean(axis=0)
    return Moments(len(rows), sums, mean + left, own.T @ own - np.outer(left, left) * len(rows))


def rounded(column: pa.Array) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """For each row its length (0: left out), and by length the places and the x vectors of the rows."""
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    entries = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    of = np.repeat(np.arange(len(sizes)), sizes)
    with np.errstate(invalid="ignore", over="ignore"):
        bad = np.bincount(of, weights=~np.isfinite(entries), minlength=len(sizes)) > 0
        scaled = np.floor(entries * SCALE)
        x = np.where(np.isfinite(scaled), np.clip(scaled, -(2.0**63), 2.0**63 - 1024), 0).astype(np.int64)
        x[scaled >= 2.0**63] = (1 << 63) - 1
        x[scaled < -(2.0**63)] = -(1 << 63)
    first = np.cumsum(sizes) - sizes
    sizes = np.where(bad, 0, sizes)
    found = []
    for size in np.unique(sizes[sizes > 0]).tolist():
        rows = np.flatnonzero(sizes == size)
        found.append((rows, x[first[rows][:, None] + np.arange(size)]))
    return sizes, found


def _packed(x: np.ndarray) -> list[bytes]:
    """Each row's entries in the fewest bytes that hold them all, after a byte that says how many."""
    low, high = x.min(axis=1), x.max(axis=1)
    out: list[bytes] = [b""] * len(x)
    done = np.zeros(len(x), dtype=bool)
    for kind in (np.int8, np.int16, np.int32, np.int64):
        fits = ~done & (low >= np.iinfo(kind).min) & (high <= np.iinfo(kind).max)
        mark, width = bytes([np.dtype(kind).itemsize]), np.dtype(kind).itemsize * x.shape[1]
        data = x[fits].astype(np.dtype(kind).newbyteorder("<")).tobytes()
        for k, row in enumerate(np.flatnonzero(fits).tolist()):
            out[row] = mark + data[k * width : (k + 1) * width]
        done |= fits
    return out


def _unpacked(keys: list[bytes], dim: int) -> np.ndarray:
    """The x vectors of packed keys."""
    out = np.zeros((len(keys), dim), dtype=np.int64)
    widths = np.array([k[0] for k in keys])
    for width in np.unique(widths).tolist():
        rows = np.flatnonzero(widths == width)
        out[rows] = np.frombuffer(b"".join(keys[k][1:] for k in rows.tolist()), dtype=f"<i{width}").reshape(len(rows), dim)
    return out


def _vectors(vectors: DataFrame, vec_col: str) -> DataFrame:
    """The vector column alone, with entries that are floating point numbers."""
    kind = vectors.schema[vec_col].dataType.elementType
    own = F.col(vec_col)
    return vectors.withColumn(vec_col, own if isinstance(kind, T.FloatType | T.DoubleType) else own.cast("array<double>"))


def fit_list(vectors: DataFrame, vec_col: str = "embedding") -> DataFrame:
    """dim and key (packed x vector) of each distinct x vector, written."""
    small_batches(vectors.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("dim", pa.int32()), ("key", pa.binary())])
        for batch in batches:
            for _, x in rounded(batch.column(0))[1]:
                yield output(schema, dim=np.full(len(x), x.shape[1], dtype=np.int32), key=_packed(x))

    packed = _vectors(vectors, vec_col).select(vec_col).mapInArrow(run, "dim int, key binary")
    return materialize(packed.distinct(), "whitening-fit")


def _moments(fitted: DataFrame, dim: int, of: Callable[[np.ndarray], np.ndarray], width: int) -> Moments:
    """Of what `of` makes of the fit list's x vectors (width numbers each), merged in a tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = _nothing(width)
        for batch in batches:
            keys = batch.column(0).to_pylist()
            step = max(1, (8 << 20) // (8 * dim))
            for k in range(0, len(keys), step):
                total = total.merge(_gathered(of(_unpacked(keys[k : k + step], dim))))
        yield output(pa.schema([("state", pa.binary())]), state=[pickle.dumps(total)])

    states = fitted.where(F.col("dim") == dim).select("key").mapInArrow(run, "state binary").rdd
    parts = states.getNumPartitions()
    if not parts:
        return _nothing(width)
    depth = max(2, math.ceil(math.log(max(parts, 2)) / math.log(FAN_IN)))
    return states.map(lambda r: pickle.loads(r["state"])).treeReduce(Moments.merge, depth)


@dataclass
class Whitening:
    """What apply() needs: n and sums of the fit list, unit components in rows with eigenvalues and shares."""

    dim: int
    n: int
    sums: list[int]
    components: np.ndarray
    eigenvalues: np.ndarray
    explained: np.ndarray | None
    identity_error: float | None

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n * x - sums, in Python's integers where 64 bits could be too few."""
        most = max(int(np.abs(x.astype(np.float64)).max(initial=0)) * self.n, *map(abs, self.sums))
        exact = x if most < _LIMIT // 2 else x.astype(object)
        return exact * self.n - np.array(self.sums, dtype=exact.dtype)

    def whitened(self, apart: np.ndarray) -> np.ndarray:
        """Whitened values of centred() rows; NaN where a component has no variance."""
        with np.errstate(divide="ignore", invalid="ignore"):
            scale = np.where(self.eigenvalues > 0, 1 / np.sqrt(self.eigenvalues), np.nan)
        return (apart.astype(np.float64) / self.n) @ self.components.T * scale


def fit(spark: SparkSession, fitted: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of a fit_list(); None if that is empty. components: how many of the largest."""
    dims = fitted.groupBy("dim").agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("dim")).first()
    if dims is None:
        return None
    dim = dims["dim"]
    found = _moments(fitted, dim, lambda x: x, dim)
    values, vectors = np.linalg.eigh(found.scatter / found.n)
    values, vectors = values[::-1], vectors.T[::-1]
    trace = float(np.trace(found.scatter) / found.n)
    values = np.where(values > values[0] * dim * NO_VARIANCE, values, 0.0)[:components]
    vectors = vectors[:components]
    # Either sign is right; the largest entry is positive, so that reruns agree.
    largest = np.take_along_axis(vectors, np.abs(vectors).argmax(axis=1)[:, None], axis=1)
    vectors = np.ascontiguousarray(vectors * np.where(largest < 0, -1.0, 1.0))
    model = Whitening(dim, found.n, found.sums, vectors, values, values / trace if trace > 0 else None, None)
    kept = int((values > 0).sum())
    if kept:
        check = _moments(fitted, dim, lambda x: model.whitened(model.centred(x))[:, :kept], kept)
        model.identity_error = float(np.abs(check.scatter / check.n - np.eye(kept)).max())
    return model


def apply(vectors: DataFrame, model: Whitening, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error of each row that is fit for it."""
    small_batches(vectors.sparkSession)
    kind = vectors.schema[id_col].dataType.simpleString()
    count = len(model.eigenvalues)
    most = (1 << 63) - 1

    def deviation(apart: np.ndarray) -> list[int | None]:
        big = apart.dtype == object or float(np.abs(apart).max(initial=0)) ** 2 * apart.shape[1] >= _LIMIT
        total = ((apart.astype(object) if big else apart) ** 2).sum(axis=1)
        return [v if v <= most else None for v in total.tolist()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            schema = pa.schema([
                ("vec_id", batch.column(0).type), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64()),
                ("whitened", pa.float64()), ("explained", pa.float64()), ("identity_error", pa.float64()),
            ])
            for rows, x in rounded(batch.column(1))[1]:
                if x.shape[1] != model.dim:
                    continue
                apart = model.centred(x)
                size = len(rows) * count
                each = np.repeat(np.arange(len(rows)), count)
                spread = deviation(apart)
                shares = [None] * count if model.explained is None else model.explained.tolist()
                yield output(
                    schema,
                    vec_id=batch.column(0).take(pa.array(rows[each])),
                    component=np.tile(np.arange(1, count + 1, dtype=np.int32), len(rows)),
                    n=np.full(size, model.n),
                    deviation=[spread[k] for k in each.tolist()],
                    whitened=pa.array(model.whitened(apart).ravel(), from_pandas=True),
                    explained=pa.array(shares * len(rows), type=pa.float64()),
                    identity_error=pa.array([model.identity_error] * size, type=pa.float64()),
                )

    return _vectors(vectors, vec_col).select(F.col(id_col).alias("vec_id"), vec_col).mapInArrow(
        run, f"vec_id {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    )


def whiten(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """apply() with the whitening fitted on the same vectors."""
    model = fit(vectors.sparkSession, fit_list(vectors, vec_col), components)
    if model is None:
        model = Whitening(0, 0, [], np.zeros((0, 0)), np.zeros(0), None, None)
    return apply(vectors, model, id_col, vec_col)


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitening of all embeddings."""
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES = {"op11_embedding_whitening": op11_embedding_whitening}
ORACLE: dict[str, str] = {}
