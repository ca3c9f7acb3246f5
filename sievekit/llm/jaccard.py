"""N-gram Jaccard join: rare-first prefixes with length, positional and suffix filters.

A document's set holds the hashes of its distinct shingles. Equal sets make one class;
all further work is on classes. A count sketch of bounded size over all documents gives
each shingle a rarity, and each set is ordered rare-first. Two sets of the wanted
similarity share a shingle in their prefixes, so the classes are joined on these; pairs
must pass the length and positional filters, then the suffix filter (a bound from the
sizes of hash ranges), and each remaining pair is verified once, on the whole sets of
both texts.

Where many classes share a prefix shingle, they are first held against a leader only,
in salted runs of bounded size and then leader against leader; components are made of
the links found, and then all pairs of such runs that lie in different components are
tried. So no link between components is lost, and no group makes all its pairs. links()
gives every link between classes instead; there the pairs inside components are tried too.

Components come from alternating large-star and small-star steps, each written to the
shared folder.

Defined results: a null or empty text has no shingle and is a component of its own; a
text with fewer words than a shingle has its whole sequence as one; repeated rows and
equal texts share a component; the component's id is the smallest id in it, null only if
all its ids are null; empty tables give empty results; further columns are ignored
unless kept. Shingles are told apart by 64-bit hashes, classes by 128-bit ones.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievekit.llm.common import materialize, mix, output, slices, small_batches, stretches, Words

SHINGLE, PERCENT = 4, 85
#: Slots of the count sketch, and blocks that it is summed in.
SKETCH_BITS, BLOCK_BITS = 22, 4
#: Tasks whose sketches are summed at first; those sums are summed then.
SUMMED = 64
#: Steps of rarity for each doubling of a count.
STEPS = 4
#: Runs up to this size make all their pairs at once; longer ones are held against a leader.
SMALL_RUN = 16
#: Expected size of a salted run.
RUN = 256
#: Hash ranges of the suffix filter.
RANGES = 64
#: Most classes whose 16-byte keys are broadcast to pick their texts; beyond, a join does.
MAX_BROADCAST = 1_000_000


def text_sets(texts: list[bytes], size: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    w = Words(texts, lower=True)
    counts = np.diff(w.first)
    keys, at = w.shingles(size)
    of = w.text_of_word()
    cuts = np.searchsorted(of[at], np.arange(len(texts) + 1))
    out = [np.unique(keys[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
    for k in range(1, size):
        short = np.flatnonzero(counts == k)
        if len(short):
            keys, at = w.shingles(k)
            of_key = of[at]
            for t in short.tolist():
                out[t] = keys[np.searchsorted(of_key, t)][None]
    return out


def signature(s: np.ndarray) -> bytes:
    """128 bits that stand for a set."""
    a = np.uint64(len(s))
    one = mix(s + np.uint64(0x51ED270B)).sum(dtype=np.uint64) + a
    two = mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64) ^ a
    return one.astype(">u8").tobytes() + two.astype(">u8").tobytes()


def _ranges(s: np.ndarray) -> bytes:
    """Sizes of the set's hash ranges: the low bits deal them."""
    return np.bincount((s & np.uint64(RANGES - 1)).astype(np.int64), minlength=RANGES).clip(0, 65535).astype("<u2").tobytes()


def _slot(s: np.ndarray) -> np.ndarray:
    return (s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def _binary(rows: np.ndarray) -> pa.Array:
    """A binary column from rows of 16 bytes."""
    data = np.ascontiguousarray(rows)
    n = len(data)
    offsets = (np.arange(n + 1) * 16).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def _rows16(column: pa.Array) -> np.ndarray:
    """The inverse of _binary: one void of 16 bytes a row."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype="V16")


def _first_pass(rows: DataFrame, size: int) -> DataFrame:
    """Rows of documents (block null) with sig, n, ranges, and of the sketch (block, blob)."""
    kept = [f for f in rows.schema if f.name != "_text"]
    fields = ", ".join(
        [*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "_sig binary, _n int, _ranges binary, _block int, _blob binary"]
    )
    n_kept, width = len(kept), 1 << (SKETCH_BITS - BLOCK_BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(1 << SKETCH_BITS, dtype=np.uint32)
        schema = None
        for part, texts in slices(batches, "_text", 1 << 20):
            sets = text_sets(texts, size)
            every = np.concatenate(sets)
            sketch += np.bincount(_slot(every), minlength=len(sketch)).astype(np.uint32) if len(every) > 1 << 18 else 0
            if len(every) <= 1 << 18:
                np.add.at(sketch, _slot(every), np.uint32(1))
            schema = pa.schema(
                [*list(part.schema)[:n_kept], ("_sig", pa.binary()), ("_n", pa.int32()), ("_ranges", pa.binary()),
                 ("_block", pa.int32()), ("_blob", pa.binary())]
            )
            own = dict(zip(part.schema.names[:n_kept], part.columns[:n_kept], strict=True))
            nothing = pa.nulls(len(sets))
            yield output(
                schema, **own, _sig=[signature(s) for s in sets], _n=[len(s) for s in sets],
                _ranges=[_ranges(s) for s in sets], _block=nothing.cast(pa.int32()), _blob=nothing.cast(pa.binary()),
            )
        if schema is not None:
            full = [k for k in range(1 << BLOCK_BITS) if sketch[k * width : (k + 1) * width].any()]
            blobs = [zlib.compress(sketch[k * width : (k + 1) * width].tobytes(), 1) for k in full]
            empty = {f.name: pa.nulls(len(full), f.type) for f in schema}
            yield output(schema, **(empty | {"_block": pa.array(full, pa.int32()), "_blob": pa.array(blobs, pa.binary())}))

    return rows.mapInArrow(run, fields)


def _rarity(first: DataFrame) -> np.ndarray:
    """Rarity of each slot of the sketch: STEPS times the logarithm of its count; a few MB."""
    width = 1 << (SKETCH_BITS - BLOCK_BITS)

    def added(batches: Iterator[pa.RecordBatch], kind: type) -> dict[int, np.ndarray]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                part = np.frombuffer(zlib.decompress(blob), dtype=kind)
                if block not in total:
                    total[block] = np.zeros(width, dtype=np.uint64)
                total[block] += part
        return total

    def batch_of(blobs: dict[int, bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(list(blobs), pa.int32()), pa.array(list(blobs.values()), pa.binary())], names=["block", "blob"]
        )

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield batch_of({k: zlib.compress(v.tobytes(), 1) for k, v in added(batches, np.uint32).items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = added(batches, np.uint64)
        yield batch_of({k: np.floor(STEPS * np.log2(np.maximum(v, 1))).astype(np.uint8).tobytes() for k, v in total.items()})

    # Two steps, so that no task reads what all tasks of the first pass wrote for a block.
    salt = F.floor(F.spark_partition_id() / F.lit(SUMMED)).alias("_salt")
    parts = first.where(F.col("_block").isNotNull()).select("_block", "_blob", salt)
    parts = parts.repartition("_block", "_salt").mapInArrow(some, "block int, blob binary")
    out = np.zeros(1 << SKETCH_BITS, dtype=np.uint8)
    for row in parts.repartition(1 << BLOCK_BITS, "block").mapInArrow(run, "block int, blob binary").collect():
        out[row["block"] * width : (row["block"] + 1) * width] = np.frombuffer(bytes(row["blob"]), dtype=np.uint8)
    return out


def _salts(rarity: np.ndarray, run_size: int) -> np.ndarray:
    """In how many runs the classes of a shingle with that rarity are dealt."""
    return np.maximum(1, np.exp2(rarity / STEPS) // run_size).astype(np.int64)


def prefix_length(n: int | np.ndarray, percent: int = PERCENT) -> int | np.ndarray:
    """Shingles of a set of n of which one at least is shared by any similar set."""
    return n + (-percent * n // 100) + 1


def _prefixes(rows: DataFrame, rarity: np.ndarray, size: int, percent: int, run_size: int) -> DataFrame:
    """tok, salt, sig, n, pos: the prefixes of each task's distinct sets.

    salt is 0 where a shingle's classes make one run, else 1 and more.
    """
    sent = rows.sparkSession.sparkContext.broadcast(rarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rare = sent.value
        seen: set[bytes] = set()
        for _, texts in slices(batches, "_text", 1 << 20):
            toks, sigs, ns, poss, salts = [], [], [], [], []
            for s in text_sets(texts, size):
                n = len(s)
                if n == 0 or (sig := signature(s)) in seen:
                    continue
                seen.add(sig)
                r = rare[_slot(s)]
                p = prefix_length(n, percent)
                best = np.argsort(r, kind="stable")[:p]  # s is sorted: ties go by hash
                toks.append(s[best])
                sigs.append(np.full(p, np.frombuffer(sig, dtype="V16")[0], dtype="V16"))
                ns.append(np.full(p, n, dtype=np.int32))
                poss.append(np.arange(1, p + 1, dtype=np.int32))
                many = _salts(r[best], run_size)
                salts.append(np.where(many > 1, 1 + int.from_bytes(sig[:7], "big") % many, 0).astype(np.int32))
            if toks:
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate(toks).view(np.int64)), pa.array(np.concatenate(salts)),
                        _binary(np.concatenate(sigs)), pa.array(np.concatenate(ns)), pa.array(np.concatenate(poss)),
                    ],
                    names=["tok", "salt", "sig", "n", "pos"],
                )

    return rows.select("_text").mapInArrow(run, "tok bigint, salt int, sig binary, n int, pos int")


def _need(n1: np.ndarray, n2: np.ndarray, percent: int) -> np.ndarray:
    """The least intersection of similar sets of n1 and n2 shingles."""
    return -(-percent * (n1.astype(np.int64) + n2) // (100 + percent))


def _passes(n1: np.ndarray, p1: np.ndarray, n2: np.ndarray, p2: np.ndarray, percent: int) -> np.ndarray:
    """Length filter, and positional filter for the first shared shingle."""
    return (100 * np.minimum(n1, n2).astype(np.int64) >= percent * np.maximum(n1, n2).astype(np.int64)) & (
        1 + np.minimum(n1 - p1, n2 - p2) >= _need(n1, n2, percent)
    )


_PAIR, _PENDING, _LEADER = 0, 1, 2
_RUN_SCHEMA = pa.schema(
    [("kind", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("tok", pa.int64()), ("salt", pa.int32()),
     ("n", pa.int32()), ("pos", pa.int32())]
)


def _run_batch(kind: int, size: int, **columns) -> pa.RecordBatch:
    """Rows of one kind; what is not given is null."""
    found = {"kind": pa.array(np.full(size, kind, dtype=np.int32))}
    for field in _RUN_SCHEMA:
        if field.name != "kind":
            c = columns.get(field.name)
            if c is None:
                found[field.name] = pa.nulls(size, field.type)
            else:
                found[field.name] = _binary(c) if field.type == pa.binary() else pa.array(c, type=field.type)
    return output(_RUN_SCHEMA, **found)


def _work_runs(tok, salt, sig, n, pos, percent: int, sizes: tuple[int, int], first_level: bool) -> Iterator[pa.RecordBatch]:
    """What whole runs give; rows are sorted by tok, salt, n, sig."""
    small_run, run_size = sizes
    fresh = np.ones(len(tok), dtype=bool)
    fresh[1:] = (tok[1:] != tok[:-1]) | (salt[1:] != salt[:-1]) | (sig[1:] != sig[:-1])
    tok, salt, sig, n, pos = (x[fresh] for x in (tok, salt, sig, n, pos))
    edge = np.flatnonzero(np.concatenate([[True], (tok[1:] != tok[:-1]) | (salt[1:] != salt[:-1]), [True]]))
    size = np.diff(edge)
    two = edge[:-1][size == 2]
    left, right, pending, leaders = [two], [two + 1], [], []
    for k in np.flatnonzero((size > 2) | (salt[edge[:-1]] > 0)).tolist():
        a, b = int(edge[k]), int(edge[k + 1])
        small, salted = b - a <= small_run, salt[a] > 0
        if small and b - a > 2:
            i, j = np.triu_indices(b - a, 1)
            left.append(a + i)
            right.append(a + j)
        if not small or salted:
            pending.append(np.arange(a, b))
        rest = np.arange(a, b) if not small or salted else np.zeros(0, dtype=np.int64)
        # The class with fewest rarer shingles leads: of variants of a text, the one with least of its own.
        rest = rest[np.lexsort((n[rest], pos[rest]))]
        while len(rest):
            lead, others = rest[0], rest[1:]
            near = 100 * np.minimum(n[others], n[lead]).astype(np.int64) >= percent * np.maximum(n[others], n[lead]).astype(np.int64)
            if not small:
                left.append(np.full(near.sum(), lead))
                right.append(others[near])
            if salted:
                leaders.append(lead)
            rest = others[~near]
    i, j = np.concatenate(left), np.concatenate(right)
    ok = _passes(n[i], pos[i], n[j], pos[j], percent)
    i, j = i[ok], j[ok]
    if len(i):
        yield _run_batch(_PAIR, len(i), a=sig[i], b=sig[j])
    if pending and first_level:
        at = np.concatenate(pending)
        yield _run_batch(_PENDING, len(at), a=sig[at], tok=tok[at], n=n[at], pos=pos[at])
    if leaders:
        at = np.array(leaders)
        yield _run_batch(_LEADER, len(at), a=sig[at], tok=tok[at], salt=(salt[at] - 1) // run_size, n=n[at], pos=pos[at])


def _runs(prefixes: DataFrame, percent: int, sizes: tuple[int, int], first_level: bool = True) -> DataFrame:
    """Candidate pairs, rows of long or salted runs for later, and the leaders of salted runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            if b.num_rows == 0:
                continue
            now = [_rows16(c) if k == 2 else c.to_numpy(zero_copy_only=False) for k, c in enumerate(b.columns)]
            if held is not None:
                now = [np.concatenate(x) for x in zip(held, now, strict=True)]
            # The last run may go on in the next batch.
            cut = int(np.argmax((now[0] == now[0][-1]) & (now[1] == now[1][-1])))
            held = [x[cut:] for x in now]
            if cut:
                yield from _work_runs(*(x[:cut] for x in now), percent, sizes, first_level)
        if held is not None:
            yield from _work_runs(*held, percent, sizes, first_level)

    dealt = (
        prefixes.select("tok", "salt", "sig", "n", "pos")
        .repartition("tok", "salt").sortWithinPartitions("tok", "salt", "n", "sig")
    )
    return dealt.mapInArrow(run, "kind int, a binary, b binary, tok bigint, salt int, n int, pos int")


def _suffix_filtered(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs whose sets can be similar by the sizes of their hash ranges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows == 0:
                continue
            n1, n2 = (b.column(k).to_numpy(zero_copy_only=False) for k in (2, 3))
            one, two = (
                np.frombuffer(b"".join(b.column(k).to_pylist()), dtype="<u2").reshape(-1, RANGES) for k in (4, 5)
            )
            # A full range counts as unbounded.
            most = np.minimum(np.where(one == 65535, 1 << 30, one.astype(np.int64)), np.where(two == 65535, 1 << 30, two.astype(np.int64)))
            keep = pa.array(most.sum(axis=1) >= _need(n1, n2, percent))
            yield b.select([0, 1]).filter(keep)

    side = classes.select("sig", "n", "ranges")
    one = side.select(F.col("sig").alias("a"), F.col("n").alias("n1"), F.col("ranges").alias("r1"))
    two = side.select(F.col("sig").alias("b"), F.col("n").alias("n2"), F.col("ranges").alias("r2"))
    return (
        pairs.join(one, "a").join(two, "b").select("a", "b", "n1", "n2", "r1", "r2").mapInArrow(run, "a binary, b binary")
    )


#: Bytes of unpacked texts that are compared at once.
VERIFIED_BYTES = 2 << 20


def _blobs(rows: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """sig, the compressed text and its length of the wanted classes, one text a class and task."""
    small = wanted.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST
    spark = rows.sparkSession
    picked = None
    if small:
        keys = wanted.toArrow().column(0).combine_chunks()
        picked = spark.sparkContext.broadcast(np.sort(_rows16(keys).view("S16")) if len(keys) else np.zeros(0, "S16"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chosen = set(picked.value.tolist()) if picked is not None else None
        seen: set[bytes] = set()
        for _, texts in slices(batches, "_text", 1 << 20):
            sigs, blobs, sizes = [], [], []
            for text, s in zip(texts, text_sets(texts, size), strict=True):
                sig = signature(s)
                if len(s) and sig not in seen and (chosen is None or sig.rstrip(b"\0") in chosen):
                    seen.add(sig)
                    sigs.append(sig)
                    blobs.append(zlib.compress(text, 1))
                    sizes.append(len(text))
            yield pa.RecordBatch.from_arrays(
                [pa.array(sigs, pa.binary()), pa.array(blobs, pa.binary()), pa.array(sizes, pa.int64())], names=["sig", "blob", "bytes"]
            )

    found = rows.select("_text").mapInArrow(run, "sig binary, blob binary, bytes bigint")
    return found if small else found.join(wanted, "sig", "left_semi")


def _verified(pairs: DataFrame, blobs: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs that are similar: texts of VERIFIED_BYTES are unpacked at once, or one pair of longer ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            sizes = b.column(4).to_numpy() + b.column(5).to_numpy()
            for at, upto in stretches(sizes, VERIFIED_BYTES):
                part = b.slice(at, upto - at)
                texts = [zlib.decompress(x) for k in (2, 3) for x in part.column(k).to_pylist()]
                sets = text_sets(texts, size)
                for one, two in zip(sets[: part.num_rows], sets[part.num_rows :], strict=True):
                    both = len(np.intersect1d(one, two, assume_unique=True))
                    keep.append((100 + percent) * both >= percent * (len(one) + len(two)))
            yield b.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    one = blobs.select(F.col("sig").alias("a"), F.col("blob").alias("x"), F.col("bytes").alias("n1"))
    two = blobs.select(F.col("sig").alias("b"), F.col("blob").alias("y"), F.col("bytes").alias("n2"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y", "n1", "n2").mapInArrow(run, "a binary, b binary")


def _links(pairs: DataFrame, blobs: DataFrame, classes: DataFrame, size: int, percent: int) -> DataFrame:
    """Verify candidate pairs; written to the shared folder."""
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    pairs = materialize(_suffix_filtered(pairs, classes, percent), "pairs")
    return materialize(_verified(pairs, blobs, size, percent), "links")


def components(links: DataFrame) -> DataFrame:
    """sig, comp: the least member of the component of each end of a link (columns a, b).

    Alternating large-star and small-star steps until nothing changes.
    """
    edges = materialize(
        links.select(F.least("a", "b").alias("v"), F.greatest("a", "b").alias("u")).where("u <> v").distinct(), "edges"
    )

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))"), F.expr("sum(xxhash64(v, u) % 1000003)")).first())

    now = state(edges)
    while now[0]:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(low.select("u", F.col("m").alias("v"))).where("u <> v")
            .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        )
        edges = materialize(small, "edges")
        after = state(edges)
        if after == now:
            break
        now = after
    found = edges.groupBy("u").agg(F.min("v").alias("comp"))
    return found.select(F.col("u").alias("sig"), "comp").union(
        found.select(F.col("comp").alias("sig"), "comp").distinct()
    )


def _linked(
    rows: DataFrame, id_col: str, size: int, percent: int, sizes: tuple[int, int], inside: bool
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Members, classes, the classes' components, and links (columns a, b).

    inside: all links, also those between classes whose component is known without them.
    """
    first = materialize(_first_pass(rows, size), "first")
    members = first.where(F.col("_block").isNull())
    rarity = _rarity(first)
    classes = materialize(
        members.where("_n > 0").groupBy(F.col("_sig").alias("sig")).agg(
            F.min(id_col).alias("least_id"), F.count("*").alias("copies"),
            F.min("_n").alias("n"), F.min("_ranges").alias("ranges"),
        ), "classes",
    )
    level = materialize(_runs(_prefixes(rows, rarity, size, percent, sizes[1]), percent, sizes), "runs")
    found = [level]
    salts = int(_salts(rarity.max(), sizes[1]))
    while salts > 1:
        leaders = found[-1].where(F.col("kind") == _LEADER).select("tok", "salt", F.col("a").alias("sig"), "n", "pos")
        found.append(materialize(_runs(leaders, percent, sizes, first_level=False), "runs"))
        salts //= sizes[1]
    every = reduce(DataFrame.unionByName, found).select("kind", "a", "b")
    pairs = every.where(F.col("kind") == _PAIR).select("a", "b")
    tried = every.where(F.col("kind") != _LEADER).select(F.explode(F.array("a", "b")).alias("sig"))
    wanted = materialize(tried.where("sig IS NOT NULL").distinct(), "wanted")
    # Each task sends a class's text once; written before the joins, so that these can split a leader's pairs.
    blobs = materialize(_blobs(rows, wanted, size).dropDuplicates(["sig"]), "blobs")
    links = _links(pairs, blobs, classes, size, percent)
    comps = materialize(components(links), "components")
    # Long runs: all pairs of different components, or all pairs at all.
    own = comps.withColumnRenamed("sig", "a")
    pending = (
        level.where(F.col("kind") == _PENDING).select("a", "tok", "n", "pos").join(own, "a", "left")
        .withColumn("comp", F.coalesce("comp", "a"))
    )
    if not inside:
        mixed = pending.groupBy("tok").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("tok")
        pending = pending.join(mixed, "tok", "left_semi")
    pending = materialize(pending, "pending")
    other = pending.select("tok", *(F.col(c).alias(f"{c}2") for c in ("a", "n", "pos", "comp")))
    need = F.ceil(F.lit(percent) * (F.col("n").cast("bigint") + F.col("n2")) / F.lit(100 + percent))
    across = pending.join(
        other,
        (pending["tok"] == other["tok"]) & (F.lit(inside) | (F.col("comp") != F.col("comp2")))
        & ((F.col("n") < F.col("n2")) | ((F.col("n") == F.col("n2")) & (F.col("a") < F.col("a2"))))
        & (F.col("n") * F.lit(100) >= F.col("n2") * F.lit(percent))
        & (F.least(F.col("n") - F.col("pos"), F.col("n2") - F.col("pos2")) + 1 >= need),
    ).select("a", F.col("a2").alias("b"))
    across = materialize(across.distinct(), "across")
    if not across.isEmpty():
        links = links.union(_links(across, blobs, classes, size, percent)).distinct()
        comps = materialize(components(links), "components")
    return members, classes, comps, links


def link(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = SHINGLE,
    percent: int = PERCENT,
    keep: list[str] | None = None,
    sizes: tuple[int, int] = (SMALL_RUN, RUN),
) -> DataFrame:
    """id_col and keep's columns of docs, with n_shingles and component_id.

    sizes: of runs that make all their pairs, and of salted runs; they don't change the result.
    """
    small_batches(docs.sparkSession)
    columns = list(dict.fromkeys([id_col, *(keep or [])]))
    rows = docs.select(*columns, F.col(text_col).alias("_text"))
    members, classes, comps, _ = _linked(rows, id_col, size, percent, sizes, inside=False)
    # Only classes of several rows or with a link can have another id than their own.
    joined = classes.join(comps, "sig", "left").withColumn("comp", F.coalesce("comp", "sig"))
    ids = joined.groupBy("comp").agg(F.min("least_id").alias("component_id"), F.sum("copies").alias("rows")).where("rows > 1")
    shared = joined.join(ids, "comp").select(F.col("sig").alias("_sig"), "component_id")
    return (
        members.join(shared, "_sig", "left")
        .select(*columns, F.col("_n").cast("bigint").alias("n_shingles"), F.coalesce("component_id", F.col(id_col)).alias("component_id"))
    )


def links(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = SHINGLE,
    percent: int = PERCENT,
    sizes: tuple[int, int] = (SMALL_RUN, RUN),
) -> tuple[DataFrame, DataFrame]:
    """Every link between different sets, and the membership that belongs to it.

    The first table has id1 and id2, the least ids of two linked classes, and their copies;
    the second id_col and class_id (that least id; the row's own id without any shingle).
    The number of links of variants of one text is their square: that is the output's size.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(id_col, F.col(text_col).alias("_text"))
    members, classes, _, found = _linked(rows, id_col, size, percent, sizes, inside=True)
    sides = [classes.select(F.col("sig").alias(c), F.col("least_id").alias(f"id{k}"), F.col("copies").alias(f"copies{k}")) for k, c in ((1, "a"), (2, "b"))]
    pairs = found.join(sides[0], "a").join(sides[1], "b").select("id1", "id2", "copies1", "copies2")
    own = classes.where("copies > 1").select(F.col("sig").alias("_sig"), F.col("least_id"))
    return pairs, members.join(own, "_sig", "left").select(id_col, F.coalesce("least_id", F.col(id_col)).alias("class_id"))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The component of every document."""
    return link(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op3_ngram_jaccard_join": op3_ngram_jaccard_join}
ORACLE: dict[str, str] = {}
