"""Packing by power-of-two decomposition.

A document of n tokens is cut into pieces whose lengths are the powers of two in n's
binary form, largest first, with as many pieces of the largest length as fit. Pieces
of equal length share a bucket and each is a sequence of its own: no sequence crosses
documents, and none needs padding.

Defined results: a null or empty text has the end token alone, one piece of length 1;
repeated rows are packed once each; an empty table gives an empty result; further
columns are ignored. Texts of any length are tokenised whole.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievekit.llm.common import remembered, slices, small_batches, span_hash, stretches


#: Tokens of the longest piece.
MAX_LENGTH = 2048
END_TOKEN = 1
TOKENIZER = "byte_bpe_50k.json"

_SAFE = re.compile(r"(?<=\S) (?=\S)")


def pieces_of(n: int, longest: int = MAX_LENGTH) -> list[int]:
    """The lengths into which n tokens are cut.

    >>> pieces_of(11, 4)
    [4, 4, 2, 1]
    """
    if longest & (longest - 1):
        raise ValueError("the longest piece must be a power of two")
    rest = n % longest
    return [longest] * (n // longest) + [
        1 << b for b in range(longest.bit_length() - 1, -1, -1) if rest >> b & 1
    ]


_ALNUM = np.zeros(256, dtype=bool)
_ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
#: Controls that some libraries take for white space, and first bytes of other white space.
_DOUBTFUL = np.zeros(256, dtype=bool)
_DOUBTFUL[[0, 0x09, 0x0B, 0x0C, 0x0D, 0x1C, 0x1D, 0x1E, 0x1F, 0xC2, 0xE1, 0xE2, 0xE3]] = True


def _plain(texts: list[bytes]) -> np.ndarray:
    """Whether each text can be cut at every space, line feed, full stop and comma.

    That holds if its white space is spaces and line feeds, none beside another or at an
    end, and if letters or digits precede full stops and commas.
    """
    data = np.frombuffer(b"\n" + b"\n".join(texts) + b"\n", dtype=np.uint8)
    last, now = data[:-1], data[1:]
    white = (data == 0x20) | (data == 0x0A)
    letter = _ALNUM[last]
    letter[1:] |= (last[:-1] == 0xC3) & (last[1:] != 0x97) & (last[1:] != 0xB7)
    bad = _DOUBTFUL[data]
    bad[1:] |= (white[1:] & white[:-1]) | (((now == 0x2E) | (now == 0x2C)) & ~letter)
    total = np.concatenate([[0], np.cumsum(bad)])
    ends = np.cumsum([len(t) + 1 for t in texts]) + 1
    starts = np.concatenate([[1], ends[:-1]])
    return total[ends] == total[starts]


class Encoder:
    """Token ids of texts, by a public tokenizer.

    A byte-level tokenizer always breaks before a single space between two characters
    that are not white space, and in plain texts at some more places. Texts are cut
    there, and what lies between two cuts is encoded once as long as it is remembered;
    the memory is bounded.
    """

    REMEMBER, RECENT = 1_000_000, 100_000
    #: Characters of new chunks that are encoded at once: an encoding takes many times its text.
    AT_ONCE = 1 << 18

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        #: Bytes of each token: a byte-level vocabulary spells each byte as one character.
        self.bytes = np.zeros(max(vocabulary.values()) + 1, dtype=np.int64)
        for token, number in vocabulary.items():
            self.bytes[number] = len(token)
        self._forget()

    def _forget(self) -> None:
        # Hashes of known chunks in two sorted arrays, old and recent, with their numbers.
        self.size = 0
        self.old = self.recent = (np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int32))
        self.pool = np.zeros(0, dtype=np.uint32)
        self.ends = np.zeros(1, dtype=np.int64)

    def _numbers(self, keys: np.ndarray) -> np.ndarray:
        """The number of each chunk, -1 for new ones."""
        out = np.full(len(keys), -1, dtype=np.int64)
        for known, number in (self.old, self.recent):
            if len(known):
                at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
                hit = known[at] == keys
                out[hit] = number[at[hit]]
        return out

    def _remember(self, keys: np.ndarray) -> None:
        """Number new chunks in the order given."""
        number = np.arange(self.size, self.size + len(keys), dtype=np.int32)
        self.size += len(keys)
        parts = [self.recent, (keys, number)]
        if len(self.recent[0]) > self.RECENT:
            parts.insert(0, self.old)
        keys, number = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(keys)
        joined = (keys[order], number[order])
        if len(parts) == 3:
            self.old, self.recent = joined, (keys[:0], number[:0])
        else:
            self.recent = joined

    def _cuts(self, data: np.ndarray, texts: list[bytes], at: np.ndarray) -> np.ndarray:
        """Where chunks begin, in the joined texts; at: where the texts begin."""
        plain = _plain(texts) & ~np.array([b"<|" in t for t in texts], dtype=bool)
        cut = (data == 0x20) | (data == 0x2E) | (data == 0x2C) | (data == 0x0A)
        cut[1:] |= data[:-1] == 0x0A
        for k in np.flatnonzero(~plain).tolist():
            cut[at[k] : at[k + 1]] = False
            if b"<|" not in texts[k]:  # a special token's text may hold a cut
                parts = _SAFE.split(texts[k].decode())
                cut[at[k] - 1 + np.cumsum([len(p.encode()) + 1 for p in parts[:-1]], dtype=np.int64)] = True
        cut[at[:-1][at[:-1] < at[1:]]] = True
        return np.flatnonzero(cut)

    def _learn(self, new: list[str], keys: np.ndarray) -> None:
        """Encode chunks: those that begin with a space in one text, others one by one."""
        fast = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        joins = [c[:1] == " " and "<|" not in c for c in new]
        after = [c for c, j in zip(new, joins, strict=True) if j]
        alone = [c for c, j in zip(new, joins, strict=True) if not j]
        ids = [np.asarray(e.ids, dtype=np.uint32) for e in fast(alone, add_special_tokens=False)] if alone else []
        sizes = [len(i) for i in ids]
        if after:
            # Each chunk is a text of its own to the tokenizer, wherever the joined ones are divided.
            groups = ("".join(after[a:b]) for a, b in stretches(np.array([len(c) for c in after]), self.AT_ONCE))
            joined = np.concatenate([np.asarray(fast([g], add_special_tokens=False)[0].ids, dtype=np.uint32) for g in groups])
            ends = np.cumsum([len(c.encode()) for c in after])
            upto = np.searchsorted(np.cumsum(self.bytes[joined]), ends) + 1
            ids.append(joined)
            sizes += np.diff(upto, prepend=0).tolist()
        self._remember(keys[np.argsort(joins, kind="stable")])
        self.pool = np.concatenate([self.pool, *ids])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(sizes, dtype=np.int64)])

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """The ids of each text, without the end token. Chunks are told apart by 64-bit hashes."""
        if self.size > self.REMEMBER:
            self._forget()
        joined = b"".join(texts)
        if not joined:
            return [np.zeros(0, dtype=np.uint32) for _ in texts]
        data = np.frombuffer(joined, dtype=np.uint8)
        at = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        start = self._cuts(data, texts, at)
        end = np.append(start[1:], len(data))
        place, found = pd.factorize(span_hash(data, start, end))
        some = np.empty(len(found), dtype=np.int64)
        some[place] = np.arange(len(start))  # any chunk of each kind
        number = self._numbers(found)
        new = np.flatnonzero(number < 0)
        if len(new):
            spans = zip(start[some[new]].tolist(), end[some[new]].tolist(), strict=True)
            self._learn([joined[a:b].decode() for a, b in spans], found[new])
            number[new] = self._numbers(found[new])
        number = number[place]
        sizes = self.ends[number + 1] - self.ends[number]
        upto = np.concatenate([[0], np.cumsum(sizes)])
        ids = self.pool[np.arange(upto[-1]) + np.repeat(self.ends[number] - upto[:-1], sizes)]
        return np.split(ids, upto[np.searchsorted(start, at[1:-1])])


def encoder_of(path: str) -> Encoder:
    """This process's encoder for a tokenizer; a reused worker keeps what it remembers until it does other work."""
    return remembered(_kind(path), lambda: Encoder(path))


def _kind(path: str) -> str:
    return f"encoder {path}"


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    longest: int = MAX_LENGTH,
    end_token: int = END_TOKEN,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """Cut each document into pieces of binary length; a row a piece.

    Columns: doc_id, start, length (also the bucket's name), ids_crc32, doc_tokens,
    sequence_id (unique), offset (always 0: a piece fills its sequence) and, with
    with_ids, the ids. No shuffle: each task packs the documents that it reads.
    """
    small_batches(docs.sparkSession)
    id_type = docs.schema[id_col].dataType.simpleString()
    extra = ", ids array<int>" if with_ids else ""
    fields = f"doc_id {id_type}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint{extra}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder = encoder_of(tokenizer_path)
        for part, texts in slices(batches, "text", 2 << 20, kind=_kind(tokenizer_path)):
            yield _rows(encoder, part.column(0), texts)

    def _rows(encoder: Encoder, keys: pa.Array, texts: list[bytes]) -> pa.RecordBatch:
        of, start, length, crc, total, ids = [], [], [], [], [], []
        for k, found in enumerate(encoder.encode(texts)):
            found = np.append(found, np.uint32(end_token)).astype("<u4")
            at = 0
            for n in pieces_of(len(found), longest):
                piece = found[at : at + n]
                of.append(k)
                start.append(at)
                length.append(n)
                crc.append(zlib.crc32(piece.tobytes()))
                total.append(len(found))
                if with_ids:
                    ids.append(piece.astype(np.int32))
                at += n
        columns = [keys.take(pa.array(of, type=pa.int64())), *(pa.array(c, type=pa.int64()) for c in (start, length, crc, total))]
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
        if with_ids:
            columns.append(pa.array(ids, type=pa.list_(pa.int32())))
            names.append("ids")
        return pa.RecordBatch.from_arrays(columns, names=names)

    cut = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, fields)
    return cut.withColumn("sequence_id", F.monotonically_increasing_id()).withColumn(
        "offset", F.lit(0).cast("bigint")
    )


def default_tokenizer() -> str:
    """Where the public tokenizer's file is on this machine."""
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, packed."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack(docs, default_tokenizer())


QUERIES = {"op5_packing": op5_packing}
ORACLE: dict[str, str] = {}
