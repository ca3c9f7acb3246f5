"""Packing: exact round trip against the tokenizer itself."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sievekit.llm import common
from sievekit.llm.packing import Encoder, default_tokenizer, encoder_of, op5_packing, pack, pieces_of

CASES = [
    None, "", " ", "\n", "a  b", "\n\nfoo bar \n baz", "x <|endoftext|> y", "it 's  fine", "don't  ", " lead",
    "tab\there", "nb sp a", "é à b. c,d é, é. ×. »,", "<| endoftext|>", "a\x1cb c", "1 2.3, 4 \n5", "...,", "a .b",
    "((a, b). c\nd.\ne", "中文 字, 。 x", "a b c", "one\0two three", "naïve\ncafé.\nçà", "x" * 30_000, "ab " * 20_000,
]


@pytest.fixture(scope="module")
def encoder():
    return Encoder(default_tokenizer())


def same(encoder, texts):
    got = encoder.encode([t.encode() for t in texts])
    for text, ids in zip(texts, got, strict=True):
        assert ids.tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids, text


def test_encoder_equals_tokenizer(encoder):
    same(encoder, [c or "" for c in CASES])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.sampled_from(list("ab é,. \n\t'9中 <|>")), max_size=30), max_size=6))
def test_encoder_on_drawn_texts(encoder, texts):
    same(encoder, texts)


def test_pieces():
    assert pieces_of(1) == [1] and pieces_of(2048) == [2048] and pieces_of(5000) == [2048, 2048, 512, 256, 128, 8]
    with pytest.raises(ValueError):
        pieces_of(5, 3)


def test_round_trip(spark, encoder):
    rows = [(k, t, "clash") for k, t in enumerate(CASES)] + [(0, None, "clash"), (3, "\n", "clash")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, length string").repartition(3)
    out = pack(docs, default_tokenizer(), with_ids=True).toPandas()
    assert out.sequence_id.is_unique and (out.offset == 0).all()
    assert set(out.length) <= {1 << k for k in range(12)}
    for k, text in enumerate(CASES):
        own = out[out.doc_id == k]
        copies = 2 if k in (0, 3) else 1
        want = [*encoder.tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        assert own.length.sum() == copies * len(want) and (own.doc_tokens == len(want)).all()
        for r in own.itertuples():
            piece = np.array(want[r.start : r.start + r.length], dtype="<u4")
            assert list(r.ids) == piece.tolist() and r.ids_crc32 == zlib.crc32(piece.tobytes())
        assert sorted(own.start.tolist()) == sorted(np.cumsum([0, *pieces_of(len(want))[:-1]]).tolist() * copies)


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert op5_packing(spark, str(tmp_path)).count() == 0


def test_encoder_in_groups(encoder, monkeypatch):
    texts = [" ".join(f"w{k * j % 977}" for k in range(300)) for j in range(1, 6)]
    for at_once in (1, 50, 1 << 18):
        monkeypatch.setattr(Encoder, "AT_ONCE", at_once)
        fresh = Encoder(default_tokenizer())
        for text, ids in zip(texts, fresh.encode([t.encode() for t in texts]), strict=True):
            assert ids.tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids


def test_workers_forget_the_encoder_on_other_work():
    """What packing remembers (some 100 MB after 150 MB of text) must not stay beside the next stage's memory."""
    from sievekit.llm.packing import _kind

    path = default_tokenizer()
    rows = pa.RecordBatch.from_pydict({"text": ["a b", None]})
    mine = encoder_of(path)
    assert len(list(common.slices(iter([rows]), "text", kind=_kind(path)))) == 1 and encoder_of(path) is mine
    assert len(list(common.slices(iter([rows]), "text"))) == 1 and not common._remembered
    assert encoder_of(path) is not mine
