"""Piece ids and decoded texts against the library, by whole texts and over odd characters."""

from __future__ import annotations

import hashlib
import random

import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from waterlens.llm import piece_encoding

PATH = public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, ids string, decoded long"
ODD = [
    None, "", " ", "   ", "▁", "a▁b", " ▁ x", "\x00", "é😀\n\t\r", "<s> </s> <unk> <0x0A> <0x", "ⁿ½" * 30, "x" * 5000, "  leading", "trail  ",
    " " * 100 + "x", "日本語テキスト", "ab" * 3000 + " " * 50, "​", "\U0010ffff", "lorem ipsum, dolor! " * 20_000,
]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def model():
    return piece_encoding.PieceModel(PATH)


def expected(library, text):
    ids = library.encode(text or "", add_eos=True)
    return ids, library.decode(ids)


def test_rows_equal_the_library(spark, library):
    docs = spark.createDataFrame([(None if k == 3 else k // 2, t, "x", 1) for k, t in enumerate(ODD)], SCHEMA)
    docs = docs.unionByName(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text"), allowMissingColumns=True)
    rows = [(r["doc_id"], *expected(library, r["text"])) for r in docs.collect()]
    order = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(((r["doc_id"], r["ids"], r["decoded"]) for r in piece_encoding.encode(docs).collect()), key=order) == sorted(rows, key=order)
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
    digests = [(d, len(ids), sha(" ".join(map(str, ids))), sha(text)) for d, ids, text in rows]
    assert sorted(map(tuple, piece_encoding.report(docs).collect()), key=repr) == sorted(digests, key=repr)
    assert piece_encoding.encode(docs.limit(0)).collect() == []


@settings(max_examples=300, deadline=None)
@given(text=st.text(alphabet=st.one_of(st.sampled_from(" ▁abet.\n"), st.characters(exclude_categories=["Cs"])), max_size=80))
def test_any_text_equals_the_library(model, library, text):
    ids, decoded = next(model.batches(pa.array([text])))[1:]
    assert ([*ids[0].tolist(), 2], decoded[0].decode()) == expected(library, text)


def test_the_agenda_alone_equals_the_library(model, library):
    """Whole normalised texts, not cut into units, so cuts cannot hide a merge."""
    rng = random.Random(3)
    for _ in range(300):
        text = "".join(rng.choices(" etaoinshr.,\n▁éö", k=rng.randint(1, 120)))
        assert model.agenda(library.normalize(text)) == library.encode(text)


def test_slices_and_a_small_cache(monkeypatch, library):
    monkeypatch.setattr(piece_encoding, "SLICE_BYTES", 64)
    small = piece_encoding.PieceModel(PATH, cache_bytes=2000)
    texts = [t for t in ODD if t is None or len(t) < 1000] * 3
    found = [(i.tolist(), d.decode()) for _, ids, decoded in small.batches(pa.array(texts)) for i, d in zip(ids, decoded, strict=True)]
    assert [([*i, 2], d) for i, d in found] == [expected(library, t) for t in texts]


def test_a_wrong_rank_is_an_error(model):
    broken = piece_encoding.PieceModel(PATH)
    broken.rank = {p: -r for p, r in broken.rank.items()}
    with pytest.raises(RuntimeError, match="not the library's"):
        list(broken.batches(pa.array(["the weather of the whole country"])))
