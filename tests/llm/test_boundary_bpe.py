"""Forced boundaries held against the unmodified tokenizers library."""

import hashlib

import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from pathloom.llm import boundary_bpe
from tests.llm.helpers import NASTY, docs

PATH = P.path("word_bpe_49k.json")
TRICKY = [
    "a<|endoftext|>b <|startoftext|><|endoftext|>", "<|endoftext |> <|END|> x<|startoftext|", "İstanbul ΣΑΣ ς ǅ ﬁ ß", "é e ́ ́", "가각 가", "Ünïcode x\u0085y\xa0z\x1cw",
    "it's IT'S 'tis 're'll'd ''s", "</w> a</w>b </w></w>", "12345 ½ ⅷ ٣ x1y2", "\x00\x01﻿", "zqxjkv" * 300, "a" * 20000, "!?" * 5000, "日本語テキスト" * 50, "🏳️‍🌈👩‍👩‍👧 x", "\r\n\t\v\f", "ẞ K Å", "ą́ ̈́",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_encode_and_decode_equal_the_library(library):
    own = boundary_bpe.codec(PATH)
    for text in [t for _, t in NASTY if t] + TRICKY:
        ids = library.encode(text, add_special_tokens=False).ids
        assert own.encode(text) == ids, text[:60]
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(max_size=40), st.text(alphabet="aehinrstABéß'<>|/w! \n1", max_size=60), st.lists(st.sampled_from(["<|endoftext|>", "the", "’", "ing", " ", "'s", "½", "Ａ", "ﬀ"]), max_size=12).map("".join)))
def test_any_text_equals_the_library(library, text):
    assert boundary_bpe.codec(PATH).encode(text) == library.encode(text, add_special_tokens=False).ids


def test_cuts_are_certain():
    """Fragments together give what a merge without any cut gives, and some words are cut."""
    own = boundary_bpe.codec(PATH)
    cuts = 0
    for word in ["qzxjqv", "straßenbahnhaltestelle", "xyzzyqqwj", "ãĥĨãĤŃãĤ¹ãĥĪ", "....,,;;", "æĹ¥æľ¬", "jqkzv"]:
        parts = own.fragments_of(word)
        cuts += len(parts) - 1
        assert [i for p in parts for i in own.merge(p)] == own.merge(word + "\n")
    assert cuts > 5


def test_digests(spark, library):
    rows = NASTY + [(100 + k, t) for k, t in enumerate(TRICKY)]
    frame = boundary_bpe.round_trip_digests(docs(spark, rows), PATH)
    assert frame.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    got = {r.doc_id: r for r in frame.collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want = (len(ids), " ".join(map(str, ids)), library.decode(ids, skip_special_tokens=False))
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (want[0], *(hashlib.sha256(x.encode()).hexdigest() for x in want[1:]))
    assert boundary_bpe.round_trip_digests(docs(spark, []), PATH).count() == 0


def test_ids_and_texts_of_documents(spark, library):
    encoded = boundary_bpe.encode_documents(docs(spark), PATH)
    ids = {i: library.encode(t or "", add_special_tokens=False).ids for i, t in NASTY}
    assert {r.doc_id: r.ids for r in encoded.collect()} == ids
    assert {r.doc_id: r.text for r in boundary_bpe.decode_documents(encoded, PATH).collect()} == {i: library.decode(x, skip_special_tokens=False) for i, x in ids.items()}


def test_whole_table(spark, library):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: r.ids for r in boundary_bpe.encode_documents(rows, PATH).collect()}
    assert got == {r.doc_id: library.encode(r.text or "", add_special_tokens=False).ids for r in rows.collect()}


def test_another_kind_of_file_is_refused():
    with pytest.raises(ValueError):
        boundary_bpe.BoundaryCodec(P.path("byte_bpe_50k.json"))
