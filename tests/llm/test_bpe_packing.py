import base64
import hashlib
import struct
import zlib

import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from pathloom.llm import bpe, packing
from tests.llm.helpers import NASTY, docs

PATH = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_merge_equals_library(library):
    own = bpe.codec(PATH, P.PATTERN)
    for text in [t for _, t in NASTY if t] + ["abcabcabcd" * 400, "été" * 700, "Donaudampfschifffahrtsgesellschaft" * 30, "'s's 's", "\r\n \t  x", "a \n b", "１２³ ½ ⅷ", "مرحبا بالعالم"]:
        assert own.encode(text) == library.encode_ordinary(text), text[:50]
        written, back = own.written(text)
        assert written.decode() == ",".join(map(str, library.encode_ordinary(text)))
        assert back == text.encode()


def test_digests(spark, library):
    got = {r.doc_id: r for r in bpe.round_trip_digests(docs(spark), PATH, P.PATTERN).collect()}
    assert len(got) == len(NASTY)
    for i, t in NASTY:
        ids = library.encode_ordinary(t or "")
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe.round_trip_digests(docs(spark, []), PATH, P.PATTERN).count() == 0


def test_encode_then_decode(spark):
    back = {r.doc_id: r.text for r in bpe.decode_documents(bpe.encode_documents(docs(spark), PATH, P.PATTERN), PATH, P.PATTERN).collect()}
    assert back == {i: t or "" for i, t in NASTY}


def check_pieces(rows, expected):
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(expected)
    for doc, pieces in by_doc.items():
        ids, at = expected[doc], 0
        for r in sorted(pieces, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            part = ids[at : at + r.length]
            assert r.ids_crc32 == zlib.crc32(struct.pack(f"<{len(part)}I", *part))
            if "ids" in r:
                assert list(r.ids) == part
            at += r.length
        assert at == len(ids)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048 and at & (at - 1) == 0 and at == pieces[0].tier


@pytest.mark.parametrize("parts,chunk", [(1, 1_000_000), (3, 700)])
def test_packing(spark, parts, chunk):
    path = P.path("word_bpe_49k.json")
    own = Tokenizer.from_file(path)
    expected = {i: [*own.encode(t or "", add_special_tokens=False).ids, 1] for i, t in NASTY}
    rows = packing.pack_documents(docs(spark).repartition(parts), path, chunk_tokens=chunk, with_ids=True).collect()
    check_pieces(rows, expected)
    groups = {}
    for r in rows:
        groups.setdefault(r.step_group, set()).add((r.sequence_id, r.tier))
    assert all(sum(t for _, t in g) <= 16384 and len({t for _, t in g}) == 1 for g in groups.values())
    assert packing.pack_documents(docs(spark, []), path).count() == 0


def test_step_groups_are_balanced():
    packer = packing.TierPacker(0, 2048, 64, 4096)
    sizes = [50 + 37 * k % 1900 for k in range(900)]
    for at in range(0, 900, 100):
        packer.pack([(k, bytes(4 * n)) for k, n in enumerate(sizes[at : at + 100], at)])
    packer.finish()
    tokens = {}
    for _, _, length, _, _, _, _, tier, group, _ in packer.drain():
        tokens[tier, group] = tokens.get((tier, group), 0) + length
    for tier in {t for t, _ in tokens}:
        own = [n for (t, _), n in tokens.items() if t == tier]
        assert max(own) <= 4096
        if len(own) > packing.HELD_GROUPS:
            assert min(own) >= 4096 * packing.HELD_GROUPS // (packing.HELD_GROUPS + 1) - tier
    assert sum(tokens.values()) == sum(sizes)


def test_word_ids_of_every_low_letter():
    """Each character under U+0250 alone, in a word and beside marks, against the tokenizer as it is loaded."""
    import pyarrow as pa

    path = P.path("word_bpe_49k.json")
    library, words = Tokenizer.from_file(path), packing.WordIds(path)
    texts = [form.format(chr(k)) for k in range(32, 0x250) for form in ("{0}", "a{0}", "{0}B.", "{0}!x", "{0}'s")]
    texts += ["<|endoftext|>", "a<|endoftext|>b", "x <|startoftext|> y", "", " ", "\n\n", "a" * 5000 + "! b"]
    got = words.of(pa.array(texts))
    assert [g.tolist() for g in got] == [[*library.encode(t, add_special_tokens=False).ids, 1] for t in texts]
    assert words.of(pa.array([], pa.string())) == []
