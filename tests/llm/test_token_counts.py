import base64
import random

import public_tokenizers as P
import tiktoken

from pathloom.llm import token_counts
from tests.llm.helpers import NASTY, docs

PATH = P.path("byte_bpe_50k.tiktoken")


def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def test_edits_against_counting_anew(monkeypatch):
    monkeypatch.setattr(token_counts, "LEAF_WORDS", 3)
    rng, encode, count = random.Random(6), library(), token_counts.counter(PATH, P.PATTERN)
    pieces = ["word", " ", "  ", "\n", ". ", "x's ", "12", "é", "\t", " 'll", "", "some longer words here now", "!!!"]
    for text in [t or "" for _, t in NASTY if len(t or "") < 400] + [" ".join(f"w{i}" for i in range(200))]:
        tree = token_counts.SegmentTree(text, *count.leaves(text), count)
        assert tree.total == len(encode(text))
        for _ in range(60):
            n = len(text)
            a = rng.randrange(n + 1)
            b = a + rng.randrange(8) if rng.random() < 0.9 else n
            new = "".join(rng.choice(pieces) for _ in range(rng.randrange(4)))
            text = text[:a] + new + text[b:]
            tree.edit(a, b, new)
            assert tree.text == text
            assert tree.total == len(encode(text)), (text, a, b, new)
            assert sum(tree.leaves()[0]) == len(text) and sum(tree.leaves()[1]) == tree.total
        tree.edit(0, len(text), " ".join(["grown"] * 500))
        tree.edit(100, 103, "?")
        assert tree.total == len(encode(tree.text))


def test_untouched_leaves_are_not_encoded():
    count = token_counts.counter(PATH, P.PATTERN)
    text = " ".join(f"word{i}" for i in range(50_000))
    tree = token_counts.SegmentTree(text, *count.leaves(text), count)
    tree.edit(200_000, 200_004, "new")
    assert tree.encoded < 3 * token_counts.LEAF_WORDS * 12


def test_frames(spark):
    encode = library()
    got = {r.doc_id: r for r in token_counts.counts_and_recounts(docs(spark), PATH, P.PATTERN).collect()}
    assert len(got) == len(NASTY)
    for i, t in NASTY:
        after = t or ""
        for a, b, new in token_counts.revision(after):
            a = min(a, len(after))
            after = after[:a] + new + after[max(a, b) :]
        assert (got[i].n_tokens, got[i].edited_chars, got[i].edited_tokens) == (len(encode(t or "")), len(after), len(encode(after)))
    trees = token_counts.build_trees(docs(spark), PATH, P.PATTERN)
    edits = spark.createDataFrame([(5, 2, 0, 1, "J"), (5, 1, 3, 99, None), (12, 1, 50, 60, "zz")], "doc_id long, seq int, start int, stop int, new string")
    again = {r.doc_id: r for r in token_counts.recount(docs(spark), trees, edits, PATH, P.PATTERN).collect()}
    assert set(again) == {5, 12} and again[5].text == "Jel"
    assert all(r.n_tokens == len(encode(r.text)) and sum(r.leaf_tokens) == r.n_tokens for r in again.values())
    assert token_counts.counts_and_recounts(docs(spark, []), PATH, P.PATTERN).count() == 0
