import hashlib
import random

import numpy as np

from pathloom.llm import suffix_dedup
from tests.llm.helpers import NASTY, docs

W = suffix_dedup.WINDOW


def plain(texts):
    """Every window of every text in one dictionary."""
    seen = {}
    for k, t in enumerate(texts):
        for s in range(len(t) - W + 1):
            seen.setdefault(t[s : s + W], []).append((k, s))
    covered = [np.zeros(len(t), bool) for t in texts]
    for places in seen.values():
        if len(places) > 1:
            for k, s in places:
                covered[k][s : s + W] = True
    out = []
    for t, c in zip(texts, covered):
        kept = bytes(np.frombuffer(t, np.uint8)[~c])
        out.append((len(t), int(c.sum()), int((np.diff(np.r_[0, c.astype(int)]) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def corpus():
    rng = random.Random(3)
    word = lambda: rng.choice(["the", "é", "foo", "lorem", "ñandú", "x1", "ß"]) + str(rng.randrange(30))
    passage = " ".join(word() for _ in range(70))
    rows = []
    for k in range(60):
        t = " ".join(word() for _ in range(rng.randrange(5, 250)))
        if k % 3 == 0:  # whole, cut and edited copies of a passage
            a, b = sorted(rng.sample(range(len(passage)), 2))
            cut = passage if k % 2 else passage[a:b]
            at = rng.randrange(len(t))
            t = t[:at] + cut + t[at:]
        rows.append((1000 + k, t))
    for n in (199, 200, 201):
        unit = "".join(rng.choice("abcdefgh") for _ in range(n))
        rows += [(2000 + n, "p" + unit + "q"), (3000 + n, "r" + unit + "s")]
    rows += [(4000, rows[4][1]), (4000, rows[4][1]), (4001, "a" * 199), (4002, "a" * 200), (4003, "b" * 201), (4004, "xyz" * 90)]
    edited = rows[1][1] * 3
    rows += [(5000 + k, edited[: 40 * k] + "!" + edited[40 * k :]) for k in range(12)]
    return NASTY + rows


def compare(spark, rows):
    want = sorted(((i if i is not None else -1), *x) for (i, _), x in zip(rows, plain([(t or "").encode() for _, t in rows])))
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.removal_digests(docs(spark, rows).repartition(3)).collect())
    assert got == want


def test_against_all_windows(spark):
    compare(spark, corpus())


def test_frequent_grams_and_segments(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT", 3)
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 700)
    monkeypatch.setattr(suffix_dedup, "GROUP", 1500)
    rows = [r for part in suffix_dedup._segments([1, 2], [b"x" * 1500, b"y" * 10]) for r in zip(*part)]
    assert sorted({a for _, a, p in rows if p[:1] == b"x"}) == [0, 501, 1002] or len(rows) > 2
    compare(spark, corpus())


def test_empty(spark):
    assert suffix_dedup.removal_digests(docs(spark, [])).count() == 0


def test_text_with_whole_characters(spark):
    rows = corpus()
    out = suffix_dedup.remove_repeats(docs(spark, rows))
    assert out.columns == docs(spark, rows).columns
    got = out.collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r.text for r in got}
    assert by_id[1] is None and by_id[4000] == "" and by_id[2199] == dict(rows)[2199] and by_id[2200] == "pq"


def test_frequent_windows_meet_once(spark, monkeypatch):
    """Repeated windows of frequent grams are counted where they meet: no join whose rows depend on how often a window occurs."""
    from pyspark.sql.types import BinaryType, LongType, StructField, StructType

    monkeypatch.setattr(suffix_dedup, "HOT", 3)
    held = suffix_dedup.keyed(docs(spark, corpus())).select("row", "text")
    packed = held.mapInArrow(suffix_dedup._packed, StructType([StructField("row", LongType()), StructField("packed", BinaryType())]))
    found = suffix_dedup.repeated_ranges(held, packed)
    assert not [line for line in found._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join" in line and "hash#" in line]
