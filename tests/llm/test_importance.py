"""Resampling held against a plain version in Python."""

import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pathloom.llm import importance
from tests.llm.helpers import NASTY, docs


def features(text, grams=2):
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return words, [" ".join(words[i : i + k]) for k in range(1, grams + 1) for i in range(len(words) - k + 1)]


def plain(rows, target, buckets=10_000, share=25, least=20, grams=2):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s = Counter(bucket(f) for _, t in rows for f in features(t, grams)[1])
    t_ = Counter(bucket(f) for t in target for f in features(t, grams)[1])
    S, T = sum(s.values()), sum(t_.values())
    gain = [math.floor(1000 * math.log((t_[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets)))) for b in range(buckets)]
    out = []
    for i, t in rows:
        words, found = features(t, grams)
        weight = sum(gain[bucket(f)] for f in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(words), len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    drawn = [r[0] for r in able[: len(able) * share // 100]]
    return {(r[0], r[2], r[3], r[4]) for r in out}, drawn


def same(got, rows, target, **options):
    want, drawn = plain(rows, target, **options)
    assert len(got) == len(rows) and {(r.doc_id, r.n_features, r.weight, r.score) for r in got} == want
    ranks = sorted((r.rank, r.doc_id) for r in got if r.rank is not None)
    assert [k for k, _ in ranks] == list(range(1, len(drawn) + 1)) and [i for _, i in ranks] == drawn


def benchmark(spark, texts):
    return spark.createDataFrame([(k, t, 0) for k, t in enumerate(texts)], "item_id long, text string, n int")


def test_edge_cases(spark):
    target = ["Hello world", None, "word word", "İstanbul ß ｗｉｄｅ\x00null", "x" * 900]
    rows = NASTY + [(20 + k, f"Word {k} of many, WORD word hello world " * (k % 7 + 1)) for k in range(60)]
    same(importance.resample(docs(spark, rows), benchmark(spark, target)).collect(), rows, target)


def test_other_parameters_and_long_grams(spark):
    rows = [(k, f"a b c d e f a b c {k % 5} " * (k % 4)) for k in range(40)]
    got = importance.resample(docs(spark, rows), benchmark(spark, ["a b c d", "c d"]), grams=5, buckets=97, least_words=3, share=50).collect()
    same(got, rows, ["a b c d", "c d"], grams=5, buckets=97, least=3, share=50)


def test_empty_tables(spark):
    assert importance.resample(docs(spark, []), benchmark(spark, ["a b"])).collect() == []
    same(importance.resample(docs(spark), benchmark(spark, [])).collect(), NASTY, [])


def test_equal_scores_and_repeated_rows(spark):
    rows = [(k // 3, "one two three " * 8) for k in range(300)] + [(None, "one two three " * 8)] * 5
    same(importance.resample(docs(spark, rows), benchmark(spark, ["two three"])).collect(), rows, ["two three"])


def test_whole_tables(spark):
    folder = "/root/testdata/sf0.001"
    read = {n: spark.read.parquet(f"{folder}/{n}.parquet") for n in ("documents", "benchmark")}
    rows = [(r.doc_id, r.text) for r in read["documents"].collect()]
    frame = importance.resample(read["documents"], read["benchmark"])
    got = frame.collect()
    same(got, rows, [r.text for r in read["benchmark"].collect()])
    con = duckdb.connect()
    for name in read:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    result = con.execute(importance.SQL)
    assert [d[0] for d in result.description] == frame.columns and {str(d[1]) for d in result.description} == {"BIGINT"} == {t.upper() for _, t in frame.dtypes}
    assert {tuple(r) for r in got} == set(result.fetchall())


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="abA \n,é0", max_size=30), min_size=1, max_size=8), st.integers(1, 5))
def test_buckets_of_runs_equal_those_of_each_gram(texts, grams):
    places, found, edges = importance.gram_buckets(pa.array(texts, pa.string()), grams, 1000)
    for n, text in enumerate(texts):
        got = [int(b) for k in range(grams) for b in found[k][(places[k] >= edges[n]) & (places[k] < edges[n + 1])]]
        assert got == [zlib.crc32(f.encode()) % 1000 for f in features(text, grams)[1]]


@pytest.mark.parametrize("depth", [1, 2, 3, 5])
def test_suffix_order_and_common_prefixes(depth):
    draw = np.random.default_rng(depth)
    ids, sizes = draw.integers(0, 3, 60), [20, 0, 1, 39]
    room = np.concatenate([np.arange(n, 0, -1) for n in sizes]).astype(np.int64)
    order, shared = importance.sorted_suffixes(ids, room, depth)
    tails = [tuple(ids[i : i + min(room[i], depth)]) for i in order]
    assert tails == sorted(tails)
    for (a, b), n in zip(zip(tails, tails[1:]), shared[1:]):
        assert n == next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
