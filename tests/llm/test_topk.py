import numpy as np
from pyspark.sql import functions as F

from pathloom.llm import topk


def plain(rows, k, every):
    out = {}
    held = [(i, np.floor(64 * np.array(v, float)).astype(object)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    for i, q in held:
        if i % every == 0:
            scored = sorted(((-(int((q * c).sum())), j) for j, c in held if j != i and len(c) == len(q)))[:k]
            out[i] = [(r + 1, j, -s) for r, (s, j) in enumerate(scored)]
    return out


def compare(spark, rows, k=7, every=5):
    frame = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, label int, shard int")
    got = {}
    for r in topk.exact_top_k(frame, F.col("vec_id") % every == 0, k).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    want = {i: v for i, v in plain(rows, k, every).items() if v}
    assert {i: sorted(v) for i, v in got.items()} == want


def test_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD_ROWS", 60)
    monkeypatch.setattr(topk, "BLOCK_ROWS", 20)
    monkeypatch.setattr(topk, "LEAF", 8)
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(0, 1, 12).astype(np.float32).tolist()) for i in range(300)]
    rows += [(300 + i, rows[3][1]) for i in range(80)]  # ties
    rows += [(400, None), (401, [None] * 12), (402, [float("nan")] * 12), (405, [float("inf")] + [0.0] * 11), (410, [0.0] * 12), (None, [1.0] * 12), (415, [1.0, 2.0]), (420, [1.0, -2.0]), (425, [])]
    compare(spark, rows)
    compare(spark, [(5, [1.0]), (6, [2.0])])
    compare(spark, [])


def test_large_numbers(spark):
    rows = [(i, [float(2**23 + i), float(-(2**19) * i), 3.0]) for i in range(12)]
    compare(spark, rows)


def test_repeated_ids(spark):
    """A row that stands twice counts once; of different vectors of one id the least counts."""
    rows = [(5, [1.0, 2.0]), (5, [1.0, 2.0]), (6, [3.0, 1.0]), (6, [2.0, 9.0]), (7, [0.5, 0.5]), (10, [1.0, 1.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted(tuple(r) for r in topk.exact_top_k(frame, F.col("vec_id") % 5 == 0).select("query_id", "rank", "vec_id", "score").collect())
    want = plain([(5, [1.0, 2.0]), (6, [2.0, 9.0]), (7, [0.5, 0.5]), (10, [1.0, 1.0])], 20, 5)
    assert got == sorted((q, *r) for q, v in want.items() for r in v)


def test_shards_hold_every_row_and_bound_it(spark):
    rng = np.random.default_rng(7)
    x = np.concatenate([rng.normal(0, 1, (400, 8)), np.tile(rng.normal(0, 1, 8), (300, 1)), np.zeros((100, 8))])
    top = topk.Top(x[::3], 16)
    shard = top.shard_of(x)
    assert set(shard.tolist()) <= set(range(len(top.centers))) and len(set(shard.tolist())) > 8
    assert len(topk.Top(np.ones((50, 3)), 8).centers) == 1
