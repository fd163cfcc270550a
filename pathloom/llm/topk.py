"""Exact top-k by inner product with a ball tree per shard.

Shards are the leaves of the top of one ball tree, grown on a bounded sample (SAMPLE rows) and filled with every row; a
shard of many rows (equal vectors, say) is split in parts by a hash. A query visits shards in rounds in order of their
upper bounds (q.c + |q| r): the best one, the next ones up to each of ROUNDS, then all others. Between rounds its k-th
score so far is shared with all its visits to come, and a shard whose bound does not reach it is not visited at all, so
rows and queries are copied only for visits that can matter. In a unit (part of a shard and block of its visitors) the
block descends the part's ball tree together: a node is left by every query whose bound is below its current k-th score,
children with the higher bound come first. Only rows that reach the k-th score come back, and a window over each
query's own rows ranks them.

Defined results: vectors that are null or hold null or non-finite components take no part; only vectors of the query's
own length are candidates; vec_id is a key: of rows with one vec_id the least vector (in order of its components)
counts; ties go to the smaller vec_id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import cut, gives_back, small_batches

SHARD_ROWS, BLOCK_ROWS, LEAF = 2048, 1024, 64
#: Rows that the top of the tree is grown on, and leaves that it may have for vectors of one length (2 MB of centres for 64 components).
SAMPLE, MOST_SHARDS = 20_000, 4096
#: Shards of a query that are behind it after each round; a last round visits all others that its bound leaves.
ROUNDS = (1, 4, 16)
#: Below this, doubles hold all products exactly; above it they are 64-bit integers (scores must fit in them).
EXACT = 2.0**53
NONE = -(2**63) + 1


class BallTree:
    def __init__(self, x: np.ndarray):
        self.x = x
        self.nodes: list[tuple] = []
        self.order = np.arange(len(x))
        if len(x):
            self._grow(0, len(x))

    def _grow(self, a: int, b: int) -> int:
        part = self.x[self.order[a:b]]
        center = part.mean(axis=0)
        far = ((part - center) ** 2).sum(axis=1)
        radius = float(np.sqrt(far.max()))
        number = len(self.nodes)
        self.nodes.append(())
        children = ()
        if b - a > LEAF and radius > 0:
            one = part[int(far.argmax())]
            two = part[int(((part - one) ** 2).sum(axis=1).argmax())]
            side = part @ (two - one)
            middle = (b - a) // 2
            self.order[a:b] = self.order[a:b][np.argpartition(side, middle)]
            children = self._grow(a, a + middle), self._grow(a + middle, b)
        self.nodes[number] = (center, radius, a, b, children)
        return number


def search(tree: BallTree, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, kth: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scores, ids and whether found of the k best rows of the tree for each query, from the given k-th scores (or NONE) on."""
    n = len(queries)
    norms = np.sqrt((queries**2).sum(axis=1))
    exact = not tree.x.size or not n or np.abs(tree.x).max() * np.abs(queries).max() * queries.shape[1] < EXACT
    kind, none = (np.float64, -np.inf) if exact else (np.int64, NONE)
    best, best_ids = np.full((n, k), none, kind), np.full((n, k), np.iinfo(np.int64).max)
    least = np.where(kth == NONE, none, kth).astype(kind)
    slack = 1e-9 * (norms * (np.sqrt((tree.x**2).sum(axis=1)).max() if len(tree.x) else 0)) + 1e-6

    def bound(node: tuple, active: np.ndarray) -> np.ndarray:
        return queries[active] @ node[0] + norms[active] * node[1] + slack[active]

    def visit(number: int, active: np.ndarray) -> None:
        node = tree.nodes[number]
        if node[4]:
            sides = [(bound(tree.nodes[c], active), c) for c in node[4]]
            sides.sort(key=lambda s: -s[0].mean())
            for limit, child in sides:
                on = active[limit >= least[active]]
                if len(on):
                    visit(child, on)
            return
        rows = tree.order[node[2] : node[3]]
        score = queries[active].astype(kind) @ tree.x[rows].astype(kind).T
        score[query_ids[active][:, None] == ids[rows][None, :]] = none
        hit = (score >= least[active][:, None]).any(axis=1)
        if not hit.any():
            return
        on = active[hit]
        scores = np.concatenate([best[on], score[hit]], axis=1)
        names = np.concatenate([best_ids[on], np.broadcast_to(ids[rows], (len(on), len(rows)))], axis=1)
        names = np.where(scores == none, np.iinfo(np.int64).max, names)
        order = np.lexsort((names, -scores), axis=-1)[:, :k]
        best[on], best_ids[on] = np.take_along_axis(scores, order, 1), np.take_along_axis(names, order, 1)
        least[on] = np.maximum(least[on], best[on, -1])

    if len(tree.x) and n:
        root = bound(tree.nodes[0], np.arange(n))
        visit(0, np.flatnonzero(root >= least))
    found = best > none
    return np.where(found, best, 0).astype(np.int64), np.where(found, best_ids, -1), found


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.empty((0, 0))


class Top:
    """The top of a ball tree over a sample of vectors of one length: its leaves are the shards."""

    def __init__(self, x: np.ndarray, leaves: int):
        self.nodes: list[tuple] = []  # (direction, threshold, left, right) or (shard,)
        self.centers: list[np.ndarray] = []
        self._grow(x, max(1, leaves))
        self.centers = np.stack(self.centers)

    def _grow(self, x: np.ndarray, leaves: int) -> int:
        number = len(self.nodes)
        self.nodes.append(())
        center = x.mean(axis=0)
        far = ((x - center) ** 2).sum(axis=1)
        if leaves > 1 and len(x) > 1 and far.max() > 0:
            one = x[int(far.argmax())]
            two = x[int(((x - one) ** 2).sum(axis=1).argmax())]
            direction = two - one
            side = x @ direction
            middle = float(np.partition(side, len(x) // 2)[len(x) // 2])
            low = side < middle
            if not low.any():  # many equal ones at the middle
                low = side <= middle
            if low.any() and not low.all():
                kept = middle if (side[low] < middle).all() else float(np.nextafter(middle, np.inf))
                self.nodes[number] = (direction, kept, self._grow(x[low], leaves // 2), self._grow(x[~low], leaves - leaves // 2))
                return number
        self.nodes[number] = (len(self.centers),)
        self.centers.append(center)
        return number

    def shard_of(self, x: np.ndarray) -> np.ndarray:
        out = np.empty(len(x), np.int32)

        def visit(number: int, rows: np.ndarray) -> None:
            node = self.nodes[number]
            if len(node) == 1:
                out[rows] = node[0]
                return
            low = x[rows] @ node[0] < node[1]
            visit(node[2], rows[low])
            visit(node[3], rows[~low])

        visit(0, np.arange(len(x)))
        return out


def _by_length(batch: pa.RecordBatch, name: str) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Length, rows and matrix of the vectors of each length."""
    sizes = pc.list_value_length(batch.column(name)).to_numpy(zero_copy_only=False)
    for dim in np.unique(sizes):
        rows = np.flatnonzero(sizes == dim)
        yield int(dim), rows, _matrix(batch.column(name).take(pa.array(rows))) if dim else np.zeros((len(rows), 0))


def _placed(tops: dict[int, Top]):
    """Shard of each vector and its distance from the shard's centre; a length that the sample lacks is one shard around zero."""

    @gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shard, reach, dims = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows), np.zeros(batch.num_rows, np.int32)
            for dim, rows, x in _by_length(batch, "v"):
                own = tops[dim].shard_of(x) if dim in tops else np.zeros(len(rows), np.int32)
                shard[rows], dims[rows] = own, dim
                reach[rows] = np.sqrt(((x - (tops[dim].centers[own] if dim in tops else 0)) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(dims), pa.array(shard), pa.array(reach)], ["vec_id", "v", "dim", "shard", "reach"])

    return run


def _asked(tops: dict[int, Top], radius: dict[tuple[int, int], float], first: int, last: int | None):
    """For each query the shards that come first to last in order of their bounds, those only whose bound reaches its k-th score."""

    @gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            taken, shards = [np.empty(0, np.int64)], [np.empty(0, np.int32)]
            kth = batch.column("kth").to_numpy(zero_copy_only=False)
            for dim, rows, q in _by_length(batch, "q"):
                centers = tops[dim].centers if dim in tops else np.zeros((1, dim))
                r = np.array([radius.get((dim, s), -1.0) for s in range(len(centers))])
                norm = np.sqrt((q**2).sum(axis=1))[:, None]
                bound = q @ centers.T + norm * r
                bound += 1e-9 * norm * (np.sqrt((centers**2).sum(axis=1)) + np.abs(r)) + 1e-6
                bound[:, r < 0] = -np.inf  # no vector lies there
                order = np.argsort(-bound, axis=1, kind="stable")[:, first:last]
                least = np.where(kth[rows] == NONE, -np.inf, kth[rows].astype(np.float64))[:, None]
                value = np.take_along_axis(bound, order, 1)
                a, b = np.nonzero((value >= least) & (value > -np.inf))
                taken.append(rows[a])
                shards.append(order[a, b].astype(np.int32))
            part = batch.take(pa.array(np.concatenate(taken)))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.concatenate(shards))], [*part.schema.names, "q_shard"])

    return run


def _unit(k: int):
    def run(candidates: pa.Table, queries: pa.Table) -> pa.Table:
        empty = [pa.array([], t) for t in (pa.int64(), pa.int64(), pa.int64())]
        if not candidates.num_rows or not queries.num_rows:
            return pa.Table.from_arrays(empty, ["query_id", "vec_id", "score"])
        ids, x = candidates.column("vec_id").to_numpy(), _matrix(candidates.column("v"))
        query_ids, q, kth = queries.column("query_id").to_numpy(), _matrix(queries.column("q")), queries.column("kth").to_numpy()
        score, names, found = search(BallTree(x), ids, q, query_ids, kth, k)
        row, col = np.nonzero(found & (score >= kth[:, None]))
        return pa.Table.from_arrays([pa.array(query_ids[row]), pa.array(names[row, col]), pa.array(score[row, col])], ["query_id", "vec_id", "score"])

    return run


def exact_top_k(vectors: DataFrame, is_query, k: int = 20, scale: float = 64.0) -> DataFrame:
    """query_id, rank, vec_id and score (integer inner product of floor(scale * x)) for the rows where is_query holds."""
    x = F.col("embedding").cast("array<double>")
    fine = x.isNotNull() & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    whole = F.transform(x, lambda e: F.floor(F.lit(scale) * e).cast("double"))
    valid = small_batches(vectors).select(F.col("vec_id").cast("long").alias("vec_id"), F.when(fine, whole).alias("v")).filter("v is not null and vec_id is not null")
    once = cut(valid.groupBy("vec_id").agg(F.min("v").alias("v")))
    sample = once.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("v").toArrow()
    total, tops = once.count(), {}
    for batch in sample.combine_chunks().to_batches():
        for dim, rows, matrix in _by_length(batch, "v"):
            tops[dim] = Top(matrix, min(MOST_SHARDS, len(rows), -(-total * len(rows) // (sample.num_rows * SHARD_ROWS))))
    held = cut(once.mapInArrow(_placed(tops), "vec_id long, v array<double>, dim int, shard int, reach double"))
    places = cut(held.groupBy("dim", "shard").agg(F.max("reach").alias("radius"), F.count(F.lit(1)).alias("n")))
    radius = {(r.dim, r.shard): r.radius for r in places.collect()}  # MOST_SHARDS for each length of the sample
    parts = F.ceil(F.col("n") / SHARD_ROWS).cast("int")
    sizes = places.select("dim", "shard", parts.alias("parts"))
    queries = held.filter(is_query).select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"), F.col("dim").alias("q_dim"))
    lowest = F.lit(NONE).cast("long")
    found, kth, seen = None, None, 0
    for last in (*ROUNDS, None):
        if kth is None:
            bounded = queries.withColumn("kth", lowest)
        else:
            bounded = queries.join(kth, "query_id", "left").withColumn("kth", F.coalesce("kth", lowest)).select("query_id", "q", "q_dim", "kth")
        visits = cut(bounded.mapInArrow(_asked(tops, radius, seen, last), "query_id long, q array<double>, q_dim int, kth long, q_shard int"))
        best = cut(_visited(held, visits, sizes, k))
        found = best if found is None else _best(found.unionByName(best), k).drop("rank")
        if last is None or visits.isEmpty():
            break
        found = cut(found)
        kth = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("kth")).filter(F.col("n") >= k).select("query_id", "kth")
        seen = last
    return _best(found, k).select("query_id", "rank", "vec_id", "score")


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.select("query_id", "vec_id", "score").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _visited(held: DataFrame, visits: DataFrame, sizes: DataFrame, k: int) -> DataFrame:
    """query_id, vec_id, score of the rows that reach their query's k-th score, from the visits (query, shard) of a round.

    A shard's rows go to as many units as it has blocks of visitors, its visitors to as many as it has parts."""
    blocks = visits.groupBy(F.col("q_dim").alias("dim"), F.col("q_shard").alias("shard")).agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("blocks"))
    units = sizes.join(blocks, ["dim", "shard"])
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    candidates = held.join(F.broadcast(units), ["dim", "shard"]).select("vec_id", "v", "dim", "shard", own("vec_id", "parts").alias("part"), spread("blocks").alias("block"))
    # every column has a name of its own: both sides of a cogroup come from the same table
    named = units.select(*(F.col(n).alias(f"q_{n}") for n in ("dim", "shard")), "parts", "blocks")
    asked = visits.join(F.broadcast(named), ["q_dim", "q_shard"]).select("query_id", "q", "kth", "q_dim", "q_shard", own("query_id", "blocks").alias("q_block"), spread("parts").alias("q_part"))
    sides = candidates.groupBy("dim", "shard", "part", "block").cogroup(asked.groupBy("q_dim", "q_shard", "q_part", "q_block"))
    return sides.applyInArrow(_unit(k), "query_id long, vec_id long, score long")
