"""Order-dependent folds as table functions over Arrow batches: df.asTable().partitionBy(...).orderBy(...) brings each group, in order, to one
instance, which keeps its state from batch to batch; Spark sorts and deals the groups, and no group has to fit in a batch."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def path_points_function(interval: float):
    """Of path_id, seq, x, y, z in order of seq: the first vertex, each at least `interval` along the way after the one taken before, and the last if it is apart."""

    @F.arrow_udtf(returnType="path_id bigint, seq bigint")
    class PathPoints:
        def __init__(self):
            self.way, self.before, self.kept, self.last = 0.0, None, None, None

        def eval(self, batch: pa.RecordBatch):
            places = np.stack([batch.column(a).to_numpy(zero_copy_only=False) for a in "xyz"], axis=1)
            ids, taken = list(zip(batch.column("path_id").to_pylist(), batch.column("seq").to_pylist())), []
            for row, place in zip(ids, places):
                self.way += 0.0 if self.before is None else float(np.sqrt(((place - self.before) ** 2).sum()))
                if self.before is None or self.way >= interval:
                    self.way, self.kept = 0.0, place
                    taken.append(row)
                self.before, self.last = place, row
            if taken:
                yield pa.table({"path_id": pa.array([t[0] for t in taken], pa.int64()), "seq": pa.array([t[1] for t in taken], pa.int64())})

        def terminate(self):
            if self.last is not None and float(np.sqrt(((self.before - self.kept) ** 2).sum())) > 0.01:
                yield pa.table({"path_id": pa.array([self.last[0]], pa.int64()), "seq": pa.array([self.last[1]], pa.int64())})

    return PathPoints


def sampled_points(track: DataFrame, interval: float) -> DataFrame:
    """path_id and seq of the vertices taken of each path."""
    rows = track.select("path_id", "seq", "x", "y", "z").asTable().partitionBy("path_id").orderBy("seq")
    return path_points_function(interval)(rows)


def novelty_function(kinds: str, least: float, free: int):
    """Of rows with marks and target in order: the first `free`, then those of whose marks a share of `least` or more is new, up to the target."""

    @F.arrow_udtf(returnType=kinds)
    class Novel:
        def __init__(self):
            self.covered, self.count = set(), 0

        def eval(self, batch: pa.RecordBatch):
            taken = []
            for k, (marks, target) in enumerate(zip(batch.column("marks").to_pylist(), batch.column("target").to_pylist())):
                if self.count < target:
                    own = set(marks)
                    if self.count < free or (own and len(own - self.covered) / len(own) >= least):
                        taken.append(k)
                        self.count += 1
                        self.covered |= own
            if taken:
                yield pa.Table.from_batches([batch]).take(taken)

    return Novel


def novel(candidates: DataFrame, keys: list[str], order: list, least: float, free: int = 5) -> DataFrame:
    """Rows of candidates chosen for what is new in them, in the given order within keys; same columns, marks and target among them."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in candidates.schema.fields)
    return novelty_function(kinds, least, free)(candidates.asTable().partitionBy(*keys).orderBy(*order))
