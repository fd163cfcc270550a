"""Quality rules judged by an isolation forest on rule statistics.

One pass computes the statistics of every whole text. Each tree of the forest draws TREE_ROWS rows of its own from all that are
labelled good (from all rows where there are none), as isolation trees do: random splits of random features, also a little outside
the range of all these rows, so few splits isolate an odd document even where odd documents are many and alike. The threshold on the
mean path length is set on all labelled rows: as many bad rows as possible beyond it, at most CLEAN_LOSS of the good
ones. Statistics go to disk between the passes, so the text is read once; shuffled are the labelled rows' statistics.

Defined results: null text is empty text, which fails the base rules; equal rows get equal results; without labels of
both kinds only the base rules decide.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import cut, gives_back, id_and_text
from .labelled import all_training_labels

SYMBOLS = "#*$%&|<>"
_MARKED = re.compile(rb"[#*$%&|<>]").search
SPACES = " \t\n\r\x0b\x0c"
TREES, TREE_ROWS = 120, 256
CLEAN_LOSS = 0.004
#: Splits may fall this share of a feature's range (or of LEAST_RANGE) outside it, which cuts off what no sampled row shows.
MARGIN, LEAST_RANGE = 0.25, 0.05
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MORE = ("n_distinct", "n_short", "n_marked", "n_unlettered")
STATS = "doc_id long, " + ", ".join(f"{c} long" for c in BASE + MORE)


def repeated_words(ids: np.ndarray) -> int:
    """Words in 3-word windows that occur twice or more."""
    if len(ids) < 4:
        return 0
    size = int(ids.max()) + 1
    if size >= 1 << 21:  # pairs get numbers of their own first
        _, pair = np.unique(ids[:-1] * size + ids[1:], return_inverse=True)
        key = pair[:-1] * size + ids[2:]
    else:
        key = (ids[:-2] * size + ids[1:-1]) * size + ids[2:]
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    again = np.zeros(len(key) + 2, bool)
    again[order[1:][same]] = again[order[:-1][same]] = True
    return int((again | np.r_[False, again[:-1]] | np.r_[False, False, again[:-2]]).sum())


def statistics(text: str) -> tuple[int, ...]:
    """BASE and MORE of one text."""
    words = text.encode().split()  # ASCII white space only
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    seen, twice = set(), 0
    for line in text.split("\n"):
        if line.strip(SPACES):
            if line in seen:
                twice += 1
            seen.add(line)
    symbols = sum(map(text.count, SYMBOLS))
    kinds = ((len(w) <= 3, bool(symbols and _MARKED(w)), w.isascii() and w.swapcase() == w) for w in known)
    flags = np.array(list(kinds), np.int64).reshape(-1, 3)[ids].sum(axis=0).tolist() if words else [0, 0, 0]
    chars = len(text) - sum(map(text.count, SPACES))
    return len(words), chars, symbols, twice, repeated_words(ids), len(known), *flags


@gives_back
def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns = list(zip(*(statistics(t.as_py()) for t in batch.column("text")))) or [()] * len(BASE + MORE)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in columns)], ["doc_id", *BASE, *MORE])


def features(stats: np.ndarray) -> np.ndarray:
    """Ratios of the statistics (columns BASE + MORE): word length, symbols, variety, short, marked and unlettered words.

    Repeats and copied lines are left to the base rules: they vary so much among good documents that splits on them
    hide what sets bad ones apart."""
    words, chars, symbols, _, _, distinct, short, marked, unlettered = stats.astype(np.float64).T
    n = np.maximum(words, 1)
    return np.stack([chars / n, np.sqrt(symbols / np.maximum(chars, 1)), distinct / n**0.85, short / n, marked / n, unlettered / n], axis=1)


class Forest:
    """Isolation trees in flat arrays; a leaf points at itself."""

    def __init__(self, x: np.ndarray, trees: int = TREES, rows: int = TREE_ROWS, seed: int = 7, drawn: list[np.ndarray] | None = None):
        """x: the rows to draw from; or, with rows drawn for each tree, any rows that span the range of all."""
        rng = np.random.default_rng(seed)
        self.feature, self.split, self.left, self.right, self.length, self.roots = [], [], [], [], [], []
        deepest = int(np.ceil(np.log2(max(2, min(rows, len(x) if drawn is None else max(map(len, drawn))))))) + 2
        self.depth = deepest
        self.margin = np.maximum(x.max(axis=0) - x.min(axis=0), LEAST_RANGE) * MARGIN
        for k in range(trees):
            part = x[rng.choice(len(x), min(rows, len(x)), replace=False)] if drawn is None else drawn[k]
            self.roots.append(self._grow(part, 0, deepest, rng))
        for name in ("feature", "split", "left", "right", "length", "roots"):
            setattr(self, name, np.array(getattr(self, name)))

    def _grow(self, x: np.ndarray, depth: int, deepest: int, rng) -> int:
        node = len(self.feature)
        for held, value in ((self.feature, 0), (self.split, 0.0), (self.left, node), (self.right, node), (self.length, 0.0)):
            held.append(value)
        n = len(x)
        if depth == deepest or n <= 1:
            self.length[node] = depth + (2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else max(0, n - 1))
            return node
        low, high = x.min(axis=0) - self.margin, x.max(axis=0) + self.margin
        f = int(rng.integers(x.shape[1]))
        at = rng.uniform(low[f], high[f])
        side = x[:, f] <= at
        self.feature[node], self.split[node] = f, at
        self.left[node] = self._grow(x[side], depth + 1, deepest, rng)
        self.right[node] = self._grow(x[~side], depth + 1, deepest, rng)
        return node

    def path(self, x: np.ndarray) -> np.ndarray:
        """Mean path length; short is odd."""
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(self.depth):
                node = np.where(x[rows, self.feature[node]] <= self.split[node], self.left[node], self.right[node])
            total += self.length[node]
        return total / max(1, len(self.roots))


def threshold(path: np.ndarray, label: np.ndarray, loss: float = CLEAN_LOSS) -> float:
    """The path length below which a row is dropped: best balance of bad rows caught and good rows lost, under `loss`."""
    good, bad = np.sort(path[label == 1]), np.sort(path[label == 0])
    if not len(good) or not len(bad):
        return -np.inf
    cuts = np.unique(path)
    lost = np.searchsorted(good, cuts, "left") / len(good)
    caught = np.searchsorted(bad, cuts, "left") / len(bad)
    k = int(np.argmax(np.where(lost <= loss, caught - lost, -1)))
    return float((cuts[max(0, k - 1)] + cuts[k]) / 2) if k else -np.inf


def base_failed(words, repeat):
    return (words < 50) | (100 * repeat > 50 * words)


def grown(rows: DataFrame) -> Forest | None:
    """A forest on rows (doc_id, BASE, MORE): each tree has the TREE_ROWS of all rows with the least hash of doc_id and tree; None for fewer than two rows."""
    names = list(BASE + MORE)
    count = rows.count()
    if count < 2:
        return None

    @gives_back
    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = features(np.stack([batch.column(c).to_numpy() for c in names], axis=1))
                yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (*x.min(axis=0), *x.max(axis=0))], kinds)

    width = len(features(np.zeros((1, len(names)), np.int64))[0])
    kinds = [f"{end}{k}" for end in ("low", "high") for k in range(width)]
    span = rows.select(*names).mapInArrow(ends, ", ".join(f"{k} double" for k in kinds))
    span = span.agg(*(F.min(k) if k.startswith("low") else F.max(k) for k in kinds)).first()
    # a row is looked at by a tree if its hash is low enough for some four times the rows that the tree takes
    least = int(-(1 << 63) + min(1.0, 4 * TREE_ROWS / count) * ((1 << 64) - 1)) if count > 4 * TREE_ROWS else (1 << 63) - 1
    trees = F.filter(F.sequence(F.lit(0), F.lit(TREES - 1)), lambda t: F.xxhash64("doc_id", t) <= F.lit(least))
    drawn = rows.select("doc_id", *names, F.explode(trees).alias("tree")).withColumn("h", F.xxhash64("doc_id", "tree"))
    drawn = drawn.withColumn("k", F.row_number().over(Window.partitionBy("tree").orderBy("h", "doc_id", *names))).filter(F.col("k") <= TREE_ROWS)
    held = drawn.orderBy("tree", "k").select("tree", *names).toPandas().to_numpy(np.int64)
    own = np.split(features(held[:, 1:]), np.searchsorted(held[:, 0], np.arange(1, TREES)))
    return Forest(np.array(span, float).reshape(2, width), drawn=own)


def best_threshold(known: DataFrame, forest: Forest, loss: float = CLEAN_LOSS) -> float:
    """threshold() over all rows of known (BASE, MORE, label): rows of one path length are counted together, counts run on over ranges of lengths."""
    names = list(BASE + MORE)

    @gives_back
    def paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.stack([batch.column(c).to_numpy() for c in names], axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(forest.path(features(rows))), batch.column("label")], ["path", "label"])

    counts = known.select(*names, "label").mapInArrow(paths, "path double, label int").groupBy("path").agg(F.count_if(F.col("label") == 1).alias("good"), F.count_if(F.col("label") == 0).alias("bad"))
    parts = int(known.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut(counts.repartitionByRange(parts, "path").withColumn("part", F.spark_partition_id()))
    sums = sorted(tuple(r) for r in dealt.groupBy("part").agg(F.sum("good"), F.sum("bad")).collect())
    n_good, n_bad = sum(s[1] for s in sums), sum(s[2] for s in sums)
    if not n_good or not n_bad:
        return -np.inf
    before, so_far = {}, (0, 0)
    for part, g, b in sums:
        before[part] = so_far
        so_far = so_far[0] + g, so_far[1] + b
    earlier = known.sparkSession.createDataFrame([(part, g, b) for part, (g, b) in before.items()], "part int, more_good long, more_bad long")
    run = Window.partitionBy("part").orderBy("path").rowsBetween(Window.unboundedPreceding, -1)
    below = lambda n: F.coalesce(F.sum(n).over(run), F.lit(0)) + F.col(f"more_{n}")
    at = dealt.join(F.broadcast(earlier), "part").select("path", (below("good") / n_good).alias("lost"), (below("bad") / n_bad).alias("caught"))
    best = at.filter(F.col("lost") <= loss).agg(F.max(F.struct((F.col("caught") - F.col("lost")).alias("v"), (-F.col("path")).alias("p"))).alias("m")).first().m
    last = dealt.filter(F.col("path") < -best.p).agg(F.max("path")).first()[0]
    return -np.inf if last is None else float((last + -best.p) / 2)


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, BASE, base_failed, path_length and kept of every row."""
    stats = cut(id_and_text(docs).mapInArrow(_statistics, STATS))
    names = list(BASE + MORE)
    passed = stats.filter(~base_failed(F.col("n_words"), F.col("n_repeat_words")))
    known = cut(passed.join(all_training_labels(labels, "quality"), "doc_id").select("doc_id", *names, "label"))
    good = known.filter("label = 1").drop("label")
    forest = grown(good if len(good.take(2)) == 2 else passed)
    least = best_threshold(known, forest) if forest is not None else -np.inf

    @gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.stack([batch.column(c).to_numpy() for c in names], axis=1)
            path = forest.path(features(rows)) if forest is not None else np.zeros(len(rows))
            failed = (rows[:, 0] < 50) | (100 * rows[:, 4] > 50 * rows[:, 0])
            arrays = [batch.column("doc_id"), *(batch.column(c) for c in BASE), pa.array(failed), pa.array(path), pa.array(~failed & (path >= least))]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", *BASE, "base_failed", "path_length", "kept"])

    out = "doc_id long, " + ", ".join(f"{c} long" for c in BASE) + ", base_failed boolean, path_length double, kept boolean"
    return stats.mapInArrow(run, out)
