"""Exact removal of repeated byte strings by sampled suffixes and induced classes.

A byte is removed if a string of WINDOW bytes that covers it also starts anywhere else. Sorting every suffix of the
corpus is not needed for that: as in induced sorting only a sample of suffixes is ordered by its own content, and the
others get their order from it. The sample is a synchronising set (of the GRAM-byte strings that begin in a window,
the one with the least hash), so equal windows have equal sample points at equal offsets, in any document or shard.

1. Suffix tuples: each sample point owns a run of window starts. Its tuple is (hash of its gram, hash of the run's
   whole span of bytes, row, position). Spark's disk-backed sort and aggregation bring equal tuples together.
2. A run whose whole span occurs again is repeated as a whole: the common prefix of all its windows is known to reach
   WINDOW bytes without looking at them.
3. A gram with several different spans is the edge of a repeat. One copy of each such span goes, with its bytes, to
   the task of its gram, where the windows (same offset from the sample point) get their classes. Grams with more than
   HOT spans send their windows on their own instead, so no task holds a frequent gram.
4. The removed ranges of a document meet its text once.

Keys are two independent 64-bit hashes (gram and span, or gram and window); texts cross the shuffle compressed.

Defined results: null text is empty; texts under WINDOW bytes lose nothing; equal rows repeat each other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType, StructField, StructType

from ._common import cut, gives_back, small_batches, whole_rows

WINDOW, GRAM = 200, 40
HOT = 2048  # spans of a gram that one task may judge: under a megabyte
SEGMENT = 8 << 20  # positions in a segment must fit in POSITION bits
GROUP = 1 << 18
POSITION = np.uint64((1 << 24) - 1)
_SEED = np.random.default_rng(20240229)
_TABLES = _SEED.integers(0, 2**64, (2, 256), np.uint64)
_BASES = [int(x) | 1 for x in _SEED.integers(2**62, 2**63, 2)]
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a base and of its inverse modulo 2^64, up to n."""
    held = _POWERS.get(which)
    if held is None or len(held[0]) < n:
        size = max(n, 2 * GROUP)
        base = _BASES[which]
        with np.errstate(over="ignore"):
            up = np.full(size, base, np.uint64)
            down = np.full(size, pow(base, -1, 1 << 64), np.uint64)
            up[0] = down[0] = 1
            held = np.multiply.accumulate(up), np.multiply.accumulate(down)
        _POWERS[which] = held
    return held[0][:n], held[1][:n]


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Rolling:
    """Hashes of any range of a byte array; equal bytes give equal hashes wherever they stand."""

    def __init__(self, data: np.ndarray, which: int):
        up, self.down = _powers(which, len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_TABLES[which][data] * up[: len(data)], out=self.sums[1:])

    def of(self, start, end) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.down[start]

    def all(self, width: int) -> np.ndarray:
        n = len(self.sums) - width
        return (self.sums[width:] - self.sums[:n]) * self.down[:n]


def _least(keys: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` neighbours."""
    n = len(keys) - width + 1
    blocks = np.full(-(-len(keys) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    blocks[: len(keys)] = keys
    blocks = blocks.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def runs(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """Runs of window starts with one sample point: index of text, position, windows, offset of the point, gram, span."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(t) for t in texts], np.int64)
    offsets = np.cumsum(sizes) - sizes
    if len(data) < WINDOW:
        return tuple(np.empty(0, np.int64) for _ in range(6))
    hashed = _mix(Rolling(data, 0).all(GRAM))
    least = _least((hashed & ~POSITION) | np.arange(len(hashed), dtype=np.uint64), WINDOW - GRAM + 1)
    point = (least & POSITION).astype(np.int64)
    # windows inside one text
    step = np.zeros(len(data) + 1, np.int32)
    long = sizes >= WINDOW
    np.add.at(step, offsets[long], 1)
    np.add.at(step, (offsets + sizes - WINDOW + 1)[long], -1)
    valid = np.cumsum(step[: len(point)]) > 0
    change = np.empty(len(point) + 1, bool)
    change[0] = change[-1] = True
    np.not_equal(point[1:], point[:-1], out=change[1:-1])
    edge = np.empty(len(point) + 1, bool)
    edge[1:-1] = valid[1:] != valid[:-1]
    edge[0] = edge[-1] = True
    change |= edge
    first = np.flatnonzero(valid & change[:-1])
    last = np.flatnonzero(valid & change[1:])
    windows, offset = last - first + 1, point[first] - first
    span = Rolling(data, 1).of(first, last + WINDOW)
    span = _mix(span ^ _mix(windows.astype(np.uint64) << np.uint64(16) | offset.astype(np.uint64)))
    owner = np.searchsorted(offsets, first, "right") - 1
    return owner, first - offsets[owner], windows, offset, hashed[point[first]].view(np.int64), span.view(np.int64)


def _segments(rows: list, texts: list[bytes]) -> Iterator[tuple[list, list[int], list[bytes]]]:
    """Groups of about GROUP bytes; a very long text comes in segments that share WINDOW - 1 bytes."""
    held, starts, parts, size = [], [], [], 0
    for row, text in zip(rows, texts):
        for at in range(0, max(1, len(text) - WINDOW + 1), SEGMENT - WINDOW + 1):
            part = text[at : at + SEGMENT]
            if held and size + len(part) > GROUP:
                yield held, starts, parts
                held, starts, parts, size = [], [], [], 0
            held.append(row)
            starts.append(at)
            parts.append(part)
            size += len(part)
    if held:
        yield held, starts, parts


def _slices(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Small parts of the batches, so that a task holds few texts at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


RUN = "row long, pos long, shape long, gram long, span long"


@gives_back
def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _slices(batches, 256):
        texts = [t.as_py().encode() for t in batch.column("text")]
        for rows, starts, parts in _segments(batch.column("row").to_pylist(), texts):
            owner, pos, windows, offset, gram, span = runs(parts)
            arrays = [np.array(rows, np.int64)[owner], pos + np.array(starts, np.int64)[owner], windows << 16 | offset, gram, span]
            yield pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], ["row", "pos", "shape", "gram", "span"])


@gives_back
def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All columns, text replaced by its compressed bytes (packed, the last column)."""
    pack = zstandard.ZstdCompressor(level=1).compress
    for batch in _slices(batches, 1024):
        names = [n for n in batch.schema.names if n != "text"]
        texts = pa.array([pack(t.as_py().encode()) for t in batch.column("text")], pa.binary())
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), texts], [*names, "packed"])


def _unpack(packed: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(packed)


SPAN = "gram long, span long, once boolean, row long, pos long, offset int, bytes binary"


@gives_back
def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of each wanted span, cut from the text of its row."""
    for batch in _slices(batches, 256):
        out = []
        for packed, wanted in zip(batch.column("packed"), batch.column("wanted").to_pylist()):
            text = _unpack(packed.as_py())
            for x in wanted:
                windows, offset = x["shape"] >> 16, x["shape"] & 0xFFFF
                out.append((x["gram"], x["span"], x["n"] == 1, x["row"], x["pos"], offset, text[x["pos"] : x["pos"] + windows + WINDOW - 1]))
        kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
        columns = list(zip(*out)) or [()] * 7
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [c.split()[0] for c in SPAN.split(", ")])


def _windows(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every window of every part: index of its part, number in it, hash."""
    data = np.frombuffer(b"".join(parts), np.uint8)
    sizes = np.array([len(p) for p in parts], np.int64)
    counts = sizes - WINDOW + 1
    owner = np.repeat(np.arange(len(parts)), counts)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    return owner, number, _mix(Rolling(data, 1).all(WINDOW)[(np.cumsum(sizes) - sizes)[owner] + number])


RANGE = "row long, first long, last long"


def _ranges(rows: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
    """Runs of neighbouring window starts as (row, first byte, byte after the last)."""
    order = np.lexsort((at, rows))
    rows, at = rows[order], at[order]
    new = np.r_[True, (rows[1:] != rows[:-1]) | (at[1:] > at[:-1] + 1)] if len(at) else np.empty(0, bool)
    ends = np.r_[new[1:], True] if len(at) else new
    return pa.RecordBatch.from_arrays([pa.array(rows[new]), pa.array(at[new]), pa.array(at[ends] + WINDOW)], ["row", "first", "last"])


@gives_back
def _classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repeated windows among the spans of each gram; rows come sorted by gram, a chunk never ends inside one."""

    def judge(table: pa.Table) -> pa.RecordBatch:
        parts = table.column("bytes").to_pylist()
        column = lambda name: table.column(name).to_numpy()
        owner, number, hashed = _windows(parts)
        offset, gram = column("offset")[owner] - number, column("gram")[owner]
        order = np.lexsort((offset, gram, hashed))
        a, b = order[:-1], order[1:]
        same = (hashed[a] == hashed[b]) & (gram[a] == gram[b]) & (offset[a] == offset[b])
        again = np.zeros(len(order), bool)
        again[a[same]] = again[b[same]] = True
        again &= column("once")[owner]  # spans that occur again are removed as a whole
        return _ranges(column("row")[owner[again]], column("pos")[owner[again]] + number[again])

    waiting = None
    for batch in _slices(batches, 2048):
        table = pa.Table.from_batches([batch] if waiting is None else [*waiting.to_batches(), batch])
        waiting = table
        if table.num_rows >= 2048:
            gram = table.column("gram").to_numpy()
            end = int(np.flatnonzero(gram == gram[-1])[0])
            if end:
                yield judge(table.slice(0, end))
                waiting = table.slice(end)
    if waiting is not None and waiting.num_rows:
        yield judge(waiting)


SINGLE = "gram long, off int, hash long, once boolean, row long, at long"


def _singles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each window of a frequent gram's spans as a row."""
    for batch in batches:
        for k in range(0, batch.num_rows, 2048):
            part = batch.slice(k, 2048)
            owner, number, hashed = _windows(part.column("bytes").to_pylist())
            column = lambda name: part.column(name).to_numpy(zero_copy_only=False)[owner]  # noqa: E731, B023
            arrays = [column("gram"), (column("offset") - number).astype(np.int32), hashed.view(np.int64), column("once"), column("row"), column("pos") + number]
            yield pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], [c.split()[0] for c in SINGLE.split(", ")])


@gives_back
def _hot_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """_singles of _spans in one step, so that a task has one Python worker."""
    yield from _singles(_spans(batches))


def keyed(docs: DataFrame, *more) -> DataFrame:
    """row, doc_id, more columns and text.

    row is the doc_id where each row has one of its own, else a hash of doc_id and text, so that equal rows share it."""
    text = F.coalesce(F.col("text"), F.lit(""))
    doc = F.col("doc_id").cast("long")
    shared = docs.groupBy(doc.alias("id")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1 or id is null")
    row = doc if shared.isEmpty() else F.xxhash64(doc, text)
    return small_batches(docs).select(row.alias("row"), doc.alias("doc_id"), *more, text.alias("text"))


def repeated_ranges(held: DataFrame, packed: DataFrame) -> DataFrame:
    """Byte ranges (row, first, last) whose windows occur again; they may overlap. held: of keyed(); packed: of _packed."""
    tuples = held.select("row", "text").filter(F.octet_length("text") >= WINDOW).mapInArrow(_runs, RUN)
    salt = 8  # a frequent gram's tuples are dealt to several tasks
    salted = lambda df: df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salt - 1))))
    own_salt = F.pmod("span", F.lit(salt)).cast("int")
    # most grams occur once: their tuples end here, what follows reads this table only
    grams = tuples.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    tuples = cut(tuples.withColumn("salt", own_salt).join(salted(grams), ["gram", "salt"], "left_semi").drop("salt"))
    spans = tuples.groupBy("gram", "span").agg(F.count(F.lit(1)).alias("n"), F.first("row").alias("row"), F.first("pos").alias("pos"), F.first("shape").alias("shape"))
    kinds = salted(spans.groupBy("gram").agg(F.count(F.lit(1)).alias("k")).filter("k > 1"))
    known = cut(spans.withColumn("salt", own_salt).join(kinds, ["gram", "salt"], "left").filter((F.col("n") > 1) | F.col("k").isNotNull()).drop("salt"))
    whole = known.filter("n > 1").select("gram", "span")
    found = tuples.join(whole, ["gram", "span"]).select("row", F.col("pos").alias("first"), (F.col("pos") + F.shiftright("shape", 16) + (WINDOW - 1)).alias("last"))
    wanted = known.filter("k is not null").groupBy("row").agg(F.collect_list(F.struct("gram", "span", "n", "row", "pos", "shape", "k")).alias("wanted"))
    with_text = packed.select("row", "packed").join(wanted, "row")
    few = lambda test: F.filter("wanted", lambda x: (x["k"] <= HOT) if test else (x["k"] > HOT))
    edges = with_text.withColumn("wanted", few(True)).filter(F.size("wanted") > 0).mapInArrow(_spans, SPAN)
    parts = int(held.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    edges = edges.repartition(parts, "gram").sortWithinPartitions("gram").mapInArrow(_classes, RANGE)
    singles = with_text.withColumn("wanted", few(False)).filter(F.size("wanted") > 0).mapInArrow(_hot_windows, SINGLE)
    # counted where they meet: each window stays one row, whatever its group; a group has one row a span, so a text and its copies count once
    again = singles.withColumn("c", F.count(F.lit(1)).over(Window.partitionBy("gram", "off", "hash")))
    hot = again.filter("once and c > 1")
    return found.unionByName(edges).unionByName(hot.select("row", F.col("at").alias("first"), (F.col("at") + WINDOW).alias("last")))


def merged(ranges, n: int) -> list[tuple[int, int]]:
    """Maximal runs of covered bytes."""
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, min(b, n)])
    return [(a, min(b, n)) for a, b in out]


def _joined(held: DataFrame) -> DataFrame:
    """The rows of keyed() with packed for text, and ranges (null: none)."""
    kinds = [f for f in held.schema.fields if f.name != "text"]
    packed = held.mapInArrow(_packed, StructType([*kinds, StructField("packed", BinaryType())]))
    ranges = repeated_ranges(held, packed).groupBy("row").agg(F.collect_list(F.struct("first", "last")).alias("ranges"))
    return packed.join(ranges, "row", "left")


@gives_back
def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for packed, ranges in zip(batch.column("packed"), batch.column("ranges")):
            text = _unpack(packed.as_py())
            gone = merged([(x["first"], x["last"]) for x in ranges.as_py() or ()], len(text))
            kept, at = hashlib.sha256(), 0
            for a, b in gone:
                kept.update(text[at:a])
                at = b
            kept.update(text[at:])
            rows.append((len(text), sum(b - a for a, b in gone), len(gone), kept.hexdigest()))
        columns = list(zip(*rows)) or [()] * 4
        arrays = [pa.array(c, pa.int64() if k < 3 else pa.string()) for k, c in enumerate(columns)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def removal_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row."""
    return _joined(keyed(docs)).select("doc_id", "packed", "ranges").mapInArrow(_digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


@gives_back
def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for packed, ranges in zip(batch.column("packed"), batch.column("ranges")):
            text, at, parts = _unpack(packed.as_py()), 0, []
            for a, b in merged([(x["first"], x["last"]) for x in ranges.as_py() or ()], len(text)):
                while a < b and text[a] & 0xC0 == 0x80:  # whole characters only
                    a += 1
                while b > a and b < len(text) and text[b] & 0xC0 == 0x80:
                    b -= 1
                parts.append(text[at:a])
                at = b
            out.append(b"".join([*parts, text[at:]]).decode())
        yield pa.RecordBatch.from_arrays([batch.column("rest"), pa.array(out, pa.string())], ["rest", "kept"])


def remove_repeats(docs: DataFrame) -> DataFrame:
    """Every row of docs with the characters that lie whole in repeated ranges removed from text."""
    rest = F.struct(whole_rows(docs.drop("text")).alias("columns"), F.col("text").isNull().alias("no_text"))
    joined = _joined(keyed(docs, rest.alias("rest"))).select("rest", "packed", "ranges")
    kept = joined.mapInArrow(_kept, StructType([joined.schema["rest"], StructField("kept", StringType())]))
    text = F.when(~F.col("rest.no_text"), F.col("kept")).alias("text")
    return kept.select(*(text if c == "text" else F.col("rest.columns").getField(c).alias(c) for c in docs.columns))
