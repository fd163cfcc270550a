"""Importance resampling of documents towards the n-gram distribution of target texts.

Every task sorts the suffixes of its texts' word ids (by prefix doubling, as far as the longest n-gram reaches) and takes
the common-prefix lengths of neighbours. A run of suffixes that share k words is one k-gram: its hash is taken once, from the hash of
its first k - 1 words, and its bucket is scattered back to all places where it occurs. So a passage that many documents
share costs one hash in a chunk. Suffixes never run past their document.

How it scales: two passes over the texts, no shuffle of texts or n-grams. The first sends bucket counts (as many rows a task as there
are buckets, at most), the second the documents' scores. The gains, one number for each bucket, are the only thing that
passes through the driver; their number is a parameter. Ranks come from a range partitioning of the scores: the place in
a partition and the sizes of those before it, so no task sorts all rows; what a drawn document is ranked by is unique, so equal
scores are spread too.

Defined results: null text has no words; a document without features weighs 0; a null doc_id is hashed as the empty
string and comes last among equals; a repeated row is a document of its own; without target texts all target counts are 0;
no documents give no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import cut, gives_back, id_and_text
from .packing import chunks

#: Bytes of text whose suffixes are sorted at once (a longer text is sorted alone).
CHUNK_BYTES = 6 << 20
#: For each byte its lower case, a space where it parts words. Bytes from 0x80 belong to words.
_FOLDED = np.array([b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], np.uint8)


def words_of(texts: pa.Array) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """Word ids of all texts one after the other, the words, and where each text's ids begin (one more entry for the end)."""
    texts = texts.cast(pa.large_string())
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    folded = _FOLDED[np.frombuffer(data, np.uint8)[at[0] : at[-1]]] if at[-1] > at[0] else np.empty(0, np.uint8)
    held = pa.Array.from_buffers(pa.large_string(), len(texts), [None, pa.py_buffer(np.ascontiguousarray(at - at[0])), pa.py_buffer(folded)])
    parts = pc.ascii_split_whitespace(held)
    flat = parts.flatten()
    real = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    coded = flat.filter(pa.array(real)).dictionary_encode()
    edges = np.r_[0, np.cumsum(real)][parts.offsets.to_numpy() - parts.offsets[0].as_py()]
    return coded.indices.to_numpy().astype(np.int64), coded.dictionary.cast(pa.large_binary()).to_pylist(), edges


def sorted_suffixes(ids: np.ndarray, room: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in the order of their suffixes, compared on `depth` words at least, and how many words (depth at most) each shares with the one before.

    room holds how many words of its own document begin at each place."""
    rank, reach = ids, 1
    while reach < depth:
        after = np.zeros_like(rank)  # a suffix that ends comes first
        after[:-reach] = np.where(room[:-reach] > reach, rank[reach:] + 1, 0)
        joined = rank * (int(rank.max(initial=0)) + 2) + after
        reach *= 2
        if reach < depth:
            rank = np.unique(joined, return_inverse=True)[1]
        else:
            rank = joined
    order = np.argsort(rank, kind="stable")
    shared, alike = np.zeros(len(ids), np.int8), np.ones(max(len(ids) - 1, 0), bool)
    for k in range(depth):
        here, before = order[1:], order[:-1]
        alike &= (room[here] > k) & (room[before] > k)
        alike[alike] = ids[here[alike] + k] == ids[before[alike] + k]
        shared[1:] += alike
    return order, shared


def gram_buckets(texts: pa.Array, grams: int, buckets: int) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """For each k up to `grams`: the places where a k-gram begins and the buckets of these k-grams; and the edges of the texts."""
    ids, words, edges = words_of(texts)
    room = np.repeat(edges[1:], np.diff(edges)) - np.arange(len(ids))
    order, shared = sorted_suffixes(ids, room, grams)
    spaced, crc32 = [b" " + w for w in words], zlib.crc32
    hashes, places, found = np.zeros(len(ids), np.int64), [], []
    for k in range(1, grams + 1):
        held = room[order] >= k
        at, first = order[held], (shared < k)[held]
        leads = at[first]  # one place for each run
        last = ids[leads + k - 1].tolist()
        if k == 1:
            of_run = np.array([crc32(words[w]) for w in last], np.int64)
        else:
            of_run = np.array([crc32(spaced[w], before) for w, before in zip(last, hashes[leads].tolist())], np.int64)
        hashes[at] = of_run[np.cumsum(first) - 1]
        places.append(np.flatnonzero(room >= k))
        found.append(hashes[places[-1]] % buckets)
    return places, found, edges


def bucket_counts(texts: DataFrame, grams: int, buckets: int) -> DataFrame:
    """bucket and n: how many n-grams of all texts (column text) fall into each bucket that holds any."""

    @gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros(buckets, np.int64)
        for part in chunks(batches, CHUNK_BYTES):
            for found in gram_buckets(part.column("text").chunk(0), grams, buckets)[1]:
                totals += np.bincount(found, minlength=buckets)
        kept = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(kept, pa.int32()), pa.array(totals[kept], pa.int64())], ["bucket", "n"])

    return texts.select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(corpus: DataFrame, target: DataFrame, buckets: int) -> list[int]:
    """A gain for each bucket from the counts of both sides, smoothed by one; as many numbers as buckets."""
    counts = corpus.select("bucket", "n", F.lit(0).alias("t")).unionByName(target.select("bucket", F.lit(0).cast("long").alias("n"), F.col("n").alias("t")))
    counts = cut(counts.groupBy("bucket").agg(F.sum("n").alias("s"), F.sum("t").alias("t")))  # the totals read it too
    total = counts.agg(F.coalesce(F.sum("s"), F.lit(0)).alias("s"), F.coalesce(F.sum("t"), F.lit(0)).alias("t")).first()
    every = corpus.sparkSession.range(buckets).join(counts, F.col("id") == F.col("bucket"), "left")
    s, t = (F.coalesce(c, F.lit(0)).cast("double") for c in ("s", "t"))
    gain = F.floor(1000 * F.log((t + 1) * float(total.s + buckets) / ((s + 1) * float(total.t + buckets))))
    return [r.gain for r in every.select("id", gain.alias("gain")).orderBy("id").collect()]


def weigh(docs: DataFrame, gains: list[int], grams: int) -> DataFrame:
    """doc_id, n_words, n_features and weight (the floored mean of the gains of its n-grams) of every document."""

    @gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = np.array(gains, np.int64)
        for part in chunks(batches, CHUNK_BYTES):
            places, found, edges = gram_buckets(part.column("text").chunk(0), grams, len(gains))
            at = np.zeros((2, int(edges[-1]) + 1), np.int64)  # features and gains that begin before each place
            for k, places_of_k in enumerate(places):
                at[0, places_of_k + 1] += 1
                at[1, places_of_k + 1] += gain[found[k]]
            features, total = np.diff(np.cumsum(at, axis=1)[:, edges], axis=1)
            weight = np.where(features > 0, total // np.maximum(features, 1), 0)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id").chunk(0), pa.array(np.diff(edges), pa.int64()), pa.array(features, pa.int64()), pa.array(weight, pa.int64())],
                ["doc_id", "n_words", "n_features", "weight"],
            )

    return id_and_text(docs).mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def ranked(rows: DataFrame, order: list) -> DataFrame:
    """rows with rank (from 1) in the given order, which must name every row apart; by ranges, so that no task holds all rows."""
    low = (1 << 33) - 1  # monotonically_increasing_id: place in the partition in the low 33 bits
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    placed = cut(placed.withColumn("_part", F.shiftright("_at", 33)).withColumn("_place", F.col("_at").bitwiseAND(low)).drop("_at"))
    sizes = placed.groupBy(F.col("_part").alias("_own")).agg(F.count("*").alias("_n"))  # one row a partition
    sizes = sizes.withColumn("_before", F.sum("_n").over(Window.orderBy("_own")) - F.col("_n")).drop("_n")
    joined = placed.join(F.broadcast(sizes), F.col("_part") == F.col("_own"))
    return joined.withColumn("rank", F.col("_before") + F.col("_place") + 1).drop("_part", "_place", "_own", "_before")


def resample(docs: DataFrame, target: DataFrame, grams: int = 2, buckets: int = 10_000, seed: int = 7, least_words: int = 20, share: int = 25) -> DataFrame:
    """Every document with n_features, weight, score (the weight with Gumbel noise from a hash of its id) and rank.

    `share` percent of the documents with `least_words` words or more are drawn by the highest scores, ties to the smaller doc_id;
    the others have no rank."""
    gains = bucket_gains(bucket_counts(docs, grams, buckets), bucket_counts(target, grams, buckets), buckets)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296)))
    scored = cut(weigh(docs, gains, grams).withColumn("score", F.col("weight") + noise))
    long_enough = scored.where(F.col("n_words") >= least_words).withColumn("_row", F.monotonically_increasing_id())
    drawn = scored.where(F.col("n_words") >= least_words).count() * share // 100
    placed = ranked(long_enough, [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features"), F.asc("weight"), F.asc("_row")]).drop("_row")
    placed = placed.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    short = scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    columns = ["doc_id", "n_features", "weight", "score", "rank"]
    return placed.select(columns).unionByName(short.select(columns))


#: DuckDB SQL for the rows of resample() with its own parameters.
SQL = """
WITH crc_table AS (
    SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, b) ORDER BY b) AS crc FROM (SELECT unnest(range(256)) AS b)
), texts AS (
    SELECT row_number() OVER () AS row_no, doc_id, coalesce(text, '') AS text, TRUE AS own FROM documents
    UNION ALL SELECT -row_number() OVER (), NULL, coalesce(text, ''), FALSE FROM benchmark
), worded AS (
    SELECT row_no, doc_id, own, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM texts
), grams AS (
    SELECT row_no, own, unnest(list_concat(words, list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]))) AS feature FROM worded
), hashed AS (
    SELECT feature, xor(4294967295, list_reduce(regexp_extract_all(hex(encode(feature)), '..'), lambda c, x: xor(c >> 8, crc[(xor(c, CAST('0x' || x AS BIGINT)) & 255) + 1]), 4294967295)) % 10000 AS bucket
    FROM (SELECT DISTINCT feature FROM grams), crc_table
), counts AS (
    SELECT bucket, count(*) FILTER (own) AS s, count(*) FILTER (NOT own) AS t FROM grams JOIN hashed USING (feature) GROUP BY bucket
), gains AS (
    SELECT bucket, floor(1000 * ln(CAST(t + 1 AS DOUBLE) * CAST(sum(s) OVER () + 10000 AS DOUBLE) / (CAST(s + 1 AS DOUBLE) * CAST(sum(t) OVER () + 10000 AS DOUBLE)))) AS gain FROM counts
), weights AS (
    SELECT row_no, count(*) AS n_features, CAST(floor(sum(gain) / count(*)) AS BIGINT) AS weight FROM grams JOIN hashed USING (feature) JOIN gains USING (bucket) WHERE own GROUP BY row_no
), scored AS (
    SELECT w.row_no, doc_id, len(words) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
        coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || left(sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')), 8) AS BIGINT) + 0.5) / CAST(4294967296 AS DOUBLE)))) AS BIGINT) AS score
    FROM worded w LEFT JOIN weights g ON g.row_no = w.row_no WHERE own
), placed AS (
    SELECT row_no, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS place, count(*) OVER () * 25 // 100 AS drawn FROM scored WHERE n_words >= 20
)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= drawn THEN place END AS rank FROM scored LEFT JOIN placed USING (row_no)
"""
