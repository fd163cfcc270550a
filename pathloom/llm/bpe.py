"""Byte-level BPE with a hierarchical-bitmap rank queue.

The queue of candidate merges is an array of buckets, one for each merge rank; a bucket holds positions in the
linked list of tokens. Three levels of 64-bit words mark the buckets that are not empty: find-first-set on each level
gives the smallest rank in three steps, whatever the number of candidates, so a pre-token of n bytes costs O(n)
queue steps (a bucket keeps its positions in a heap for the leftmost-first rule). Entries whose pair has changed since
are skipped when they surface.

Vocabulary: a file of base64 token and rank per line (path is a parameter; it must be readable on every executor).
Text is split by the public pattern of such vocabularies; words between plain spaces are cached per worker.

Defined results: null text is empty text; empty text has no ids; equal rows give equal results.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from heapq import heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from ._common import Cache, WHITE_SPACE, gives_back, id_and_text, words_after_spaces


class RankQueue:
    """Merge candidates by rank: three bitmap levels over buckets of list positions; empty between two pieces.

    merge() works on its parts directly, as a call for each push and pop would cost more than the work itself."""

    __slots__ = ("buckets", "low", "mid")

    def __init__(self, ranks: int):
        self.low = [0] * ((ranks >> 6) + 1)
        self.mid = [0] * ((ranks >> 12) + 1)
        self.buckets: dict[int, list[int]] = {}


class Codec:
    """Encoder and decoder for one vocabulary."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.tokens = {v: k for k, v in ranks.items()}
        self.queue = RankQueue(max(ranks.values(), default=0) + 1)
        outside = f"[^{WHITE_SPACE}]"
        explicit = pattern.replace("[^\\s", f"[^{WHITE_SPACE}").replace("\\S", outside).replace("\\s", f"[{WHITE_SPACE}]")
        self.split = regex.compile(explicit).findall
        self.pieces = Cache(lambda piece: tuple(self.merge(piece.encode())))
        self.words = Cache(self._word)

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token."""
        ranks = self.ranks
        whole = ranks.get(piece)
        if whole is not None:
            return [whole]
        n, get = len(piece), ranks.get
        buckets, low, mid, top = self.queue.buckets, self.queue.low, self.queue.mid, 0
        after, before, current = list(range(1, n + 2)), list(range(-1, n)), [-1] * (n + 1)
        for i in range(n - 1):
            rank = get(piece[i : i + 2])
            if rank is not None:
                current[i] = rank
                if rank in buckets:
                    buckets[rank].append(i)  # positions grow here, so the heap stays one
                else:
                    buckets[rank] = [i]
                    word = rank >> 6
                    low[word] |= 1 << (rank & 63)
                    mid[word >> 6] |= 1 << (word & 63)
                    top |= 1 << (word >> 6)
        while top:
            # find first set on each level: the least rank, and its leftmost position
            a = (top & -top).bit_length() - 1
            bits = mid[a]
            word = (a << 6) | ((bits & -bits).bit_length() - 1)
            bits = low[word]
            rank = (word << 6) | ((bits & -bits).bit_length() - 1)
            bucket = buckets[rank]
            if len(bucket) > 1:
                i = heappop(bucket)
            else:
                i = bucket[0]
                del buckets[rank]
                low[word] = bits = bits & (bits - 1)
                if not bits:
                    mid[a] &= mid[a] - 1
                    if not mid[a]:
                        top &= top - 1
            if current[i] != rank:
                continue  # stale: the pair that began here has changed
            j = after[i]
            k = after[j]
            after[i] = k
            current[j] = current[i] = -1
            if k < n:
                before[k] = i
                found = get(piece[i : after[k]])
                if found is not None:
                    current[i] = found
                    if found in buckets:
                        heappush(buckets[found], i)
                    else:
                        buckets[found] = [i]
                        word = found >> 6
                        low[word] |= 1 << (found & 63)
                        mid[word >> 6] |= 1 << (word & 63)
                        top |= 1 << (word >> 6)
            p = before[i]
            if p >= 0:
                found = get(piece[p:k])
                if found is None:
                    current[p] = -1
                else:
                    current[p] = found
                    if found in buckets:
                        heappush(buckets[found], p)
                    else:
                        buckets[found] = [p]
                        word = found >> 6
                        low[word] |= 1 << (found & 63)
                        mid[word >> 6] |= 1 << (word & 63)
                        top |= 1 << (word >> 6)
        ids, i = [], 0
        while i < n:
            ids.append(ranks[piece[i : after[i]]])
            i = after[i]
        return ids

    def encode(self, text: str) -> list[int]:
        ids: list[int] = []
        self.pieces.age()
        known, miss = self.pieces.young.get, self.pieces.miss
        for piece in self.split(text):
            ids += known(piece) or miss(piece)
        return ids

    def decode(self, ids) -> bytes:
        tokens = self.tokens
        return b"".join([tokens[i] for i in ids])

    def _word(self, word: str) -> tuple[bytes, bytes]:
        """The ids of " " + word in decimal, and what they decode to."""
        ids = self.encode(" " + word)
        return ",".join(map(str, ids)).encode(), self.decode(ids)

    def written(self, text: str) -> tuple[bytes, bytes]:
        """Decimal ids of a whole text joined by commas, and the bytes that they decode to."""
        if not text:
            return b"", b""
        parts = words_after_spaces(text)
        first = self.encode(parts[0])
        self.words.age()
        known, miss = self.words.young.get, self.words.miss
        entries = [known(w) or miss(w) for w in parts[1:]]
        entries.insert(0, (",".join(map(str, first)).encode(), self.decode(first)))
        if not first:
            entries.pop(0)
        return b",".join([e[0] for e in entries]), b"".join([e[1] for e in entries])


_CODECS: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """The codec of a vocabulary file, loaded once in a process."""
    held = _CODECS.get((path, pattern))
    if held is None:
        with open(path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in file if line.strip())}
        held = _CODECS[path, pattern] = Codec(ranks, pattern)
    return held


def encode_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and ids (array of int) of every whole text."""

    @gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            ids = [own.encode(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return id_and_text(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and text of every row of ids; bytes that are not UTF-8 become replacement characters."""

    @gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            texts = [own.decode(x or ()).decode("utf-8", "replace") for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip_digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Encodes every whole text, decodes the ids and returns digests of both; one pass without a shuffle."""

    @gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        sha = hashlib.sha256
        for batch in batches:
            counts, ids, decoded = [], [], []
            for text in batch.column("text"):
                written, back = own.written(text.as_py())
                counts.append(written.count(b",") + 1 if written else 0)
                ids.append(sha(written).hexdigest())
                decoded.append(sha(back).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return id_and_text(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
