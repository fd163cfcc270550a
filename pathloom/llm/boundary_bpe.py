"""BPE encoding and decoding with forced boundaries.

Two bytes that stand next to each other in no token of the vocabulary can never be merged across: between them lies a certain
cut, whatever the merges around it do. A pre-token is cut at all such places, each fragment is encoded alone (only the
last one carries the word's end), and the ids are put side by side. Each distinct word of a chunk of texts is looked at once;
bounded caches keep short pre-tokens and fragments from chunk to chunk.

The vocabulary is a file of the tokenizers library, with an end-of-word suffix and a byte alphabet; the library's own
normaliser and pattern turn a word into pre-tokens, the cuts and merges are done here. Words between spaces and line ends
stand alone for them (no pattern reaches over white space, and no character composes with a space). Special tokens of the
file are found in the raw text first, as the library does. Decoding joins tokens by spaces, as a file without a decoder does.

How it scales: one pass without a shuffle; a task holds a chunk of texts and its distinct words. A long pre-token is merged with a
heap, in n log n steps.

Defined results: null text is empty text; empty text and white space have no ids; equal rows give equal results.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from ._common import Cache, gives_back, id_and_text
from .packing import WordIds, chunks, gathered

#: Bytes of text whose distinct words are told apart at once.
CHUNK_BYTES = 4 << 20
#: Pre-tokens that a generation of a worker's cache may hold; a quarter as many fragments of those that are cut.
KEPT = 300_000
#: Ids of a fragment up to which all its pairs are looked through for the least rank; longer ones use a heap.
SHORT, NO_MERGE = 40, (1 << 62, -1)


def byte_alphabet() -> list[str]:
    """The character that stands for each byte: printable ones stand for themselves, the others follow from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class BoundaryCodec(WordIds):
    """Encoder and decoder for one vocabulary file. How a chunk's distinct words are told apart is inherited, how they become ids is not."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            held = json.load(file)
        model = held["model"]
        added = held["added_tokens"]
        if model["type"] != "BPE" or held["decoder"] or not (held["normalizer"] and held["pre_tokenizer"] and model["end_of_word_suffix"]) or any(re.search(r"\s", t["content"]) or t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in added):
            raise ValueError(f"not a BPE file with word ends, without decoder and with plain special tokens: {path}")
        tokenizer = Tokenizer.from_file(path)
        self.normalise, self.pre_tokenise = tokenizer.normalizer.normalize_str, tokenizer.pre_tokenizer.pre_tokenize_str
        self.special = {t["content"]: t["id"] for t in added}
        self.special_split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else None
        vocabulary: dict[str, int] = model["vocab"]
        self.end = model["end_of_word_suffix"]
        self.tokens = {k: t for t, k in vocabulary.items()} | {k: t for t, k in self.special.items()}
        #: For each pair of ids that merges: rank and id of what it becomes.
        self.merges = {(vocabulary[a], vocabulary[b]): (rank, vocabulary[a + b]) for rank, (a, b) in enumerate(model["merges"])}
        self.first_ids = {c: vocabulary[c] for c in byte_alphabet()}
        self.last_ids = {c: vocabulary[c + self.end] for c in byte_alphabet()}
        #: All pairs of neighbouring bytes (in the alphabet) inside tokens: each is the seam of the merge that made the token, or lies in one of its parts.
        self.joint = {a[-1] + b[0] for a, b in model["merges"]}
        self.fragments = Cache(lambda key: tuple(self.merge(key)), KEPT // 4)
        self.pieces = Cache(self.encode_piece, KEPT)
        self.alphabet = {chr(b): c for b, c in enumerate(byte_alphabet())}
        #: Decimal id and token of each id, with the space that joins them.
        places = range(max(self.tokens) + 1)
        self.decimals, self.written = (pa.array(x, pa.large_binary()) for x in ([b"%d " % k for k in places], [f"{self.tokens.get(k, '')} ".encode() for k in places]))

    def fragments_of(self, piece: str) -> list[str]:
        """A pre-token (of characters of the alphabet) cut at its forced boundaries; the end of the word goes with the last fragment."""
        joint = self.joint
        cuts = [k for k, (a, b) in enumerate(zip(piece, piece[1:]), 1) if a + b not in joint]
        piece += "\n"  # no character of the alphabet: marks the word's end
        return [piece[a:b] for a, b in zip([0, *cuts], [*cuts, len(piece)])]

    def encode_piece(self, piece: str) -> tuple[int, ...]:
        parts = self.fragments_of(piece)
        if len(parts) == 1:
            return tuple(self.merge(parts[0]))
        known, miss = self.fragments.young.get, self.fragments.miss
        return tuple([i for fragment in parts for i in known(fragment) or miss(fragment)])

    def merge(self, fragment: str) -> list[int]:
        """Ids of one fragment: the pair of the least rank, the leftmost first, becomes one token until none is left."""
        if fragment.endswith("\n"):
            ids = [self.first_ids[c] for c in fragment[:-2]] + [self.last_ids[fragment[-2]]]
        else:
            ids = [self.first_ids[c] for c in fragment]
        get, n = self.merges.get, len(ids)
        if n <= SHORT:
            return self.merge_short(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [(found[0], i, found[1], ids[i], ids[i + 1]) for i in range(n - 1) if (found := get((ids[i], ids[i + 1])))]
        heapify(queue)
        while queue:
            _, i, new, a, b = heappop(queue)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue  # the pair that began here has changed
            ids[i], ids[j] = new, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if found := get((new, ids[k])):
                    heappush(queue, (found[0], i, found[1], new, ids[k]))
            p = before[i]
            if p >= 0 and (found := get((ids[p], new))):
                heappush(queue, (found[0], p, found[1], ids[p], new))
        return [x for x in ids if x >= 0]

    def merge_short(self, ids: list[int]) -> list[int]:
        """The same for few ids, whose pairs are looked through each time."""
        get = self.merges.get
        pairs = [get(pair, NO_MERGE) for pair in zip(ids, ids[1:])]
        while pairs:
            least = min(pairs)
            if least is NO_MERGE:
                break
            at = pairs.index(least)
            ids[at : at + 2] = [least[1]]
            del pairs[at]
            if at:
                pairs[at - 1] = get((ids[at - 1], ids[at]), NO_MERGE)
            if at < len(pairs):
                pairs[at] = get((ids[at], ids[at + 1]), NO_MERGE)
        return ids

    def encode_plain(self, text: str) -> list[int]:
        """Ids of a text that is taken to hold no special token."""
        known, miss = self.pieces.young.get, self.pieces.miss
        return [i for piece, _ in self.pre_tokenise(self.normalise(text)) for i in known(piece) or miss(piece)]

    def encode(self, text: str) -> list[int]:
        """Ids of a whole text."""
        self.age()
        if self.special_split is None or not any(t in text for t in self.special):
            return self.encode_plain(text)
        ids: list[int] = []
        for part in self.special_split(text):
            ids += [self.special[part]] if part in self.special else self.encode_plain(part)
        return ids

    def age(self) -> None:
        self.fragments.age()
        self.pieces.age()

    def of_letters(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        known, miss, alphabet = self.pieces.young.get, self.pieces.miss, self.alphabet
        pieces = [w if w.isascii() else "".join([alphabet[chr(b)] for b in w.encode()]) for w in words]
        return _laid([known(p) or miss(p) for p in pieces])

    def of_any(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return _laid([self.encode(w) for w in words])

    def decode(self, ids) -> str:
        tokens = self.tokens
        return " ".join([tokens[i] for i in ids])

    def ids_of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of a chunk's texts one after the other, and where each text begins among them (one more entry for the end)."""
        self.age()
        parts = pc.split_pattern(pc.replace_substring(texts.cast(pa.large_string()), "\n", " "), " ")
        coded = parts.flatten().dictionary_encode()
        pool, counts = self.of_distinct(coded.dictionary)
        number = coded.indices.to_numpy()
        sizes = counts[number]
        edges = np.r_[0, np.cumsum(sizes)][parts.offsets.to_numpy() - parts.offsets[0].as_py()]
        return gathered(pool, (np.cumsum(counts) - counts)[number], sizes), edges


def _laid(found: list) -> tuple[np.ndarray, np.ndarray]:
    """All ids one after the other, and how many each entry has."""
    return np.fromiter(chain.from_iterable(found), np.uint32), np.fromiter(map(len, found), np.int64, len(found))


_CODECS: dict[str, BoundaryCodec] = {}


def codec(path: str) -> BoundaryCodec:
    """The codec of a vocabulary file, loaded once in a process."""
    held = _CODECS.get(path)
    if held is None:
        held = _CODECS[path] = BoundaryCodec(path)
    return held


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and ids (array of int) of every whole text."""

    @gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for part in chunks(batches, CHUNK_BYTES):
            found, edges = own.ids_of(part.column("text").chunk(0))
            ids = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(found.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([part.column("doc_id").chunk(0), ids], ["doc_id", "ids"])

    return id_and_text(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and text of every row of ids."""

    @gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            texts = [own.decode(x or ()) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def _digests(entries: pa.Array, ids: np.ndarray, edges: np.ndarray) -> list[str]:
    """Digest of the entries of each text's ids one after the other, without the space at the end."""
    _, offsets, data = entries.take(pa.array(ids)).buffers()
    ends, view = np.frombuffer(offsets, np.int64)[edges], memoryview(data) if data is not None else memoryview(b"")
    return [hashlib.sha256(view[a : b - 1 if b > a else b]).hexdigest() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]


def round_trip_digests(docs: DataFrame, path: str) -> DataFrame:
    """Encodes every whole text, decodes the ids and returns digests of both."""

    @gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for part in chunks(batches, CHUNK_BYTES):
            ids, edges = own.ids_of(part.column("text").chunk(0))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id").chunk(0), pa.array(np.diff(edges), pa.int64()), pa.array(_digests(own.decimals, ids, edges)), pa.array(_digests(own.written, ids, edges))],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return id_and_text(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
