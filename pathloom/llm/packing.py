"""Hierarchical multi-length packing of token sequences.

Every task tokenises its own documents and packs them at once, so no text or token is shuffled; a retried task gives
the same rows, as ids come from the partition number and the order of rows in it. A document longer than the longest
tier is cut into full windows; what is left of it goes to the smallest tier (power of two) that holds it. Tiers are
packed from the longest: each remainder opens a window of its tier and the gap is filled from shorter tiers, whole
documents by best fit first, then a cut of the shortest one waiting. A window that nothing is left to fill is cut into
windows of lower tiers, and fewer tokens than the lowest tier wait for the next chunk; at a partition's end they
become windows of smaller powers of two. So no sequence is padded. Sequences of a tier are dealt to step groups of the
same number of tokens; where a partition's sequences fill no whole number of groups, its last HELD_GROUPS groups of a
tier share the lack evenly.

Defined results: null or empty text has only the end id; equal rows are packed one by one.
"""

from __future__ import annotations

import os
import re
import zlib
from bisect import bisect_right, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame

from ._common import gives_back, id_and_text

#: ASCII marks that form one pre-token when they end a word (the apostrophe may begin another), and the
#: letters under U+0250 as a regex class body, without U+0130, whose lower case is two characters.
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
LETTERS = "A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f"
SIMPLE = f"^[{LETTERS}]+[{re.escape(MARKS)}]*$"
END_ID = 1
WORD_END = "</w>"
#: Words that go to the tokenizer as one string, and bytes of text whose words are told apart at once.
JOINED_WORDS, CHUNK_BYTES = 4096, 4 << 20
#: Full step groups of a tier that are held back, so that the last ones differ by one sequence and are nearly full.
HELD_GROUPS = 8
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long"


def gathered(pool: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The ranges pool[start : start + count], one after the other."""
    ends = np.cumsum(counts)
    total = int(ends[-1]) if len(ends) else 0
    return pool[np.arange(total) + np.repeat(starts - (ends - counts), counts)]


class WordIds:
    """Ids of texts. Each distinct word of a chunk of texts is encoded once; nothing is kept from chunk to chunk.

    The tokenizer lower-cases, drops white space, and splits letters from other characters, so words between spaces
    stand alone, and so do Latin letters and the ASCII marks that follow them. Every other word (special tokens
    among them) goes to the tokenizer as it is."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        #: The same vocabulary for words of lower-case Latin letters between spaces, which need no normalising.
        self.letters = Tokenizer.from_file(path)
        self.letters.normalizer = normalizers.Sequence([])
        self.letters.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.tokenizer.get_vocab()
        self.is_end = np.zeros(max(vocabulary.values()) + 1, bool)
        self.is_end[[k for token, k in vocabulary.items() if token.endswith(WORD_END)]] = True

    def of_letters(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of lower-case letters, and how many each has: a word's last id is the one that ends in WORD_END."""
        parts = [np.empty(0, np.uint32)]
        for at in range(0, len(words), JOINED_WORDS):
            parts.append(np.array(self.letters.encode_batch_fast([" ".join(words[at : at + JOINED_WORDS])], add_special_tokens=False)[0].ids, np.uint32))
        ids = np.concatenate(parts)
        return ids, np.diff(np.flatnonzero(self.is_end[ids]), prepend=-1)

    def of_any(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        parts, counts = [np.empty(0, np.uint32)], []
        for at in range(0, len(words), JOINED_WORDS):
            for e in self.tokenizer.encode_batch_fast(words[at : at + JOINED_WORDS], add_special_tokens=False):
                parts.append(np.array(e.ids, np.uint32))
                counts.append(len(parts[-1]))
        return np.concatenate(parts), np.array(counts, np.int64)

    def of_distinct(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words, one word after the other, and how many each has."""
        simple = pc.match_substring_regex(words, SIMPLE)
        plain, chosen = words.filter(simple), simple.to_numpy(zero_copy_only=False)
        stems = pc.utf8_rtrim(pc.utf8_lower(plain), MARKS).dictionary_encode()
        marks = pc.replace_substring_regex(plain, f"^[{LETTERS}]+", "").dictionary_encode()
        other = words.filter(pc.invert(simple)).to_pylist()
        found = [self.of_letters(stems.dictionary.to_pylist()), self.of_any(other + marks.dictionary.to_pylist())]
        pool, counts = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
        starts = np.cumsum(counts) - counts
        # two ranges for each word: stem and marks, or the word and nothing
        first, second = np.empty(len(words), np.int64), np.full(len(words), -1)
        first[chosen] = stems.indices.to_numpy()
        first[~chosen] = len(stems.dictionary) + np.arange(len(other))
        second[chosen] = len(stems.dictionary) + len(other) + marks.indices.to_numpy()
        both = np.stack([first, second], axis=1).ravel()
        sizes = np.where(both >= 0, counts[both], 0)
        return gathered(pool, starts[both], sizes), sizes.reshape(-1, 2).sum(axis=1)

    def of(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text, the end id last."""
        words = pc.split_pattern(pc.replace_substring(texts.cast(pa.large_string()), "\n", " "), " ")
        coded = words.flatten().dictionary_encode()
        pool, counts = self.of_distinct(coded.dictionary)
        starts, number = np.cumsum(counts) - counts, coded.indices.to_numpy()
        sizes = counts[number]
        ids = gathered(pool, starts[number], sizes)
        edges = np.r_[0, np.cumsum(sizes)][words.offsets.to_numpy() - words.offsets[0].as_py()]
        return [np.append(ids[a:b], np.uint32(END_ID)) for a, b in zip(edges[:-1], edges[1:])]


def chunks(batches: Iterator[pa.RecordBatch], most: int = CHUNK_BYTES) -> Iterator[pa.Table]:
    """The rows in order, in tables of about `most` bytes of text (one longer text is a table of its own)."""
    held, size = [], 0
    for batch in batches:
        sizes = np.cumsum(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            before = int(sizes[at - 1]) if at else 0
            end = max(at + 1, int(np.searchsorted(sizes, before + most - size, "right"))) if size < most else at
            held.append(batch.slice(at, end - at))
            size += int(sizes[end - 1]) - before if end > at else 0
            at = end
            if size >= most or at < batch.num_rows:
                yield pa.Table.from_batches(held).combine_chunks()
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


class TierPacker:
    """Packs (document, start, ids) pieces; emits rows of SCHEMA and the ids of each piece."""

    def __init__(self, partition: int, longest: int, shortest: int, group_tokens: int):
        self.base, self.longest, self.shortest = partition << 36, longest, shortest
        self.group_tokens = group_tokens
        self.sequences = 0
        self.groups: dict[int, int] = defaultdict(int)
        self.open: dict[int, list[list[tuple]]] = defaultdict(list)  # sequences without a step group, by tier
        self.rows: list[tuple] = []
        self.waiting: list[tuple] = []  # pieces of fewer tokens than the lowest tier

    def emit(self, pieces: list[tuple], tier: int) -> None:
        offset, number, rows = 0, self.base + self.sequences, []
        for doc, total, start, ids in pieces:
            rows.append((doc, start, len(ids) >> 2, zlib.crc32(ids), total, number, offset, tier, ids))
            offset += len(ids) >> 2
        self.sequences += 1
        self.open[tier].append(rows)
        most = max(1, self.group_tokens // tier)
        if len(self.open[tier]) > (HELD_GROUPS + 1) * most:
            self.close(tier, most)

    def close(self, tier: int, sequences: int) -> None:
        """The longest waiting sequences of a tier become a step group."""
        group = (tier.bit_length() << 56) + self.base + self.groups[tier]
        self.groups[tier] += 1
        self.rows += [(*row[:8], group, row[8]) for rows in self.open[tier][:sequences] for row in rows]
        del self.open[tier][:sequences]

    def pack(self, docs: list[tuple[int, bytes]]) -> None:
        """One chunk of documents; what cannot fill the lowest tier waits."""
        longest, step = self.longest, self.longest * 4
        pool: dict[int, list[tuple]] = defaultdict(list)  # by length
        lengths: list[int] = []

        def put(piece: tuple) -> None:
            n = len(piece[3]) >> 2
            if not pool[n]:
                insort(lengths, n)
            pool[n].append(piece)

        def take(n: int) -> tuple:
            piece = pool[n].pop()
            if not pool[n]:
                lengths.remove(n)
            return piece

        for piece in self.waiting:
            put(piece)
        self.waiting = []
        for doc, ids in docs:
            total = len(ids) >> 2
            full = total // longest
            for k in range(full):
                self.emit([(doc, total, k * longest, ids[k * step : (k + 1) * step])], longest)
            if total % longest:
                put((doc, total, full * longest, ids[full * step :]))
        tier = longest
        while tier >= self.shortest:
            while lengths and lengths[-1] > (tier // 2 if tier > self.shortest else 0):
                window = [take(lengths[-1])]
                gap = tier - (len(window[0][3]) >> 2)
                while gap and lengths:
                    at = bisect_right(lengths, gap)
                    if at:
                        window.append(take(lengths[at - 1]))
                        gap -= len(window[-1][3]) >> 2
                    else:
                        doc, total, start, ids = take(lengths[0])
                        window.append((doc, total, start, ids[: gap * 4]))
                        put((doc, total, start + gap, ids[gap * 4 :]))
                        gap = 0
                if gap:
                    self.waiting = self.split(window, self.shortest)
                else:
                    self.emit(window, tier)
            tier //= 2

    def split(self, pieces: list[tuple], least: int) -> list[tuple]:
        """Cuts pieces into full windows of powers of two from `least` up; returns the rest."""
        total = sum(len(p[3]) >> 2 for p in pieces)
        size = self.longest
        while size >= least:
            if total >= size:
                window, need = [], size
                while need:
                    doc, whole, start, ids = pieces.pop(0)
                    n = len(ids) >> 2
                    if n > need:
                        pieces.insert(0, (doc, whole, start + need, ids[need * 4 :]))
                        ids, n = ids[: need * 4], need
                    window.append((doc, whole, start, ids))
                    need -= n
                self.emit(window, size)
                total -= size
            else:
                size //= 2
        return pieces

    def finish(self) -> None:
        """What waits becomes windows; the last step groups of each tier are dealt evenly."""
        self.split(self.waiting, 1)
        self.waiting = []
        for tier, held in self.open.items():
            for left in range(-(-len(held) // max(1, self.group_tokens // tier)), 0, -1):
                self.close(tier, -(-len(held) // left))

    def drain(self) -> list[tuple]:
        rows, self.rows = self.rows, []
        return rows


def pack_documents(
    docs: DataFrame, tokenizer_path: str, longest: int = 2048, shortest: int = 64, group_tokens: int = 16384, chunk_tokens: int = 1_000_000, with_ids: bool = False
) -> DataFrame:
    """One row for each piece of each document (columns of SCHEMA; with_ids adds the piece's ids).

    longest and shortest are powers of two; chunk_tokens bounds what a task holds."""

    @gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordIds(tokenizer_path)
        context = TaskContext.get()
        packer = TierPacker(context.partitionId() if context else 0, longest, shortest, group_tokens)

        def out() -> pa.RecordBatch:
            columns = list(zip(*packer.drain())) or [()] * 10
            arrays = [pa.array(c, pa.int32() if k == 7 else pa.int64()) for k, c in enumerate(columns[:9])]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", "step_group"]
            if with_ids:
                import numpy as np

                arrays.append(pa.array([np.frombuffer(x, "<u4").astype("int32") for x in columns[9]], pa.list_(pa.int32())))
                names.append("ids")
            return pa.RecordBatch.from_arrays(arrays, names)

        held, tokens = [], 0
        for part in chunks(batches):
            for doc, ids in zip(part.column("doc_id").to_pylist(), words.of(part.column("text").chunk(0))):
                held.append((doc, ids.tobytes()))
                tokens += len(ids)
            if tokens >= chunk_tokens:
                packer.pack(held)
                held, tokens = [], 0
                yield out()
        packer.pack(held)
        packer.finish()
        yield out()

    return id_and_text(docs).mapInArrow(run, SCHEMA + (", ids array<int>" if with_ids else ""))
