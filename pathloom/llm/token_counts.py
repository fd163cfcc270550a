"""Edit-aware token counts: a segment tree of pre-token runs per document.

A document's leaves are runs of about LEAF_WORDS words, cut at plain spaces that no pre-token can cross, so the counts
of leaves add up to the count of the text. The tree holds characters and tokens of each leaf and their subtree sums. An
edit finds the leaves that it touches by descending the character sums; these leaves and one more on each side (the
boundary context) are cut and encoded anew, everything else keeps its counts, and the sums above are updated. A leaf
that has grown to SPLIT_AT times its size makes the tree be laid out anew, without encoding.

Trees are small rows (characters and tokens per leaf, no text), so they can be stored and taken up again.

Defined results: null text is empty text with no tokens; edits beyond the text's end are clipped to it; edits apply in
order, each on the text that the former left.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Cache, gives_back, id_and_text, words_after_spaces

LEAF_WORDS, SPLIT_AT = 64, 8
TREE = "leaf_chars array<int>, leaf_tokens array<int>"


class Counter:
    """Token counts of texts through a cache of words."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in file if line.strip())}
        encode = tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.encode = encode
        self.words = Cache(lambda word: len(encode(" " + word)))

    def leaves(self, text: str, inside: bool = False) -> tuple[list[int], list[int]]:
        """Characters and tokens of each leaf; inside: the text follows other text at a safe cut (and so begins with a space)."""
        if not text:
            return [], []
        self.words.age()
        known, miss = self.words.young, self.words.miss
        parts = words_after_spaces(text[1:] if inside else text)
        chars, tokens = [], []
        for at in range(0, len(parts), LEAF_WORDS):
            run = parts[at : at + LEAF_WORDS]
            counts = [known[w] if w in known else miss(w) for w in run[not (at or inside) :]]
            chars.append(sum(map(len, run)) + len(run) - (not (at or inside)))
            tokens.append(sum(counts) + (0 if at or inside else len(self.encode(run[0]))))
        return chars, tokens


_COUNTERS: dict[tuple[str, str], Counter] = {}


def counter(path: str, pattern: str) -> Counter:
    held = _COUNTERS.get((path, pattern))
    if held is None:
        held = _COUNTERS[path, pattern] = Counter(path, pattern)
    return held


class SegmentTree:
    """Characters and tokens of leaves with subtree sums, and the text that they describe."""

    def __init__(self, text: str, chars: list[int], tokens: list[int], count: Counter):
        self.text, self.count, self.encoded = text, count, 0
        self._lay_out(chars, tokens)

    def _lay_out(self, chars: list[int], tokens: list[int]) -> None:
        size = 1
        while size < max(1, len(chars)):
            size *= 2
        self.size, self.used = size, len(chars)
        self.chars = [0] * size + chars + [0] * (size - len(chars))
        self.tokens = [0] * size + tokens + [0] * (size - len(tokens))
        for k in range(size - 1, 0, -1):
            self.chars[k] = self.chars[2 * k] + self.chars[2 * k + 1]
            self.tokens[k] = self.tokens[2 * k] + self.tokens[2 * k + 1]

    @property
    def total(self) -> int:
        return self.tokens[1]

    def _leaf_at(self, position: int) -> tuple[int, int]:
        """The leaf that holds a character (the last one for the end), and where it starts."""
        k, start = 1, 0
        while k < self.size:
            k *= 2
            if position >= start + self.chars[k] and self.chars[k + 1]:
                start += self.chars[k]
                k += 1
        return k - self.size, start

    def _set(self, leaf: int, chars: int, tokens: int) -> None:
        k = leaf + self.size
        more, extra = chars - self.chars[k], tokens - self.tokens[k]
        while k:
            self.chars[k] += more
            self.tokens[k] += extra
            k //= 2

    def edit(self, start: int, stop: int, new: str) -> None:
        """Replaces text[start:stop]; encodes the touched leaves and their neighbours only."""
        n = len(self.text)
        start = max(0, min(start, n))
        stop = max(start, min(stop, n))
        first, at = self._leaf_at(start)
        last, end = self._leaf_at(max(start, stop - 1))
        end += self.chars[last + self.size]
        k = first - 1  # the boundary context: the next leaf with text on each side
        while k >= 0 and not self.chars[k + self.size]:
            k -= 1
        if k >= 0:
            first, at = k, at - self.chars[k + self.size]
        k = last + 1
        while k < self.used and not self.chars[k + self.size]:
            k += 1
        if k < self.used:
            last, end = k, end + self.chars[k + self.size]
        region = self.text[at:start] + new + self.text[stop:end]
        self.text = self.text[:start] + new + self.text[stop:]
        chars, tokens = self.count.leaves(region, inside=at > 0)
        self.encoded += len(region)
        slots = last - first + 1
        if len(chars) > slots * SPLIT_AT or not self.used:
            held_chars, held_tokens = self.leaves()
            self._lay_out(held_chars[:first] + chars + held_chars[last + 1 :], held_tokens[:first] + tokens + held_tokens[last + 1 :])
            return
        each = -(-len(chars) // slots) if chars else 1
        for slot in range(slots):
            part = slice(slot * each, (slot + 1) * each)
            self._set(first + slot, sum(chars[part]), sum(tokens[part]))

    def leaves(self) -> tuple[list[int], list[int]]:
        return self.chars[self.size : self.size + self.used], self.tokens[self.size : self.size + self.used]


def build_trees(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens and the leaves of every whole text."""

    @gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path, pattern)
        for batch in batches:
            leaves = [count.leaves(t.as_py()) for t in batch.column("text")]
            arrays = [pa.array([sum(x[1]) for x in leaves], pa.int64()), *(pa.array([x[k] for x in leaves], pa.list_(pa.int32())) for k in (0, 1))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays], ["doc_id", "n_tokens", "leaf_chars", "leaf_tokens"])

    return id_and_text(docs).mapInArrow(run, f"doc_id long, n_tokens long, {TREE}")


def recount(docs: DataFrame, trees: DataFrame, edits: DataFrame, path: str, pattern: str) -> DataFrame:
    """Applies edits (doc_id, seq, start, stop, new) to the texts that the trees describe; one row per edited document.

    Returns doc_id, the new text, n_tokens, encoded (characters encoded anew) and the new leaves."""
    listed = edits.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("seq", "start", "stop", "new"))).alias("edits"))
    rows = id_and_text(docs).join(trees.select("doc_id", "leaf_chars", "leaf_tokens"), "doc_id").join(listed, "doc_id")

    @gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path, pattern)
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                tree = SegmentTree(row["text"], row["leaf_chars"], row["leaf_tokens"], count)
                for e in row["edits"]:
                    tree.edit(e["start"], e["stop"], e["new"] or "")
                out.append((row["doc_id"], tree.text, tree.total, tree.encoded, *tree.leaves()))
            columns = list(zip(*out)) or [()] * 6
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "text", "n_tokens", "encoded", "leaf_chars", "leaf_tokens"])

    return rows.mapInArrow(run, f"doc_id long, text string, n_tokens long, encoded long, {TREE}")


def revision(text: str) -> list[tuple[int, int, str]]:
    """Three edits that follow from a text: a replacement, a deletion and an insertion."""
    if not text:
        return [(0, 0, "first words")]
    mark, n = zlib.crc32(text.encode()), len(text)
    return [(mark % n, mark % n + 5, "Revised"), ((mark >> 7) % n, (mark >> 7) % n + 12, ""), ((mark >> 13) % n, (mark >> 13) % n, " and 42 more words,")]


def counts_and_recounts(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Tokens of every whole text, and of its revision() counted through the tree, with what had to be encoded anew."""

    @gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path, pattern)
        for batch in batches:
            out = []
            for text in batch.column("text"):
                text = text.as_py()
                tree = SegmentTree(text, *count.leaves(text), count)
                before, leaves = tree.total, tree.used
                for edit in revision(text):
                    tree.edit(*edit)
                out.append((len(text), before, leaves, len(tree.text), tree.total, tree.encoded))
            columns = list(zip(*out)) or [()] * 6
            names = ["n_chars", "n_tokens", "n_leaves", "edited_chars", "edited_tokens", "encoded_chars"]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in columns)], ["doc_id", *names])

    return id_and_text(docs).mapInArrow(run, "doc_id long, n_chars long, n_tokens long, n_leaves long, edited_chars long, edited_tokens long, encoded_chars long")
