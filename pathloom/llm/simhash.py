"""SimHash near-duplicates: fingerprints, exact Hamming links by vantage-point trees, and their components.

1. A fingerprint per document (word shingles, XXH64 with a fixed seed); equal fingerprints collapse to one row.
2. Shards: a vantage-point split of random 64-bit codes overlaps three quarters of its shard at each level (distances
   crowd around 32, radius 4), so shards are cut by the pigeonhole principle first: of `blocks` bit blocks at least
   blocks - 4 are equal in a linked pair, and each choice of equal blocks is a shard key. Pairs can only meet in such
   a shard, so this is exact. A shard of more than CHUNK rows is dealt once more by the bits that its key leaves open, on
   the same principle; what is still hot then is split into chunks, and each pair of chunks is a unit of its own.
3. In a unit a vantage-point tree is searched for all members at once; branches are pruned by triangle bounds. A unit
   returns a spanning star for each of its groups (at most as many links as members), never all pairs.
4. Components: least label and pointer jumping, with a reliable checkpoint after each round.

Copies at a similarity of 0.8 (one_of_each) are too far apart for 4 of 64 bits: at a Jaccard similarity of 0.8 on five
words fingerprints differ by 15 % of their bits, while texts ruled by one repeated line are close in them without being
copies. So links of fingerprints only propose pairs there, over all distinct texts more are proposed by least
hashes of the distinct five-word shingles (a pair at 0.8 shares none of BANDS keys six times in ten million) and accepts
a pair by counting its two sets of shingles. Proposals that reach each other are one unit (pairs of chunks when it is
large), so a set of shingles travels once, not once per key.

Defined results: null and empty text have fingerprint zero and are linked like any other; equal rows share a component.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import cut, gives_back, id_and_text, whole_rows

SEED = 42
CHUNK = 1024
#: Blocks into which the open bits of a hot shard are cut; two of them are equal in a pair that links.
FINER_BLOCKS = 6
#: Small tables (numbers only, under 100 bytes a row) are broadcast up to this many rows, counted before; larger ones are joined by a shuffle.
BROADCAST_ROWS = 200_000
LEAF = 48
#: Bit blocks and how many of them are equal in a pair at distance 4 or less.
SCHEMES = ((5, 1), (6, 2), (7, 3), (8, 4))
SHARD_ROWS = 4096
#: Copies of one_of_each: words of a shingle, keys of a text and least hashes in a key.
WIDE_WORDS, BANDS, LEAST_HASHES = 5, 20, 3
#: Shingles that weigh as much as one row in the size of a chunk; a chunk holds about a million of them.
ROW_SHINGLES = 1024
_ODD = np.random.default_rng(20240301).integers(0, 2**63, BANDS * LEAST_HASHES, np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_hashes(text: str, width: int) -> list[int]:
    """XXH64 of every shingle; a text of fewer words is one shingle."""
    words = text.encode().lower().split()  # bytes: only A-Z change, only ASCII white space splits
    if not words:
        return []
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        return [digest(joined, SEED)]
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    return [digest(joined[a:b], SEED) for a, b in zip(starts[: 1 - width].tolist(), ends[width - 1 :].tolist())]


def fingerprint(hashes: list[int]) -> int:
    """Bit set where over half of the hashes have it."""
    if not hashes:
        return 0
    votes, bytes_ = np.zeros(64, np.int64), np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8)
    for at in range(0, len(bytes_), 1 << 16):
        votes += np.unpackbits(bytes_[at : at + (1 << 16)], axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """doc_id and fp (64 bits in a signed long)."""

    @gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(shingle_hashes(t.as_py(), width)) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.array(found, np.uint64).astype(np.int64))], ["doc_id", "fp"])

    return id_and_text(docs).mapInArrow(run, "doc_id long, fp long")


def shingle_set(text: str) -> np.ndarray:
    """The distinct hashes of WIDE_WORDS words, sorted."""
    return np.unique(np.array(shingle_hashes(text, WIDE_WORDS), np.uint64))


def signature(shingles: np.ndarray, seed: int = SEED) -> int:
    """One number for a set of shingles; texts with equal sets are one text to one_of_each."""
    return int(np.uint64(xxhash.xxh64_intdigest(shingles.astype("<u8").tobytes(), seed)).astype(np.int64))


def least_hash_keys(shingles: np.ndarray) -> list[int]:
    """The shard keys of a set; none for an empty one."""
    if not len(shingles):
        return []
    least = np.full(len(_ODD), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 2048):
        np.minimum(least, (shingles[at : at + 2048, None] * _ODD).min(axis=0), out=least)
    keys = [xxhash.xxh64_intdigest(least[k * LEAST_HASHES : (k + 1) * LEAST_HASHES].astype("<u8").tobytes(), k) for k in range(BANDS)]
    return np.array(keys, np.uint64).astype(np.int64).tolist()


def _hashed(docs: DataFrame) -> DataFrame:
    """doc_id, text and its hash, which tells apart rows of one doc_id."""
    return id_and_text(docs).withColumn("text_hash", F.xxhash64("text"))


def sketches(docs: DataFrame, width: int = 4) -> DataFrame:
    """doc_id, text_hash, fp, and of the set of shingles two signatures (sig, check), size and keys, in one pass over the texts."""

    @gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints, sigs, checks, sizes, keys = [], [], [], [], []
            for text in batch.column("text"):
                t = text.as_py()
                shingles = shingle_set(t)
                prints.append(fingerprint(shingle_hashes(t, width)))
                sigs.append(signature(shingles))
                checks.append(signature(shingles, SEED + 1))
                sizes.append(len(shingles))
                keys.append(least_hash_keys(shingles))
            arrays = [batch.column("doc_id"), batch.column("text_hash"), pa.array(np.array(prints, np.uint64).astype(np.int64)), *(pa.array(x, pa.int64()) for x in (sigs, checks, sizes)), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "text_hash", "fp", "sig", "check", "size", "keys"])

    return _hashed(docs).mapInArrow(run, "doc_id long, text_hash long, fp long, sig long, check long, size long, keys array<long>")


class Forest:
    """Groups of the members of a unit, merged by links."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        label = self.label
        while len(a):
            x, y = label[a], label[b]
            differ = x != y
            if not differ.any():
                return
            a, b, x, y = a[differ], b[differ], x[differ], y[differ]
            np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
            while True:
                jumped = label[label]
                if (jumped == label).all():
                    break
                label[:] = jumped


def search(codes: np.ndarray, radius: int) -> np.ndarray:
    """For each code the least index of its group under links of `radius` differing bits or fewer."""
    forest = Forest(len(codes))

    def apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.bitwise_count(x ^ y).astype(np.int16)

    def visit(members: np.ndarray, queries: np.ndarray) -> None:
        """Links all queries with all members; members are the points of this subtree."""
        if len(members) <= LEAF or len(queries) * len(members) <= 4096:
            for at in range(0, len(queries), 4096):
                part = queries[at : at + 4096]
                q, m = np.nonzero(apart(codes[part][:, None], codes[members][None, :]) <= radius)
                forest.link(part[q], members[m])
            return
        vantage = members[0]
        to_members, to_queries = apart(codes[members], codes[vantage]), apart(codes[queries], codes[vantage])
        near = to_queries <= radius
        forest.link(queries[near], np.full(int(near.sum()), vantage))
        middle = np.median(to_members)
        inside = to_members <= middle
        if inside.all():
            inside = to_members < middle
        if not inside.any():  # all members at one distance: halves
            inside = np.arange(len(members)) < len(members) // 2
        for side in (inside, ~inside):
            low, high = to_members[side].min(), to_members[side].max()
            reach = (to_queries >= low - radius) & (to_queries <= high + radius)  # triangle bounds
            if reach.any():
                visit(members[side], queries[reach])

    everyone = np.arange(len(codes))
    visit(everyone, everyone)
    return forest.label


def shard_keys(fp, scheme: tuple[int, int]):
    """An array of shard keys, one for each choice of equal blocks."""
    blocks, equal = scheme
    edges = [64 * k // blocks for k in range(blocks + 1)]
    parts = [F.shiftrightunsigned(fp, lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1)) for lo, hi in zip(edges, edges[1:])]
    keys = []
    for number, chosen in enumerate(combinations(range(blocks), equal)):
        key = F.lit(number).cast("long")
        for k in chosen:
            key = F.shiftleft(key, edges[k + 1] - edges[k]).bitwiseOR(parts[k])
        keys.append(key)
    return F.array(*keys)


def _finer(probes: DataFrame, scheme: tuple[int, int]) -> DataFrame:
    """fp and key of probes (fp, number of the choice, key), where shards of more than CHUNK codes are dealt by further bits.

    The bits that a choice leaves open are cut into FINER_BLOCKS; at 4 differing bits or fewer two of these at least are equal, so
    each pair of blocks is a shard of its own within the first."""
    blocks, equal = scheme
    edges, masks = [64 * k // blocks for k in range(blocks + 1)], []
    for chosen in combinations(range(blocks), equal):
        open_ = [bit for k in range(blocks) if k not in chosen for bit in range(edges[k], edges[k + 1])]
        cuts = [len(open_) * k // FINER_BLOCKS for k in range(FINER_BLOCKS + 1)]
        parts = [sum(1 << bit for bit in open_[a:b]) for a, b in zip(cuts, cuts[1:])]
        masks.append([int(np.uint64(x | y).astype(np.int64)) for x, y in combinations(parts, 2)])
    hot = cut(probes.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > CHUNK).select(F.col("key"), F.lit(True).alias("hot")))
    own = F.transform(F.element_at(F.lit(masks), F.col("number") + 1), lambda mask, k: F.xxhash64("key", k, F.col("fp").bitwiseAND(mask)))
    return probes.join(_small(hot), "key", "left").select("fp", F.explode(F.when(F.col("hot"), own).otherwise(F.array("key"))).alias("key"))


def _units(probes: DataFrame, *columns: str, weight=F.lit) -> DataFrame:
    """Rows of columns (the first names the member) with the unit they meet in: a shard, or a pair of chunks of a hot one.

    weight gives what a row counts for in the size of a chunk, 1 or more; without it every row counts 1."""
    sizes = cut(probes.groupBy("key").agg(F.sum(weight(1)).alias("n")).filter(F.col("n") > CHUNK))
    chunks = F.coalesce(F.ceil(F.col("n") / CHUNK), F.lit(1)).cast("long")
    own = F.pmod(F.xxhash64(columns[0]), chunks)
    return (
        probes.join(_small(sizes), "key", "left")
        .select(*columns, "key", own.alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), chunks - 1)).alias("other"))
        .select(*columns, F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("unit"))
    )


def _small(df: DataFrame, weight: Column | int = 1) -> DataFrame:
    """df, to be broadcast if its counted weight is BROADCAST_ROWS at most; beyond it the other side is shuffled too."""
    return F.broadcast(df) if (df.agg(F.sum(F.lit(weight))).first()[0] or 0) <= BROADCAST_ROWS else df


def hamming_links(codes: DataFrame, count: int, radius: int = 4, scheme: tuple[int, int] | None = None) -> DataFrame:
    """Links (a, b) whose components are those of all pairs of distinct fp at `radius` differing bits or fewer.

    count is the number of codes; the scheme follows from it unless one is given."""
    if radius != 4:
        raise ValueError("the shard schemes are made for 4 differing bits")
    scheme = scheme or next((s for s in SCHEMES if count / 2 ** (64 * s[1] // s[0]) <= SHARD_ROWS), SCHEMES[-1])
    spark = codes.sparkSession
    units = _units(_finer(codes.select("fp", F.posexplode(shard_keys(F.col("fp"), scheme)).alias("number", "key")), scheme), "fp")
    rows = count * len(list(combinations(range(scheme[0]), scheme[1])))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows // 200_000 + 1)

    @gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(b.column("fp").to_numpy(zero_copy_only=False), b.column("unit").to_numpy(zero_copy_only=False)) for b in batches]
        if not held:
            return
        fp, unit = (np.concatenate(x) for x in zip(*held))
        order = np.argsort(unit, kind="stable")
        fp, unit = fp[order], unit[order]
        edges = np.flatnonzero(np.r_[True, unit[1:] != unit[:-1], True])
        left, right = [], []
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
            if b - a > 1:
                label = search(fp[a:b].view(np.uint64), radius)
                moved = np.flatnonzero(label != np.arange(b - a))
                left.append(fp[a:b][moved])
                right.append(fp[a:b][label[moved]])
        if left:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(left)), pa.array(np.concatenate(right))], ["a", "b"])

    return units.repartition(parts, "unit").mapInArrow(run, "a long, b long").distinct()


def key_links(sketched: DataFrame) -> DataFrame:
    """Links (a, b) of sig that join all texts with a key in common.

    The least sig of a key is its centre. A text is linked to the least of its centres only, and so are its other centres:
    of a large group nearly all links are then the same few."""
    keyed = sketched.select("sig", F.explode("keys").alias("key")).distinct()
    least = keyed.groupBy("key").agg(F.min("sig").alias("b"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    own = keyed.join(least, "key").groupBy("sig").agg(F.collect_set("b").alias("centres"))
    links = own.select(F.explode(F.concat(F.array("sig"), "centres")).alias("a"), F.array_min("centres").alias("b"))
    return links.filter("a != b").distinct()


def fingerprint_links(sketched: DataFrame, radius: int = 4) -> DataFrame:
    """Links (a, b) of sig that join all texts whose fingerprints are linked: a star for each fingerprint, and one link for two."""
    pairs = cut(sketched.select("sig", "fp").distinct())
    codes = cut(pairs.groupBy("fp").agg(F.min("sig").alias("b")))
    stars = pairs.join(codes, "fp").select(F.col("sig").alias("a"), "b")
    left, right = (codes.select(F.col("fp").alias(x), F.col("b").alias(f"{x}_sig")) for x in "ab")
    between = hamming_links(codes, codes.count(), radius).join(left, "a").join(right, "b").select(F.col("a_sig").alias("a"), F.col("b_sig").alias("b"))
    return stars.union(between).filter("a != b").distinct()


def similar(sets: list[np.ndarray]) -> np.ndarray:
    """For each set the least index of its group under links at a Jaccard similarity of 0.8 or more, counted."""
    forest = Forest(len(sets))
    order = np.argsort([len(x) for x in sets], kind="stable")
    sizes = np.array([len(sets[k]) for k in order])
    _, number, times = np.unique(np.concatenate([sets[k] for k in order]), return_inverse=True, return_counts=True)
    shared = times[number] > 1
    ends = np.cumsum(sizes)
    ends = np.r_[0, np.cumsum(shared)][np.r_[0, ends]]  # of the shared shingles of each set
    number, own = number[shared], np.zeros(len(times), bool)
    for q, size in enumerate(sizes.tolist()):
        stop = int(np.searchsorted(4 * sizes, 5 * size, "right"))  # larger sets cannot reach 0.8
        mine = number[ends[q] : ends[q + 1]]
        if stop <= q + 1 or 9 * len(mine) < 8 * size or (forest.label[order[q + 1 : stop]] == forest.label[order[q]]).all():
            continue
        own[mine] = True
        at = ends[q + 1 : stop + 1]
        common = np.diff(np.r_[0, np.cumsum(own[number[at[0] : at[-1]]])][at - at[0]])
        own[mine] = False
        near = order[q + 1 : stop][9 * common >= 4 * (size + sizes[q + 1 : stop])]  # common / (size + other - common) >= 4 / 5
        forest.link(near, np.full(len(near), order[q]))
    return forest.label


def confirmed(docs: DataFrame, sketched: DataFrame, proposed: DataFrame) -> DataFrame:
    """Links (a, b) of sig whose components are those of the pairs at 0.8 or more among texts that proposed links join."""
    texts = sketched.groupBy("sig").agg(F.first("size").alias("size"), F.min(F.struct("doc_id", "text_hash")).alias("row"))
    members = cut(components(proposed).select(F.col("v").alias("sig"), F.col("label").alias("key")).join(texts, "sig"))
    units = _units(members, "sig", "row", weight=lambda one: F.greatest(F.lit(one).cast("double"), F.col("size") / ROW_SHINGLES))
    wanted = units.groupBy("sig", "row").agg(F.collect_set("unit").alias("units")).select("sig", "units", F.col("row.doc_id").alias("id"), F.col("row.text_hash").alias("hash"))

    @gives_back
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t.as_py()).astype("<u8").tobytes() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("sig"), batch.column("units"), pa.array(sets, pa.binary())], ["sig", "units", "shingles"])

    @gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by unit; one unit is held at a time."""
        held, unit = {}, None

        def found() -> tuple[list, list]:
            if len(held) < 2:
                return [], []
            sigs = np.array(list(held), np.int64)
            label = similar([np.frombuffer(x, "<u8") for x in held.values()])
            moved = np.flatnonzero(label != np.arange(len(sigs)))
            return sigs[moved].tolist(), sigs[label[moved]].tolist()

        for batch in batches:
            left, right = [], []
            for sig, shingles, key in zip(*(batch.column(c).to_pylist() for c in ("sig", "shingles", "unit"))):
                if key != unit:
                    a, b = found()
                    left += a
                    right += b
                    held, unit = {}, key
                held[sig] = shingles
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])
        a, b = found()
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    rows = _hashed(docs).join(_small(cut(wanted), F.size("units")), F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_hash") == F.col("hash"))).select("sig", "units", "text")
    sets = rows.mapInArrow(read, "sig long, units array<long>, shingles binary").select("sig", "shingles", F.explode("units").alias("unit"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return sets.repartition(parts, "unit").sortWithinPartitions("unit").mapInArrow(run, "a long, b long").distinct()


def components(links: DataFrame) -> DataFrame:
    """v and the least vertex that it reaches (label), for every vertex with a link; no bound on rounds."""
    both = cut(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = both.groupBy(F.col("a").alias("v")).agg(F.least(F.min("b"), F.first("a")).alias("label"))
    labels = cut(labels)
    while True:
        near = both.join(labels.select(F.col("v").alias("b"), "label"), "b").groupBy(F.col("a").alias("v")).agg(F.min("label").alias("near"))
        # written out, so that the jump deals both sides anew and can split a large group's label
        lower = cut(labels.join(near, "v").select("v", "label", F.least("label", "near").alias("low")))
        jump = lower.select(F.col("v").alias("low"), F.col("low").alias("lowest"))
        labels = cut(lower.join(jump, "low").select("v", F.col("lowest"), F.col("label").alias("before")))
        if labels.filter("lowest != before").isEmpty():
            return labels.select("v", F.col("lowest").alias("label"))
        labels = labels.select("v", F.col("lowest").alias("label"))


def near_duplicates(docs: DataFrame, width: int = 4, radius: int = 4) -> DataFrame:
    """doc_id, fp and component_id (the least doc_id of all documents that links reach) of every document."""
    return grouped(cut(fingerprints(docs, width)), radius)


def grouped(prints: DataFrame, radius: int = 4) -> DataFrame:
    """near_duplicates of fingerprints (doc_id, fp)."""
    codes = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least_id")))
    groups = components(hamming_links(codes, codes.count(), radius))
    labelled = codes.join(groups, codes["fp"] == groups["v"], "left").select("fp", "least_id", F.col("label"))
    # a label is a member's fp, so a component is named by its label; fp without a link stand alone
    least = cut(labelled.filter("label is not null").groupBy("label").agg(F.min("least_id").alias("component_id")))
    named = groups.join(least, "label").select(F.col("v").alias("fp"), "component_id")
    # written out, so that the last join deals both sides anew and can split a frequent fingerprint
    all_codes = cut(codes.join(named, "fp", "left").select("fp", F.coalesce("component_id", "least_id").alias("component_id")))
    return prints.join(all_codes, "fp").select("doc_id", "fp", "component_id")


def _least_rows(sketched: DataFrame, links: DataFrame) -> DataFrame:
    """The row of least doc_id (doc_id, text_hash; no id comes last) of each group of texts that links join."""
    groups = components(links)
    named = sketched.join(groups, F.col("sig") == F.col("v"), "left").withColumn("group", F.coalesce("label", "sig"))
    return named.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")).alias("m")).select("m.doc_id", "m.text_hash")


def told_apart(sketched: DataFrame) -> DataFrame:
    """sketched, where different sets of shingles that happen to share a sig (their check differs) get one of their own."""
    clashes = cut(sketched.groupBy("sig").agg(F.min("check").alias("low"), F.max("check").alias("high")).filter("low != high").select(F.col("sig").alias("clash")))
    if clashes.isEmpty():
        return sketched
    own = F.when(F.col("clash").isNotNull(), F.xxhash64("sig", "check")).otherwise(F.col("sig"))
    return cut(sketched.join(clashes, F.col("sig") == F.col("clash"), "left").withColumn("sig", own).drop("clash"))


def one_of_each(docs: DataFrame, width: int = 4, radius: int = 4) -> DataFrame:
    """docs without near copies, all columns; repeated rows stay once.

    Of each group of texts at a similarity of 0.8 or more on five words (links are transitive), counted on the sets of
    shingles, the least doc_id stays. Texts meet only where they are candidates for a copy: all else is decided on
    numbers, and the rows that go (or are repeated) are taken out of docs where they stand."""
    sketched = told_apart(cut(sketches(docs, width)))
    proposed = fingerprint_links(sketched, radius).union(key_links(sketched))
    stay = _least_rows(sketched, confirmed(docs, sketched, proposed)).withColumn("stays", F.lit(True))
    times = sketched.groupBy("doc_id", "text_hash").agg(F.count(F.lit(1)).alias("times"))
    same = times["doc_id"].eqNullSafe(stay["doc_id"]) & (times["text_hash"] == stay["text_hash"])
    marked = times.join(stay, same, "left").select(times["doc_id"].alias("id"), times["text_hash"].alias("hash"), F.coalesce("stays", F.lit(False)).alias("stays"), "times")
    marked = cut(marked.filter("not stays or times > 1").select("id", "hash", "stays"))
    rows = docs.select(whole_rows(docs).alias("row"), F.col("doc_id").cast("long").alias("own_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("own_hash"))
    held = rows.join(_small(marked), F.col("own_id").eqNullSafe(F.col("id")) & (F.col("own_hash") == F.col("hash")), "left")
    single = held.filter("stays is null").select("row.*")
    if marked.filter("stays").isEmpty():
        return single
    # of repeated rows that differ in another column the one whose columns hash lowest
    once = held.filter("stays").groupBy("own_id", "own_hash").agg(F.min_by("row", F.xxhash64(F.to_json("row"))).alias("row"))
    return single.union(once.select("row.*"))
