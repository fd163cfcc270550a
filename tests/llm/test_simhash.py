import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from pathloom.llm import simhash
from tests.llm.helpers import NASTY, docs


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64(g, seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(codes, radius=4):
    parent = list(range(len(codes)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(codes)):
        for j in range(i):
            if bin(codes[i] ^ codes[j]).count("1") <= radius:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return [root(i) for i in range(len(codes))]


def test_documents(spark):
    rng = random.Random(1)
    base = " ".join(rng.choice("alpha beta gamma delta eps zeta eta theta".split()) + str(rng.randrange(50)) for _ in range(300))
    near = [(200 + k, base.replace("alpha1", f"x{k}", 1) + (" tail" * (k % 3))) for k in range(20)]
    rows = [r for r in NASTY if r[0] is not None] + near + [(300, base), (301, base.upper())]
    prints = [plain_fingerprint(t) for _, t in rows]
    least = plain_components(prints)
    name = {}
    for (i, _), c in zip(rows, least):
        name[c] = min(name.get(c, i), i)
    got = {r.doc_id: r for r in simhash.near_duplicates(docs(spark, rows)).collect()}
    assert len(got) == len(rows)
    for (i, _), p, c in zip(rows, prints, least):
        assert got[i].fp % 2**64 == p
        assert got[i].component_id == name[c], i
    assert simhash.near_duplicates(docs(spark, [])).count() == 0


def test_tree_and_shards_against_all_pairs(spark, monkeypatch):
    rng = random.Random(2)
    codes = [rng.getrandbits(64) for _ in range(300)]
    for _ in range(900):  # chains and clusters around the boundary
        c = rng.choice(codes)
        for b in rng.sample(range(64), rng.choice([1, 3, 4, 5, 6])):
            c ^= 1 << b
        codes.append(c)
    codes = sorted(set(codes))
    want = plain_components(codes)
    label = simhash.search(np.array(codes, np.uint64), 4)
    assert label.tolist() == want
    monkeypatch.setattr(simhash, "CHUNK", 100)  # splits shards into chunk pairs
    signed = np.array(codes, np.uint64).astype(np.int64).tolist()
    frame = spark.createDataFrame([(c,) for c in signed], "fp long")
    for scheme in simhash.SCHEMES:  # all find the same components
        groups = {r.v: r.label for r in simhash.components(simhash.hamming_links(frame, len(codes), scheme=scheme)).collect()}
        mine = {}
        for c, w in zip(signed, want):
            mine.setdefault(w, set()).add(groups.get(c, c))
        assert all(len(v) == 1 for v in mine.values()) and len({min(v) for v in mine.values()}) == len(mine)


def test_hot_shards_are_dealt_by_further_bits(spark, monkeypatch):
    """Codes that share 32 bits, as random ones, as clusters and as all values of ten bits: links as of all pairs, few rows more than codes."""
    rng = random.Random(4)
    codes = [rng.getrandbits(32) for _ in range(1200)]
    for _ in range(800):
        c = rng.choice(codes)
        for b in rng.sample(range(32), rng.choice([1, 3, 4, 5, 6])):
            c ^= 1 << b
        codes.append(c)
    monkeypatch.setattr(simhash, "CHUNK", 50)
    for held in (sorted({(7 << 40) | c for c in codes}), [(9 << 33) | k << 3 for k in range(1024)]):
        signed = np.array(held, np.uint64).astype(np.int64).tolist()
        frame = spark.createDataFrame([(c,) for c in signed], "fp long")
        want = plain_components(held)
        groups = {r.v: r.label for r in simhash.components(simhash.hamming_links(frame, len(held), scheme=(8, 4))).collect()}
        mine = {}
        for c, w in zip(signed, want):
            mine.setdefault(w, set()).add(groups.get(c, c))
        assert all(len(v) == 1 for v in mine.values()) and len({min(v) for v in mine.values()}) == len(mine)


def test_a_hot_key_grows_with_its_codes(spark):
    """65,536 codes under one key: far fewer rows than chunk pairs would take."""
    rng = np.random.default_rng(5)
    codes = np.unique(rng.integers(0, 1 << 32, 65_700, np.uint64))[:65_536].astype(np.int64)
    frame = spark.createDataFrame([(int(c),) for c in codes], "fp long")
    probes = frame.select("fp", F.posexplode(simhash.shard_keys(F.col("fp"), (8, 4))).alias("number", "key")).filter("number = 69")
    assert probes.select("key").distinct().count() == 1
    units = simhash._units(simhash._finer(probes, (8, 4)), "fp")
    assert units.count() < 1_000_000
    assert units.groupBy("unit").count().agg(F.max("count")).first()[0] < 2048


def test_a_repeated_row_is_chosen_by_its_columns(spark):
    """Rows of one id and text that differ in another column: the same one stays, whatever their order."""
    rows = [(1, "a b c d e f", k) for k in range(6)] + [(2, "other words here", 0)]
    kept = []
    for order in (rows, rows[::-1], rows[3:] + rows[:3]):
        frame = spark.createDataFrame(order, "doc_id long, text string, n_chars int").repartition(3)
        kept.append(sorted((r.doc_id, r.n_chars) for r in simhash.one_of_each(frame).collect()))
    assert kept[0] == kept[1] == kept[2] and len(kept[0]) == 2


def test_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(25)] + [(100, 101)], "a long, b long")
    got = {r.v: r.label for r in simhash.components(links).collect()}
    assert got == {**{i: 0 for i in range(26)}, 100: 100, 101: 100}


def jaccard(a, b):
    def grams(t):
        w = t.lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    return len(grams(a) & grams(b)) / len(grams(a) | grams(b))


def test_one_of_each_at_similarity(spark, monkeypatch):
    """Copies well over 0.8 on five words go, texts well under it stay, whatever their fingerprints of 64 bits."""
    rng = random.Random(3)
    rows, gone, stay = [], set(), set()
    for k in range(40):
        words = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice([120, 400, 900]))]
        rows.append((10 * k, " ".join(words)))
        for j, share in ((1, 60), (2, 9)):  # one word in so many is another
            other = list(words)
            for at in range(share // 2, len(words), share):
                other[at] = f"x{rng.randrange(10**6)}"
            rows.append((10 * k + j, " ".join(other)))
            near = jaccard(rows[-1 - j][1], rows[-1][1])
            assert (near > 0.83) if j == 1 else near < 0.5
            (gone if j == 1 else stay).add(10 * k + j)
        stay.add(10 * k)
    rows += [(1000, ""), (1001, None), (1002, " \n"), (1003, "solo"), (1004, "solo two"), (1005, "solo two")]
    for chunk in (1024, 2):  # two: every shard with more rows is split into chunk pairs
        monkeypatch.setattr(simhash, "CHUNK", chunk)
        got = {r.doc_id for r in simhash.one_of_each(docs(spark, rows)).collect()}
        assert got == stay | {1000, 1003, 1004}
    assert simhash.one_of_each(docs(spark, [])).count() == 0


def kept_ids(spark, rows):
    return {r.doc_id for r in simhash.one_of_each(docs(spark, rows)).collect()}


def test_similarity_is_counted(spark, monkeypatch):
    """Pairs on both sides of 0.8 on five words in short texts are judged by their counted sets."""
    rng = random.Random(5)
    rows, stay = [], set()
    for k in range(120):
        n = rng.choice([8, 9, 10, 14])
        words = [f"w{rng.randrange(10**6)}" for _ in range(n)]
        grams = n - 4
        most = grams // 4  # words appended: grams / (grams + most) >= 0.8
        more = most + k % 2
        one, two = " ".join(words), " ".join([*words, *(f"y{rng.randrange(10**6)}" for _ in range(more))])
        if bin(plain_fingerprint(one) ^ plain_fingerprint(two)).count("1") <= 4:
            continue
        rows += [(2 * k, one), (2 * k + 1, two)]
        assert (jaccard(rows[-2][1], rows[-1][1]) >= 0.8) == (k % 2 == 0)
        stay |= {2 * k} if k % 2 == 0 else {2 * k, 2 * k + 1}
    assert kept_ids(spark, rows) == stay
    monkeypatch.setattr(simhash, "CHUNK", 1)
    assert kept_ids(spark, rows) == stay


def test_similar_against_all_pairs():
    rng = np.random.default_rng(6)
    sets = []
    for _ in range(40):
        base = rng.integers(0, 2**63, int(rng.integers(3, 60)))
        for _ in range(4):
            sets.append(np.unique(np.r_[base[rng.random(len(base)) < 0.93], rng.integers(0, 2**63, int(rng.integers(0, 4)))]).astype(np.uint64))
    want = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(np.intersect1d(a, sets[j]))
            if 5 * both >= 4 * (len(a) + len(sets[j]) - both) and want[i] != want[j]:
                x, y = sorted((want[i], want[j]))
                want = [x if w == y else w for w in want]
    assert simhash.similar(sets).tolist() == want and len(set(want)) < len(want)


def test_repeated_line_is_no_copy(spark):
    """One line many times rules the fingerprint, but the other passages differ."""
    rng = random.Random(7)
    line = "this line stands on every page of the site "
    rows = [(k, line * 200 + " ".join(f"w{rng.randrange(10**6)}" for _ in range(30))) for k in range(12)]
    prints = [plain_fingerprint(t) for _, t in rows]
    assert len(set(plain_components(prints))) == 1 and max(jaccard(rows[0][1], t) for _, t in rows[1:]) < 0.5
    rows.append((12, line * 150 + rows[3][1][len(line) * 200 :]))
    assert kept_ids(spark, rows) == set(range(12))


def test_links_of_both_passes_join(spark):
    """X and Y are within 4 bits, Z is a copy of Y but not of X: one group, whichever has the least id."""
    rng = random.Random(11)
    while True:
        x = [f"w{rng.randrange(10**6)}" for _ in range(400)]
        y = list(x)
        y[200] = "edited"
        if bin(plain_fingerprint(" ".join(x)) ^ plain_fingerprint(" ".join(y))).count("1") <= 4:
            break
    z = y + [f"z{rng.randrange(10**6)}" for _ in range((len(y) - 4) // 4)]
    x, y, z = map(" ".join, (x, y, z))
    assert jaccard(x, y) >= 0.8 and jaccard(y, z) >= 0.8 > jaccard(x, z)
    for order in ((x, y, z), (y, z, x), (z, x, y)):
        assert kept_ids(spark, list(enumerate(order))) == {0}


def test_null_and_repeated_ids(spark):
    rows = [(None, "a b c d e f"), (None, "other words stand here now"), (7, "a b c d e f"), (7, "a b c d e f"), (9, "something else again it is"), (None, None), (8, "")]
    got = [(r.doc_id, r.fp, r.component_id) for r in simhash.near_duplicates(docs(spark, rows)).collect()]
    assert len(got) == len(rows)
    by_text = {}
    for i, t in rows:
        by_text.setdefault(t or "", []).append(i)
    prints = {t: simhash.fingerprint(simhash.shingle_hashes(t, 4)) for t in by_text}
    assert len(set(prints.values())) == len(prints)
    signed = {t: p - 2**64 if p >= 2**63 else p for t, p in prints.items()}
    for t, ids in by_text.items():
        own = [(i, c) for i, fp, c in got if fp == signed[t]]
        assert sorted(map(repr, (i for i, _ in own))) == sorted(map(repr, ids))
        assert {c for _, c in own} == {min((i for i in ids if i is not None), default=None)}


def test_signatures_that_meet_are_told_apart(spark):
    rows = [(1, 10, 5, 100), (2, 20, 5, 200), (3, 30, 6, 300), (4, 40, 5, 100)]
    frame = spark.createDataFrame(rows, "doc_id long, text_hash long, sig long, check long")
    got = {r.doc_id: r.sig for r in simhash.told_apart(frame).collect()}
    assert got[1] == got[4] != got[2] and got[3] == 6 and len(set(got.values())) == 3
