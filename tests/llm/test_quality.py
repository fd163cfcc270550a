import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from pathloom.llm import quality_model, quality_rules, toxicity
from pathloom.llm.labelled import auc
from tests.llm.helpers import NASTY, docs

CLEAN = "the a river house garden walks slowly under bright morning light while people talk about bread and music".split()


def made_rows(n=600, seed=4):
    """Prose, junk of symbols and toxic prose with their labels (quality, toxic)."""
    rng = random.Random(seed)
    rows, labels = [], []
    for k in range(n):
        words = [rng.choice(CLEAN) + rng.choice(["", "", "s", "ing", str(rng.randrange(9))]) for _ in range(rng.randrange(60, 160))]
        quality, toxic = 1, 0
        if k % 6 == 0:
            words, quality = [w + rng.choice(["%%%", "***", "&&&"]) for w in words], 0
        elif k % 6 == 1:
            for _ in range(4):
                words.insert(rng.randrange(len(words)), rng.choice(["idiot", "zorgling", "zorgs", "scum"]))
            toxic = 1
        text = " ".join(w + ("." if j % 9 == 8 else "") for j, w in enumerate(words))
        rows.append((k, text))
        labels.append((k, quality, toxic))
    return rows, labels


def plain_statistics(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    count, covered = Counter(grams), set()
    for i, g in enumerate(grams):
        if count[g] > 1:
            covered |= {i, i + 1, i + 2}
    seen, twice = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            twice += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), twice, len(covered)


def test_rule_statistics(spark):
    rng = random.Random(9)
    rows = NASTY + [(50 + k, " ".join(rng.choice("abc") for _ in range(k))) for k in range(9)] + [(70, "x y\nx y\r\nx y\n \nx y\x1cz\x85q")]
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality_rules.judge(docs(spark, rows), labels).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        n, chars, symbols, twice, repeat = plain_statistics(t)
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, twice, repeat), i
        assert r.base_failed == (n < 50 or 100 * repeat > 50 * n) and r.kept == (not r.base_failed)
    assert quality_rules.judge(docs(spark, []), labels).count() == 0


def test_pair_numbers_for_many_words(monkeypatch):
    ids = np.array([0, 1, 2, 5, 0, 1, 2, (1 << 22), 3])
    assert quality_rules.repeated_words(ids) == 6


def test_forest_drops_odd_rows(spark):
    rows, labels = made_rows()
    got = quality_rules.judge(docs(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).toPandas().set_index("doc_id")
    quality = np.array([q for _, q, _ in labels])
    kept = got.loc[[i for i, _, _ in labels], "kept"].to_numpy()
    assert kept[quality == 1].mean() > 0.98 and kept[quality == 0].mean() < 0.2


@pytest.mark.parametrize("score,column", [(quality_model.score_documents, 1), (toxicity.score_documents, 2)])
def test_held_out_accuracy(spark, score, column):
    rows, labels = made_rows()
    frame = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in score(docs(spark, rows), frame).collect()}
    assert len(got) == len(rows)
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1 for i, r in got.items())
    away = [x for x in labels if got[x[0]].held_out]
    assert auc(np.array([got[x[0]].score for x in away]), np.array([x[column] for x in away])) > 0.97


@pytest.mark.parametrize("score", [quality_model.score_documents, toxicity.score_documents])
def test_edge_rows(spark, score):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = score(docs(spark), none).collect()
    assert len(got) == len(NASTY) and all(0 <= r.score <= 1 for r in got)
    assert score(docs(spark, []), none).count() == 0
    odd = spark.createDataFrame([(None, 1, 1), (4, None, None), (5, 1, 0), (5, 0, 1), (6, 1, 1)], "doc_id long, quality int, toxic int")
    assert score(docs(spark), odd).count() == len(NASTY)


def test_grammar():
    grammar = toxicity.Grammar({w: 3.0 for w in toxicity.INSULTS} | {"zorg*": 2.0})
    one = lambda text: sum(grammar.clauses(text)[1])
    assert one("a fine day") == 0
    assert one("what an idiot.") == 3.0
    assert one("you idiot.") > one("what an idiot.") > one("he said that idiot. ") > one("he said not idiot.") > 0
    assert one("you are not an idiot") < one("you are an idiot")
    assert one("not today. idiot") == 3.0 and one("not one two three four idiot") == 3.0
    assert one("kill time") == 0 and one("kill you") == toxicity.SEED_WEIGHT
    assert one("Zorgling,") == 2.0 and len(grammar.clauses("idiot. scum! fine. trash")[1]) == 3
    model = toxicity.Model(grammar.lexicon, toxicity.Calibration(np.empty((0, 7)), np.empty(0)))
    score, clauses = model.scores(grammar, ["", None, "you idiot"])
    assert score[0] == score[1] < score[2] and clauses.tolist() == [0, 0, 1]


def test_toxic_words_between_any_separators():
    """Words count alike whatever stands between them, one clause a line; nothing after 40 characters is lost."""
    grammar = toxicity.Grammar({w: toxicity.SEED_WEIGHT for w in toxicity.INSULTS})
    words = "you are a stupid idiot and a worthless moron".split()
    want = grammar.clauses(" ".join(words))
    assert want[0] == 9 and len(want[1]) == 1
    for between in ("\t", " ", ",", "/", " / ", "　", "—", "\r", "😀"):
        assert grammar.clauses(between.join(words)) == want, repr(between)
    assert grammar.clauses("idiot\nmoron\nyou scum\nnot stupid") == grammar.clauses("idiot. moron. you scum. not stupid")
    assert grammar.clauses("idiot\nmoron\nyou scum\nnot stupid")[1] == [3.0, 3.0, 3.75, 3.0 * 0.35]
    assert grammar.clauses("isn't,idiot") == grammar.clauses("isn't idiot") and grammar.clauses("'idiot'") == grammar.clauses("idiot")
    long = "x" * 50
    assert toxicity.Grammar({long: 3.0}).clauses(long)[1] == [3.0] and not toxicity.Grammar({"x" * 40: 3.0}).clauses(long)[1]
    for text in ("", " ", "'", "...", "\n\n", "x" * 100_000):
        assert grammar.clauses(text)[1] == []


def test_predictions_at_the_threshold(spark, monkeypatch, tmp_path):
    """A score equal to the threshold is predicted 1, in both queries."""
    from pyspark.sql import functions as F

    from pathloom.llm import queries

    rows = [(k, "some words") for k in range(4)]
    docs(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for module, query, least in ((quality_model, queries.op8_quality, 0.7), (toxicity, queries.op9_toxicity, 0.3)):
        scores = F.when(F.col("doc_id") == 0, least).when(F.col("doc_id") == 1, float(np.nextafter(least, 0))).otherwise(1.0)
        monkeypatch.setattr(module, "score_documents", lambda d, _, s=scores: d.select("doc_id", F.lit(False).alias("held_out"), s.alias("score"), F.lit(0).cast("long").alias("n_clauses")))
        assert {r.doc_id: r.predicted for r in query(spark, str(tmp_path)).collect()} == {0: 1, 1: 0, 2: 1, 3: 1}


def plain_clauses(text, lexicon):
    """The grammar word by word, without its table of states."""
    found, words = [], 0
    for clause in re.split(r"(?<=[.!?;:\n])", text):
        negated, reported, aimed, threat, total = 0, False, False, False, 0.0
        for raw in re.findall(r"[\w'’]+", clause):
            words += 1
            word = raw.strip("'’").lower()
            weight = max([lexicon.get(b, 0.0) for b in [word, *(word[:n] + "*" for n in range(3, 7) if len(word) > n)]]) if word else 0.0
            soften = (0.35 if negated else 1.0) * (0.6 if reported else 1.0)
            negated = max(0, negated - 1)
            if weight > 0:
                total += soften * (1.25 if aimed else 1.0) * weight
            elif word in toxicity.TARGETS:
                total += soften * (toxicity.SEED_WEIGHT if threat else 0.0)
                aimed, threat = True, False
            elif word in toxicity.NEGATIONS:
                negated = toxicity.REACH
            elif word in toxicity.REPORTS:
                reported = True
            elif word in toxicity.THREATS:
                total += soften * (0.25 * toxicity.SEED_WEIGHT if aimed else 0.0)
                threat = True
        if total > 0:
            found.append(total)
    return words, found


def test_clauses_against_a_plain_grammar():
    rng = random.Random(11)
    lexicon = {w: toxicity.SEED_WEIGHT for w in toxicity.INSULTS} | {"zor*": 2.0, "kwa": 4.5}
    words = ["idiot", "scum", "zorgle", "kwa", "you", "your", "kill", "beat", "not", "never", "said", "wrote", "house", "river", "a", "the", "isn't", "zo"]
    grammar = toxicity.Grammar(lexicon)
    for _ in range(400):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", ". ", "\n", ", ", "! ", "; "]) for _ in range(rng.randrange(0, 30)))
        n, found = grammar.clauses(text)
        plain_n, plain = plain_clauses(text, lexicon)
        assert n == plain_n and found == pytest.approx(plain), text


def test_forest_paths_against_plain_descent():
    rng = np.random.default_rng(2)
    x = rng.normal(0, 1, (300, 6))
    forest = quality_rules.Forest(x, trees=20, rows=64)
    odd = np.concatenate([x[:40], rng.normal(0, 6, (20, 6))])
    want = []
    for row in odd:
        total = 0.0
        for node in forest.roots:
            while forest.left[node] != node:
                node = forest.left[node] if row[forest.feature[node]] <= forest.split[node] else forest.right[node]
            total += forest.length[node]
        want.append(total / 20)
    assert forest.path(odd) == pytest.approx(want)
    assert np.mean(want[40:]) < np.mean(want[:40])  # odd rows are isolated sooner


def test_word_vectors_against_plain_sums(spark):
    """Each bucket's sum of its neighbours' index vectors, word by word."""
    rng = random.Random(5)
    rows = [(k, " ".join(f"w{rng.randrange(30)}" for _ in range(rng.randrange(0, 40)))) for k in range(30)]
    index, sums, counts = quality_model.index_vectors(), {}, Counter()
    assert all((np.abs(v).sum(), np.count_nonzero(v)) == (quality_model.ACTIVE, quality_model.ACTIVE) for v in index[:50]) and not index[-1].any()
    for _, text in rows:
        ids = [zlib.crc32(w) % quality_model.BUCKETS for w in text.encode().split()]
        for at, own in enumerate(ids):
            near = ids[max(0, at - quality_model.NEAR) : at] + ids[at + 1 : at + 1 + quality_model.NEAR]
            sums[own] = sums.get(own, 0) + index[near].sum(axis=0)
            counts[own] += 1
    vectors = quality_model.word_vectors(docs(spark, rows))
    used = sorted(counts)
    table, total = np.array([sums[b] for b in used], float), np.array([counts[b] for b in used], float)
    table = table / total[:, None] - table.sum(axis=0) / total.sum()
    table /= np.sqrt((table**2).sum(axis=1))[:, None]
    assert np.allclose(vectors[used], table, atol=1e-5) and not np.delete(vectors, used, axis=0).any()


def test_threshold_and_trees_of_all_labelled_rows(spark, monkeypatch):
    """More labelled rows than any sample held: the threshold is that of all of them, and trees draw from all."""
    rng = np.random.default_rng(3)
    n = 26_000
    stats = np.stack([rng.integers(60, 400, n), rng.integers(300, 2400, n), rng.integers(0, 9, n), np.zeros(n), np.zeros(n), rng.integers(40, 60, n), rng.integers(0, 50, n), rng.integers(0, 5, n), rng.integers(0, 9, n)], axis=1).astype(np.int64)
    label = (rng.random(n) < 0.9).astype(int)
    stats[label == 0, 2] += rng.integers(0, 900, (label == 0).sum())
    names = list(quality_rules.BASE + quality_rules.MORE)
    frame = spark.createDataFrame([(k, *map(int, r), int(b)) for k, (r, b) in enumerate(zip(stats, label))], "doc_id long, " + ", ".join(f"{c} long" for c in names) + ", label int")
    forest = quality_rules.grown(frame.filter("label = 1").drop("label"))
    assert len(forest.roots) == quality_rules.TREES and forest.margin.shape == (6,)
    x = quality_rules.features(stats[label == 1])
    assert np.allclose(forest.margin, np.maximum(x.max(axis=0) - x.min(axis=0), quality_rules.LEAST_RANGE) * quality_rules.MARGIN)
    want = quality_rules.threshold(forest.path(quality_rules.features(stats)), label)
    assert np.isfinite(want) and quality_rules.best_threshold(frame, forest) == want
    assert quality_rules.best_threshold(frame.filter("label = 1"), forest) == -np.inf
    assert quality_rules.grown(frame.limit(1).drop("label")) is None
