"""Toxicity by a weighted finite-state pattern grammar.

Five transducers read the words of a clause: insult (a weighted lexicon), threat (a verb that waits for a target),
target (who is spoken to), negation (reaches a few words on) and reported speech (reaches to the clause's end). They
are composed once into one table of states; reading a clause sums the weights that its path puts out, so an insult
that is negated or quoted counts less and one aimed at a target counts more. A document is judged by its matched
clauses, not by isolated words.

The lexicon is a small fixed list and what a bounded sample of labelled rows teaches: words and beginnings of words by
their log odds between toxic and clean rows. The logistic calibration of the clause scores sees each row of the sample
through a lexicon that the other folds teach, so it is not fitted to words that its own row taught.

Defined results: null text is empty text; a text without a match has the score of no match; equal texts score alike;
without labels of both kinds the calibration is a fixed one.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Cache, cut, gives_back, id_and_text, small_batches, whole_rows
from .labelled import LABELLED_ROWS, held_out, training_labels

#: Word lists of the transducers (lower case).
INSULTS = "idiot idiots moron morons stupid scum loser losers trash pathetic worthless disgusting clown clowns dumb fool imbecile idiota estúpido basura asqueroso imbécile crétin ordure dummkopf abschaum versager".split()
THREATS = "kill hurt destroy burn beat shoot stab strangle hang töten umbringen verprügeln tuer frapper brûler matar golpear quemar".split()
TARGETS = "you your yours yourself u ya they them their he him his she her hers du dich dir dein sie ihr euch tu te toi vous votre tú ti usted ustedes vosotros".split()
NEGATIONS = "not no never isn't aren't wasn't don't doesn't didn't won't nicht kein keine nie pas jamais aucun nunca jamás ningún".split()
REPORTS = "said says say wrote writes called calls quoted quotes reported claimed told sagte schrieb nannte dit écrit appelé dijo escribió llamó".split()
OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)
FIXED = {w: k for k, words in ((TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS), (THREAT, THREATS)) for w in words}
REACH = 3  # words that a negation covers
SEED_WEIGHT, LEAST_ROWS, LEAST_ODDS = 3.0, 3, 1.6
#: Folds of the sample, and how far (in standard errors) below an entry's log odds SURE_ODDS must still be reached.
FOLDS, CONFIDENCE, SURE_ODDS = 4, 1.64, 1.0
_ENDS = re.compile(r"[.!?;:\n]")
#: What stands between words: white space, punctuation and symbols (pictographs beyond U+FFFF as one range, as a long class
#: is slow there), but no apostrophe inside a word.
_BETWEEN = re.escape("".join(m for m in map(chr, range(0x10000)) if (m.isspace() or unicodedata.category(m)[0] in "PS") and m not in "'’")) + "\U0001f000-\U0001faff"
#: A word with all that separates it from the next one.
_PIECE = re.compile(f"[^{_BETWEEN}]+[{_BETWEEN}]*")
_WORD = re.compile(f"[^{_BETWEEN}]+")
#: Longer pieces are read anew each time.
CACHED_PIECE = 60


def compose() -> tuple[list[list[int]], list[list[float]]]:
    """The product of the transducers: next state and factor on the word's weight, by state and kind of word."""
    states = list(product(range(REACH + 1), (0, 1), (0, 1), (0, 1)))  # negation left, reported, target seen, threat open
    number = {s: k for k, s in enumerate(states)}
    move, factor = [], []
    for negated, reported, aimed, threat in states:
        soften = (0.35 if negated else 1.0) * (0.6 if reported else 1.0)
        left = max(0, negated - 1)
        after = {
            OTHER: (left, reported, aimed, threat), INSULT: (left, reported, aimed, threat), THREAT: (left, reported, aimed, 1),
            TARGET: (left, reported, 1, 0), NEGATION: (REACH, reported, aimed, threat), REPORT: (left, 1, aimed, threat),
        }
        out = {INSULT: soften * (1.25 if aimed else 1.0), THREAT: soften * 0.25 * aimed, TARGET: soften * threat}
        move.append([number[after[k]] for k in range(6)])
        factor.append([out.get(k, 0.0) for k in range(6)])
    return move, factor


MOVE, FACTOR = compose()
#: What most tokens read as; shared, as the cache holds many.
_PLAIN = ((OTHER, 0.0, False), (OTHER, 0.0, True))


def beginnings(word: str) -> list[str]:
    """The word and its beginnings, as lexicon entries."""
    return [word, *(word[:n] + "*" for n in range(3, 7) if len(word) > n)]


def bare(piece: str) -> str:
    """The word of a piece of _PIECE, whole and in lower case."""
    return _WORD.match(piece).group().strip("'’").lower()


class Grammar:
    def __init__(self, lexicon: dict[str, float], entries: int = 200_000):
        self.lexicon = lexicon
        self.cache = Cache(self._read, entries)

    def _read(self, piece: str) -> tuple:
        """(kind, weight, ends a clause) of a word and what separates it from the next one."""
        word = bare(piece)
        weight = max((self.lexicon.get(b, 0.0) for b in beginnings(word)), default=0.0) if word else 0.0
        ends = bool(_ENDS.search(piece))
        if weight > 0:
            return INSULT, weight, ends
        if word in FIXED:
            return FIXED[word], SEED_WEIGHT if FIXED[word] == THREAT else 0.0, ends
        return _PLAIN[ends]

    def _miss(self, piece: str) -> tuple:
        return self.cache.miss(piece) if len(piece) <= CACHED_PIECE else self._read(piece)

    def clauses(self, text: str) -> tuple[int, list[float]]:
        """Number of words, and the score of each matched clause."""
        self.cache.age()
        known, miss = self.cache.young.get, self._miss
        tokens = _PIECE.findall(text)
        read = [known(t) or miss(t) for t in tokens]
        marks = [(k, e) for k, e in enumerate(read) if e[0] or e[2]]
        found: list[float] = []
        if not any(e[0] == INSULT or e[0] == THREAT for _, e in marks):
            return len(tokens), found
        state, total, at, weight_of_threat = 0, 0.0, -1, SEED_WEIGHT
        for k, (kind, weight, ends) in marks:
            for _ in range(min(k - at - 1, REACH)):
                state = MOVE[state][OTHER]
            at = k
            total += FACTOR[state][kind] * (weight_of_threat if kind == TARGET else weight)
            state = MOVE[state][kind]
            if ends:
                if total > 0:
                    found.append(total)
                state, total = 0, 0.0
        if total > 0:
            found.append(total)
        return len(tokens), found

    def features(self, text: str) -> list[float]:
        n, found = self.clauses(text)
        total, top = sum(found), max(found, default=0.0)
        return [np.log1p(total), np.log1p(top), np.log1p(100 * total / max(20, n)), float(bool(found)), np.log1p(len(found)), np.log1p(sum(x for x in found if x >= 3)), np.log1p(n / 100)]


@gives_back
def _evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with each entry, toxic and clean, of a partition of the sample, by fold."""
    counts = {1: Counter(), 0: Counter()}
    for batch in batches:
        for text, label, fold in zip(batch.column("text"), batch.column("label").to_pylist(), batch.column("fold").to_pylist()):
            words = {bare(t) for t in set(_PIECE.findall(text.as_py()))}
            counts[int(bool(label))].update({(b, fold) for w in words if w for b in beginnings(w)})
    keys = list(counts[1].keys() | counts[0].keys())
    arrays = [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int64()), *(pa.array([counts[x][k] for k in keys], pa.int64()) for x in (1, 0))]
    yield pa.RecordBatch.from_arrays(arrays, ["entry", "fold", "toxic", "clean"])


def learn_lexicons(sample: DataFrame) -> list[dict[str, float]]:
    """For each fold the lexicon that the other folds teach, and last that of all rows; each over the fixed list.

    A lexicon has all entries whose log odds between toxic and clean rows are high, also at the lower end of their
    confidence interval; the bounded sample bounds it. The weight is the log odds."""
    kinds = sample.groupBy("fold").agg(F.sum(F.when(F.col("label") > 0, 1).otherwise(0)).alias("t"), F.count(F.lit(1)).alias("n")).collect()
    counts = sample.select("text", "label", "fold").mapInArrow(_evidence, "entry string, fold long, toxic long, clean long").groupBy("entry")
    of_fold = [F.coalesce(F.sum(F.when(F.col("fold") == k, F.col(x))), F.lit(0)).alias(f"{x}_{k}") for x in ("toxic", "clean") for k in range(FOLDS)]
    counts = cut(counts.agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"), *of_fold).filter(F.col("toxic") >= LEAST_ROWS))
    found = []
    for left in range(FOLDS + 1):
        lexicon = {w: SEED_WEIGHT for w in INSULTS}
        found.append(lexicon)
        t = sum(r.t for r in kinds if r.fold != left)
        c = sum(r.n - r.t for r in kinds if r.fold != left)
        if not t or not c:
            continue
        toxic, clean = (F.col(x) - (F.col(f"{x}_{left}") if left < FOLDS else 0) for x in ("toxic", "clean"))
        odds = F.log((toxic + 0.5) / (t + 1.0)) - F.log((clean + 0.5) / (c + 1.0))
        sure = odds - CONFIDENCE * F.sqrt(1 / (toxic + 0.5) + 1 / (clean + 0.5))
        strong = counts.filter((toxic >= LEAST_ROWS) & (odds >= LEAST_ODDS) & (sure >= SURE_ODDS)).select("entry", odds.alias("odds"))
        for r in strong.collect():
            lexicon[r.entry] = max(lexicon.get(r.entry, 0.0), min(6.0, r.odds))
    return found


class Calibration:
    """Logistic regression on the clause features, by Newton steps with a ridge."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        if len(np.unique(y)) < 2:
            self.mean, self.scale, self.w = np.zeros(7), np.ones(7), np.array([0.0, 1.5, 0, 0, 0, 0, 0, -3.0])
            return
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        z = self._design(x)
        self.w = np.zeros(z.shape[1])
        ridge = np.full(z.shape[1], 1.0)
        ridge[-1] = 1e-3
        for _ in range(60):
            p = 1 / (1 + np.exp(-np.clip(z @ self.w, -30, 30)))
            gradient = z.T @ (p - y) + ridge * self.w
            step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(ridge), gradient)
            self.w -= step
            if np.abs(step).max() < 1e-8:
                break

    def _design(self, x: np.ndarray) -> np.ndarray:
        return np.c_[(x - self.mean) / self.scale, np.ones(len(x))]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self._design(x) @ self.w, -40, 40)))


class Model:
    """Lexicon and calibration; small, so it travels with the tasks."""

    def __init__(self, lexicon: dict[str, float], calibration: Calibration):
        self.lexicon, self.calibration = lexicon, calibration
        self.none = float(calibration.score(np.array([Grammar(lexicon).features("")]))[0])

    def scores(self, grammar: Grammar, texts) -> tuple[np.ndarray, np.ndarray]:
        """Score and number of matched clauses; a text without a match never scores over the empty text."""
        x = np.array([grammar.features(t or "") for t in texts], float).reshape(-1, 7)
        score = self.calibration.score(x)
        return np.where(x[:, 3] > 0, score, np.minimum(self.none, score)), np.rint(np.expm1(x[:, 4])).astype(np.int64)


def fit(docs: DataFrame, labels: DataFrame, rows: int = LABELLED_ROWS) -> Model:
    """A model taught by at most `rows` labelled rows that are not held out."""
    known = id_and_text(docs).join(F.broadcast(training_labels(labels, "toxic", rows)), "doc_id")
    sample = cut(known.withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(FOLDS))))
    lexicons = learn_lexicons(sample)

    @gives_back
    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        others = [Grammar(lexicon, 50_000) for lexicon in lexicons[:FOLDS]]
        for batch in batches:
            x = [others[k].features(t.as_py()) for t, k in zip(batch.column("text"), batch.column("fold").to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), batch.column("label")], ["x", "label"])

    fitted = sample.select("text", "label", "fold").mapInArrow(measured, "x array<double>, label int").limit(2 * rows).toPandas()
    return Model(lexicons[FOLDS], Calibration(np.array(fitted["x"].tolist(), float).reshape(-1, 7), fitted["label"].to_numpy(float)))


def score_documents(docs: DataFrame, labels: DataFrame, rows: int = LABELLED_ROWS) -> DataFrame:
    """doc_id, held_out, score and n_clauses (matched) of every row."""
    model = fit(docs, labels, rows)

    @gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Grammar(model.lexicon)
        for batch in batches:
            score, clauses = model.scores(own, batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score), pa.array(clauses)], ["doc_id", "score", "n_clauses"])

    scored = id_and_text(docs).mapInArrow(run, "doc_id long, score double, n_clauses long")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "n_clauses")


def clean_documents(docs: DataFrame, labels: DataFrame, least: float = 0.3) -> DataFrame:
    """The rows of docs whose text scores under `least`, with all their columns."""
    model = fit(docs, labels)

    @gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Grammar(model.lexicon)
        for batch in batches:
            score, _ = model.scores(own, pc.struct_field(batch.column("row"), "text").to_pylist())
            yield batch.filter(pa.array(score < least))

    rows = small_batches(docs).select(whole_rows(docs).alias("row"))
    return rows.mapInArrow(run, rows.schema).select("row.*")
