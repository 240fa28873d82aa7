"""Toxicity by a weighted finite-state pattern grammar.

Each token of a clause has a class: insult, threat, target, negation, reported speech, or other. One
transducer for each kind reads the classes: insult and threat put out the token's weight, target raises
it in a clause that addresses someone, negation lowers it for the next tokens, reported speech lowers it
to the clause's end. Their composition is one table over product states, through which a clause runs
once; its score is the sum of what comes out. A text's score is a logistic function of its matched
clauses: sum, largest, and number. Clauses without an insult or threat have score 0 whatever else they
hold, so only clauses around such tokens are run.

Token weights are learned from labelled rows, at most `sample_rows` of them, the first by a hash of
doc_id: words and word beginnings whose smoothed log-odds between toxic and other texts are high. The
logistic function is fitted on the third of the sample that the lexicon was not learned from.

Rows whose crc32(doc_id as text) mod 4 is 2 are held out: no label of theirs is read. Labels, lang, source and
doc_id are no inputs of a score.

Edge cases: a null or empty text has no clauses and the score of such texts. A null doc_id is scored,
and counts as not held out. Null labels are left out; of several labels of a doc_id the largest counts.
Without labels the seed lexicon alone scores. Repeated rows give repeated results, an empty table an empty
one. Extra columns are ignored. Long texts are read whole.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewave.llm.common import drop_stored, stored

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)
# seeds of each class, in English, German, French and Spanish
SEED_INSULTS = "idiot idiots moron morons stupid pathetic worthless disgusting scum scumbag trash loser losers clown imbecile vermin".split()
SEED_THREATS = "kill murder strangle slaughter exterminate umbringen töten tuer égorger matar degollar".split()
TARGETS = "you your yours he him his she her they them their those these du dich dein deine ihr euch sie tu toi vous votre ils elles tú te usted ustedes ellos ellas vosotros".split()
NEGATIONS = "not never no nobody isn't aren't wasn't don't doesn't didn't without nicht nie kein keine ohne pas jamais sans nunca jamás sin".split()
REPORTS = "said says say claimed claims quoted quote wrote allegedly reportedly called sagte sagt zitiert dit disait dijo dice".split()
SEED_WEIGHT = 3.0
TOKEN = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
CLAUSE = re.compile(r"[.!?;:\n|]+")
PREFIXES = (5, 6)


class Machine:
    """A deterministic transducer over the token classes: step(state, class) -> (state, factor)."""

    def __init__(self, start, step):
        self.start, self.step = start, step


def negation(scope: int = 4, factor: float = 0.6) -> Machine:
    def step(left: int, kind: int) -> tuple[int, float]:
        return (scope, 1.0) if kind == NEGATION else (max(left - 1, 0), factor if left else 1.0)

    return Machine(0, step)


def reported(factor: float = 0.8) -> Machine:
    return Machine(False, lambda on, kind: (on or kind == REPORT, factor if on else 1.0))


def target(factor: float = 1.25) -> Machine:
    return Machine(False, lambda on, kind: (on or kind == TARGET, factor if on else 1.0))


def emits(which: int) -> Machine:
    """Puts out the token's weight for its class, else nothing."""
    return Machine(0, lambda state, kind: (state, 1.0 if kind == which else 0.0))


class Grammar:
    """The composition of the machines: the product's reachable states, and for each class what comes out."""

    def __init__(self):
        shared = [target(), negation(), reported()]
        sources = [emits(INSULT), emits(THREAT)]
        start = tuple(m.start for m in shared + sources)
        number, todo = {start: 0}, [start]
        self.next: list[list[int]] = []
        self.factor: list[list[float]] = []
        while todo:
            state = todo.pop(0)
            row, out = [], []
            for kind in range(6):
                moved = [m.step(s, kind) for m, s in zip(shared + sources, state)]
                to = tuple(x[0] for x in moved)
                if to not in number:
                    number[to] = len(number)
                    todo.append(to)
                row.append(number[to])
                out.append(math.prod(x[1] for x in moved[:3]) * sum(x[1] for x in moved[3:]))
            self.next.append(row)
            self.factor.append(out)

    def clause(self, kinds: list[int], weights: list[float]) -> float:
        state, total = 0, 0.0
        for kind, weight in zip(kinds, weights):
            total += weight * self.factor[state][kind]
            state = self.next[state][kind]
        return total


GRAMMAR = Grammar()


class Lexicon:
    """weights: of words (w) and of word beginnings (p*)."""

    CACHE = 200_000

    def __init__(self, weights: dict[str, float]):
        self.weights = weights
        self.classes = dict.fromkeys(TARGETS, TARGET) | dict.fromkeys(NEGATIONS, NEGATION) | dict.fromkeys(REPORTS, REPORT)
        self.known: dict[str, float] = {}

    def weight(self, token: str) -> float:
        w = self.known.get(token)
        if w is None:
            if len(self.known) >= self.CACHE:
                self.known.clear()
            get = self.weights.get
            w = self.known[token] = max([get(token, 0.0), *(get(token[:n] + "*", 0.0) for n in PREFIXES if len(token) > n)])
        return w

    def features(self, text: str) -> tuple[float, float, float]:
        """Sum and largest of the clause scores, matched clauses."""
        total = most = n = 0.0
        text = text.lower()
        weight = self.weight
        if not any(map(weight, set(TOKEN.findall(text)))):
            return 0.0, 0.0, 0.0
        for clause in CLAUSE.split(text):
            tokens = TOKEN.findall(clause)
            weights = [weight(t) for t in tokens]
            if any(weights):
                kinds = [(THREAT if t in SEED_THREATS else INSULT) if w else self.classes.get(t, OTHER) for t, w in zip(tokens, weights)]
                score = GRAMMAR.clause(kinds, weights)
                if score > 0:
                    total, most, n = total + score, max(most, score), n + 1
        return total, most, n


def inputs(features: np.ndarray) -> np.ndarray:
    return np.c_[np.ones(len(features)), np.log1p(features[:, 0]), np.minimum(features[:, 1], 20) / 4, np.log1p(features[:, 2])]


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.5, rounds: int = 30) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1])
        step = np.linalg.solve(h, x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _fold(doc_id: Column) -> Column:
    """0 or 1: learns the lexicon; 2: fits the logistic function."""
    return F.pmod(F.xxhash64(doc_id, F.lit("fold")), F.lit(3))


def labelled_sample(docs: DataFrame, labels: DataFrame, sample_rows: int) -> DataFrame:
    """(text, toxic, fold) of at most sample_rows labelled rows that aren't held out."""
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    usable = usable.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    # at most sample_rows pairs of numbers: small enough to broadcast at any size of the tables
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return texts.join(F.broadcast(chosen), "doc_id").select("text", "toxic", _fold(F.col("doc_id")).alias("fold"))


def learn_lexicon(sample: DataFrame, least_texts: int = 5, least_odds: float = 4.0, most_entries: int = 20_000) -> dict[str, float]:
    """Log-odds of the words and beginnings that mark toxic texts, and of the seeds that don't mark other texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: dict[tuple[str, int], int] = {}
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = set(TOKEN.findall(text.lower()))
                found = words | {w[:n] + "*" for w in words for n in PREFIXES if len(w) > n}
                for f in found:
                    counts[f, toxic] = counts.get((f, toxic), 0) + 1
            keys = list(counts)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array(list(counts.values()), pa.int64())], ["feature", "toxic", "n"])

    learn = sample.where("fold != 2").select("text", F.col("toxic").cast("int").alias("toxic"))
    n_toxic, n_other = learn.agg(F.coalesce(F.sum(F.when(F.col("toxic") == 1, 1)), F.lit(0)), F.coalesce(F.sum(F.when(F.col("toxic") != 1, 1)), F.lit(0))).first()
    weights = dict.fromkeys(SEED_INSULTS + SEED_THREATS, SEED_WEIGHT)
    if not n_toxic or not n_other:
        return weights
    counts = learn.mapInArrow(run, "feature string, toxic int, n long").groupBy("feature").agg(F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("t"), F.sum(F.when(F.col("toxic") == 1, 0).otherwise(F.col("n"))).alias("o"))
    odds = F.log((F.col("t") + 0.5) / n_toxic) - F.log((F.col("o") + 0.5) / n_other)
    scored = counts.withColumn("odds", odds)
    marks = scored.where((F.col("t") >= least_texts) & (F.col("odds") >= least_odds)).orderBy(F.desc("t"), "feature").limit(most_entries)
    for row in marks.collect():
        weights[row.feature] = min(row.odds, 6.0)
    for row in scored.where(F.col("feature").isin(*SEED_INSULTS, *SEED_THREATS) & (F.col("o") >= 3) & (F.col("odds") < 1)).collect():
        weights.pop(row.feature, None)
    return weights


def _features(texts: DataFrame, weights: dict[str, float], keep: list[str], schema: str) -> DataFrame:
    shipped = texts.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(shipped.value)
        for batch in batches:
            f = [lexicon.features(x.as_py()) for x in batch.column(0)]
            cols = list(zip(*f)) if f else [[], [], []]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *[pa.array(c, pa.float64()) for c in cols]], [*keep, "total", "most", "n"])

    return texts.select("text", *keep).mapInArrow(run, f"{schema}, total double, most double, n double")


def toxicity_scores(docs: DataFrame, labels: DataFrame, sample_rows: int = 12_000, threshold: float = 0.3) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted, clauses (matched)."""
    sample = stored(labelled_sample(docs, labels, sample_rows), "labelled-sample")  # documents are scanned once for it, and once for the scores
    weights = learn_lexicon(sample)
    fit = _features(sample.where("fold = 2").select("text", F.col("toxic").cast("int").alias("toxic")), weights, ["toxic"], "toxic int").collect()  # at most sample_rows rows of four numbers
    drop_stored(sample)
    y = np.array([1.0 if r.toxic == 1 else 0.0 for r in fit])
    x = np.array([[r.total, r.most, r.n] for r in fit]).reshape(-1, 3)
    w = logistic(inputs(x), y) if y.any() and not y.all() else np.array([-3.0, 2.0, 1.0, 0.0])
    own = docs.select(F.coalesce(F.col("text"), F.lit("")).alias("text"), F.col("doc_id").cast("long").alias("doc_id"))
    scored = _features(own, weights, ["doc_id"], "doc_id long")
    z = F.lit(float(w[0])) + float(w[1]) * F.log1p("total") + float(w[2]) * F.least("most", F.lit(20.0)) / 4 + float(w[3]) * F.log1p("n")
    score = 1 / (1 + F.exp(-z))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score.alias("score"), F.when(score >= threshold, 1).otherwise(0).alias("predicted"), F.col("n").cast("long").alias("clauses"))
