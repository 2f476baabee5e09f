"""Toxicity by a weighted finite-state pattern grammar.

Tokens are read as symbols: insult (with a weight), threat, target, negation, reported
speech, quote, other.  Five small transducers read the same symbols, each with a state of
its own; they are composed lazily into one machine whose states and steps are memoised.
Its output is a score for each clause that holds an insult or a threat: the best insult's
weight, lowered inside the scope of a negation or of reported speech, raised when the clause
names a target.  A document's score is a logistic function of its clause scores, so words
count by the clause they stand in.

Insult patterns (whole words and word beginnings) and their weights are log-odds counted on
labelled rows; the logistic weights are fitted on other labelled rows.  Learning reads about
``learn_rows`` labelled rows at most (chosen by a hash of the id) and keeps at most
``max_patterns`` patterns: both are bounds of the model.  Scoring covers all rows and whole
texts, in one pass without a shuffle.

Defined results: a NULL or empty text has no clause and gets the score of a text without
hits.  Labels that are NULL and rows without an id teach nothing.  With labels of one kind
only, or none, every score is that kind's share (0 without labels).  Columns of the input
are kept; results are added under the names asked for.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, functions as F

from findmill.llm.tables import packed, release_memory, unpacked

#: Function words of the grammar in English, German, French and Spanish.
NEGATION = "not no never nor nobody none nicht kein keine nie ne pas jamais aucun nunca jamás ni tampoco".split()
REPORTED = "said says told claimed wrote called quoted sagte schrieb nannte dit disait dijo decía llamó escribió".split()
TARGET = "you your yours he she they them him du dich dein ihr euch sie tu toi vous votre ils tú usted ustedes ellos".split()
THREAT = "kill hurt destroy beat stab shoot töten schlagen zerstören tuer frapper détruire matar golpear destruir".split()

#: Weights of the grammar, in the unit of the insult weights (log-odds).
NEGATED, IN_REPORT, AT_TARGET, THREAT_WEIGHT = -2.0, -1.5, 0.75, 3.0
#: Tokens that a negation, a threat or a target reaches.
REACH = 3

FEATURES = 5
PREFIXES = range(4, 9)
_CLAUSE = re.compile(r"[.!?;\n]+")
_TOKEN = re.compile(r"[^\W\d_]+|[\"“”„«»]")
_WORD = re.compile(r"[^\W\d_]+")
OTHER, INSULT, MENACE, AIM, NOT, SAID, QUOTE = range(7)


def _countdown(opens: int):
    """A transducer whose state is how many more tokens a symbol reaches."""
    return lambda state, symbol: REACH if symbol == opens else max(0, state - 1)


def _reported(state: int, symbol: int) -> int:
    """Reported speech: from a verb of saying to the end of the clause, or between quotes."""
    if symbol == QUOTE:
        return state ^ 2
    return state | 1 if symbol == SAID else state


MACHINES = (_countdown(NOT), _reported, _countdown(AIM), _countdown(MENACE), lambda state, symbol: state or int(symbol == AIM))


@dataclass
class Grammar:
    """The composed machine: ``step(state, symbol)`` gives the next state and what a hit weighs there."""

    steps: dict = field(default_factory=dict)

    def step(self, state: tuple, symbol: int) -> tuple[tuple, float]:
        found = self.steps.get((state, symbol))
        if found is None:
            negated, reported, _, threat, _ = state
            weight = NEGATED * (negated > 0) + IN_REPORT * (reported > 0)
            if symbol == AIM:
                weight += THREAT_WEIGHT if threat else -math.inf
            found = self.steps[state, symbol] = (tuple(m(s, symbol) for m, s in zip(MACHINES, state)), weight)
        return found

    def clause(self, symbols: list[tuple[int, float]]) -> float:
        """The best path's weight of a clause, given as (symbol, weight) pairs; 0 at least."""
        state, best = (0, 0, 0, 0, 0), 0.0
        for symbol, weight in symbols:
            state, change = self.step(state, symbol)
            if symbol in (INSULT, AIM) and weight + change > best:
                best = weight + change
        return best + (AT_TARGET if best and state[4] else 0.0)


class _Symbols(dict):
    """Symbol and weight of each word, worked out once; at most ``most`` words are kept."""

    def __init__(self, patterns: dict[str, float], most: int = 300_000):
        self.patterns, self.most = patterns, most
        self.fixed = {w: (s, 0.0) for s, words in ((MENACE, THREAT), (AIM, TARGET), (NOT, NEGATION), (SAID, REPORTED)) for w in words}
        self.fixed |= {q: (QUOTE, 0.0) for q in '"“”„«»'}

    def __missing__(self, word: str) -> tuple[int, float]:
        weight = max((self.patterns[p] for p in word_patterns(word) if p in self.patterns), default=0.0)
        found = (INSULT, weight) if weight else self.fixed.get(word, (OTHER, 0.0))
        if len(self) >= self.most:
            self.clear()
        self[word] = found
        return found


def word_patterns(word: str) -> list[str]:
    """The word itself, marked by ``$``, and its beginnings."""
    return [word + "$", *(word[:k] for k in PREFIXES if len(word) > k)]


class Scorer:
    """Clause scores of texts by learnt patterns."""

    def __init__(self, patterns: dict[str, float]):
        self.symbols, self.grammar = _Symbols(patterns), Grammar()

    def features(self, text: str | None) -> list[float]:
        """Best and second best clause, sum of strong clauses, their density, log of the clauses."""
        symbol_of, scores, clauses = self.symbols.__getitem__, [], 0
        for clause in _CLAUSE.split((text or "").lower()):
            symbols = list(map(symbol_of, _TOKEN.findall(clause)))
            if not symbols:
                continue
            clauses += 1
            if any(w for _, w in symbols) or any(s == MENACE for s, _ in symbols):
                if score := self.grammar.clause(symbols):
                    scores.append(score)
        scores.sort(reverse=True)
        first, second = (scores + [0.0, 0.0])[:2]
        strong = sum(s for s in scores if s >= 4.0)
        return [first, second, math.log1p(strong), strong / max(1, clauses), math.log1p(clauses)]


@dataclass
class Model:
    patterns: dict[str, float]
    weights: list[float]
    intercept: float | None
    #: The score of every text where nothing could be fitted.
    share: float = 0.0


def fold(key: Column, folds: int = 5) -> Column:
    """crc32 of the key's text modulo ``folds``; NULL for a NULL key."""
    return F.pmod(F.crc32(key.cast("string")), F.lit(folds))


#: Patterns that a task counts before it hands them over.
COUNTED = 100_000


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with each pattern, by label, summed inside a task."""
    counts: Counter = Counter()

    def flush():
        patterns, labels = zip(*counts)
        return pa.record_batch(
            [pa.array(patterns), pa.array(labels, pa.int32()), pa.array(list(counts.values()), pa.int64())],
            names=["pattern", "label", "n"],
        )

    for batch in batches:
        for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist()):
            found = {p for w in set(_WORD.findall((text or "").lower())) for p in word_patterns(w)}
            counts.update((p, label) for p in found)
        if len(counts) > COUNTED:
            yield flush()
            counts.clear()
    if counts:
        yield flush()
        counts.clear()
    release_memory()


def learn_patterns(
    rows: DataFrame, min_rows: int = 4, min_weight: float = 3.0, max_patterns: int = 20_000
) -> dict[str, float]:
    """Log-odds of the patterns of ``(text, label)`` rows that speak for label 1."""
    totals = {r.label: r.n for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not totals.get(1) or not totals.get(0):
        return {}
    counts = rows.select("text", "label").mapInArrow(_counted, "pattern string, label int, n long")
    counts = counts.groupBy("pattern").agg(
        F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).alias("with1"),
        F.sum(F.when(F.col("label") == 0, F.col("n")).otherwise(0)).alias("with0"),
    )
    weight = F.log((F.col("with1") + 0.5) / totals[1]) - F.log((F.col("with0") + 0.5) / totals[0])
    best = (
        counts.where(F.col("with1") >= min_rows).withColumn("weight", weight).where(F.col("weight") >= min_weight)
        .orderBy(F.desc("weight"), "pattern").limit(max_patterns)
    )
    return {r.pattern: r.weight for r in best.select("pattern", "weight").collect()}


def features_of(text: Column, patterns: dict[str, float]) -> Column:
    def features(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = Scorer(patterns)
        for texts in batches:
            yield pa.array([scorer.features(t.as_py()) for t in texts], pa.list_(pa.float64()))

    return F.arrow_udf(features, "array<double>")(text)


def learn(labelled: DataFrame, text: str, label: str, key: str, learn_rows: int = 20_000) -> Model:
    """Patterns from folds 1 to 3 and logistic weights from fold 4 of ``labelled``; fold 0 is never read."""
    rows = labelled.select(
        F.col(text).alias("text"), F.col(label).cast("int").alias("label"), fold(F.col(key)).alias("fold"),
        F.xxhash64(key).alias("pick"),
    ).where(F.col("label").isin(0, 1) & (F.col("fold") > 0))
    seen = rows.agg(F.count(F.lit(1)).alias("n"), F.avg("label").alias("share")).first()
    if not seen.n or seen.share in (0.0, 1.0):
        return Model({}, [], None, seen.share or 0.0)
    if seen.n > learn_rows:
        rows = rows.where(F.pmod("pick", F.lit(1 << 20)) < int(learn_rows / seen.n * (1 << 20)))
    patterns = learn_patterns(rows.where("fold < 4"))
    fit = rows.where("fold = 4").select(
        F.col("label").cast("double").alias("label"), array_to_vector(features_of(F.col("text"), patterns)).alias("features")
    )
    fitted = LogisticRegression(regParam=1e-3, maxIter=60).fit(fit) if fit.select("label").distinct().count() == 2 else None
    if fitted is None:
        return Model(patterns, [], None, seen.share)
    return Model(patterns, [float(w) for w in fitted.coefficients], float(fitted.intercept))


def score(docs: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with the probability of label 1."""
    if model.intercept is None:
        return docs.withColumn(name, F.lit(float(model.share)))
    scored = packed(docs, features=features_of(F.col(text), model.patterns))
    total = F.lit(model.intercept)
    for k, weight in enumerate(model.weights):
        total = total + F.col("features")[k] * weight
    return unpacked(scored, docs.columns, **{name: 1 / (1 + F.exp(-total))})
