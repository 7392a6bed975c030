"""Toxicity as a weighted finite-state pattern grammar over clauses.

A lexical transducer reads a word's letters and gives a symbol and a weight: insult, threat, target,
negation, report, or other. Its arcs are a short fixed vocabulary and arcs (whole words and word
beginnings) learned from labelled texts as log odds. Five small machines read a clause's symbols:

* insult: matches an insult; * threat: matches a threat that is followed by a target;
* target: is on for some words behind a target; * negation: is on for some words behind a negation;
* report: is on from a word of saying or an opening quote to the end of the clause.

Their product is one machine, compiled as its states are met. A match is not a word but a pattern, the
insult or threat with the states of the other machines (aimed, negated, reported). The matches' weights add
up per pattern; a logistic regression over these sums and the number and share of matching clauses gives the
score.

The grammar is fitted on at most ``SAMPLE`` labelled rows, those with the smallest hash of their id, of which
texts with the same beginning teach once. Every document is scored whole, in one pass without a shuffle.

Defined results: null and empty texts get the score of no match; labels that are null teach nothing, of
several labels of a document the highest counts; without both classes the fixed weights ``PRIOR`` hold; a
null doc_id is not held out and teaches nothing.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crestline.llm.common import query, small_batches, table, written

#: Labelled rows that the grammar is fitted on, and arcs it learns, at most.
SAMPLE, ARCS = 20_000, 5_000
THRESHOLD = 0.7
#: A learned arc needs these log odds and this many standard deviations above chance; weights end at MOST.
ODDS, SIGMAS, MOST = 2.5, 6.0, 6.0
PREFIXES = (3, 9)
#: Words of a text that tell whether it begins like another.
OPENING = 10
REACH = 4  # words that a target or negation stays on, and that a threat waits for its target

WORD = re.compile(r"\w+")
TOKEN = re.compile(r"\w+|[.!?;:,\n\"“„«]")
ENDS, QUOTES = frozenset(".!?;:,\n"), frozenset("\"“„«")
OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)
VOCABULARY = {
    INSULT: "idiot moron stupid imbecile dumb fool loser scum trash worthless pathetic disgusting dumm dummkopf trottel "
            "abschaum idiota estúpido imbécil basura stupide crétin débile ordure",
    THREAT: "kill hurt destroy beat shoot stab burn punish töten schlagen vernichten matar golpear quemar tuer frapper brûler",
    TARGET: "you your yours yourself he him she her they them their du dich dir euch sie ihr tú te ti usted ustedes "
            "ellos tu toi vous ils eux",
    NEGATION: "not never no none nobody nothing without isn aren don doesn nicht kein keine nie ohne nunca ningún sin "
              "pas jamais sans aucun",
    REPORT: "said says say saying told wrote writes called calls claimed claims quoted according sagte sagt schrieb "
            "dijo dice escribió dit disait écrit",
}
FIXED_WEIGHT = 2.0
PATTERNS = 8 + 1  # insults by (aimed, negated, reported), threats
FEATURES = PATTERNS + 3
#: Weights of the features, and the constant, where nothing can be learned.
PRIOR = np.array([1.0, 1.5, 0.2, 0.4, 0.4, 0.8, 0.1, 0.2, 1.0, 0.5, 0.5, 0.3, -3.0])


class Lexicon:
    """Transducer from words to (symbol, weight); the longest arc counts, whole words before beginnings."""

    def __init__(self, words: dict[str, tuple[int, float]], starts: dict[str, float]) -> None:
        self.words, self.starts = words, starts
        self.longest = max(map(len, starts), default=0)
        self.roots = {s[:PREFIXES[0]] for s in starts}

    def read(self, word: str) -> tuple[int, float]:
        got = self.words.get(word)
        if got is not None:
            return got
        if word[:PREFIXES[0]] in self.roots:
            for n in range(min(len(word), self.longest), PREFIXES[0] - 1, -1):
                weight = self.starts.get(word[:n])
                if weight is not None:
                    return INSULT, weight
        return OTHER, 0.0


def fixed_words() -> dict[str, tuple[int, float]]:
    return {w: (symbol, FIXED_WEIGHT) for symbol, ws in VOCABULARY.items() for w in ws.split()}


class Clause:
    """Product of the five machines; state: (aimed for, negated for, reported, a threat waits for)."""

    START = (0, 0, False, 0)

    def __init__(self) -> None:
        self.table: dict[tuple, tuple] = {}

    def step(self, state: tuple, symbol: int) -> tuple[tuple, int | None]:
        """Next state and the pattern that is matched, if any."""
        key = (state, symbol)
        got = self.table.get(key)
        if got is None:
            got = self.table[key] = self._compose(state, symbol)
        return got

    @staticmethod
    def _compose(state: tuple, symbol: int) -> tuple[tuple, int | None]:
        aimed, negated, reported, waits = state
        match = None
        if symbol == INSULT:
            match = (aimed > 0) + 2 * (negated > 0) + 4 * reported
        elif symbol == TARGET and waits:
            match = PATTERNS - 1
        return (REACH if symbol == TARGET else max(0, aimed - 1), REACH if symbol == NEGATION else max(0, negated - 1),
                reported or symbol == REPORT, REACH if symbol == THREAT else 0 if symbol == TARGET else max(0, waits - 1)), match


def features(text: str | None, lexicon: Lexicon, clause: Clause) -> np.ndarray:
    """Sums of match weights by pattern (logarithmic), matching clauses, distinct matched words, share."""
    out = np.zeros(FEATURES)
    low = (text or "").lower()
    words, starts, roots = lexicon.words, lexicon.starts, lexicon.roots
    found = WORD.findall(low)
    if not any(w in words or w[:3] in roots for w in found):
        return out
    state, clauses, distinct, open_ = Clause.START, 0, set(), False
    held = 0.0  # weight of the threat that waits
    for token in TOKEN.findall(low):
        if token in ENDS:
            clauses += open_
            state, open_ = Clause.START, False
            continue
        symbol, weight = (REPORT, 0.0) if token in QUOTES else lexicon.read(token)
        state, match = clause.step(state, symbol)
        if symbol == THREAT:
            held = weight
        if match is not None:
            out[match] += held if match == PATTERNS - 1 else weight
            open_ = True
            distinct.add(token)
    clauses += open_
    out[PATTERNS:] = clauses, len(distinct), 1000 * clauses / len(found)
    return np.log1p(out)


def learned(rows: DataFrame, toxic: int, clean: int) -> tuple[dict[str, float], dict[str, float]]:
    """Weights of whole words and of word beginnings from ``rows`` (text, toxic)."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = {0: Counter(), 1: Counter()}
            for text, label in zip(*(c.to_pylist() for c in batch.columns)):
                n[label].update(set(WORD.findall(text.lower())))
            words = list(n[0].keys() | n[1].keys())
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([n[1][w] for w in words], pa.int64()),
                                              pa.array([n[0][w] for w in words], pa.int64())], names=["word", "t", "c"])

    words = rows.select("text", "toxic").mapInArrow(count, "word string, t long, c long").groupBy("word").agg(
        F.sum("t").alias("t"), F.sum("c").alias("c"))
    share = toxic / (toxic + clean)
    n = F.col("t") + F.col("c")
    odds = F.log((F.col("t") + 0.5) / (toxic + 1)) - F.log((F.col("c") + 0.5) / (clean + 1))
    sure = (F.col("t") - n * share) / F.sqrt(n * share * (1 - share)) >= SIGMAS

    def best(counted: DataFrame) -> dict[str, float]:
        top = counted.withColumn("odds", odds).filter((F.col("odds") >= ODDS) & sure).orderBy(F.desc("t"), "word").limit(ARCS)
        return {r["word"]: min(MOST, r["odds"]) for r in top.collect()}

    lengths = F.sequence(F.lit(PREFIXES[0]), F.least(F.lit(PREFIXES[1]), F.length("word") - 1))
    beginnings = words.filter(F.length("word") > PREFIXES[0]).select(
        F.explode(F.transform(lengths, lambda k: F.substring("word", F.lit(1), k))).alias("word"), "t", "c")
    return best(words), best(beginnings.groupBy("word").agg(F.sum("t").alias("t"), F.sum("c").alias("c")))


def fitted(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights of a logistic regression, the constant last, by Newton's method."""
    x = np.column_stack([x, np.ones(len(x))])
    penalty = np.append(np.full(x.shape[1] - 1, ridge), 1e-6)
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty + 1e-9), x.T @ (y - p) - penalty * w)
        w += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-6:
            break
    return w


class Grammar:
    """A fitted grammar: lexicon and feature weights."""

    def __init__(self, lexicon: Lexicon, weights: np.ndarray) -> None:
        self.lexicon, self.weights = lexicon, weights

    def scores(self, texts: Iterator[str | None]) -> list[float]:
        clause = Clause()
        return [self.score(features(t, self.lexicon, clause)) for t in texts]

    def score(self, x: np.ndarray) -> float:
        z = float(x @ self.weights[:-1] + self.weights[-1])
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))

    def column(self, text: Column) -> Column:
        @F.pandas_udf("double")
        def toxicity(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for batch in batches:
                yield pd.Series(self.scores(batch), dtype="float64")

        return toxicity(text)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("long").cast("string")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Grammar:
    """The grammar of the labelled documents that are not held out."""
    small_batches(docs.sparkSession)
    ids = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").filter(~held_out(F.col("doc_id"))).groupBy(
        F.col("doc_id").cast("long").alias("id")).agg((F.max("toxic") > 0).cast("int").alias("toxic")).orderBy(
        F.xxhash64("id"), "id").limit(sample)
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    opening = F.array_join(F.slice(F.split("text", r"\s+", OPENING + 1), 1, OPENING), " ")
    # at most ``sample`` narrow rows are broadcast, and as many texts kept
    rows = written(texts.join(F.broadcast(ids), "id").withColumn("opening", opening).groupBy("opening").agg(
        F.min_by(F.struct("text", "toxic"), F.col("id")).alias("row")).select("row.*"), "toxicity-sample")
    n = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    if len(n) < 2:
        return Grammar(Lexicon(fixed_words(), {}), PRIOR)
    words, starts = learned(rows, n[1], n[0])
    known = fixed_words() | {w: (INSULT, weight) for w, weight in words.items()}
    lexicon = Lexicon(known, starts)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        clause = Clause()
        for batch in batches:
            x = [features(t, lexicon, clause).tolist() for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), batch.column(1)], names=["x", "toxic"])

    data = rows.select("text", "toxic").mapInArrow(extract, "x array<double>, toxic int").toPandas()
    return Grammar(lexicon, fitted(np.stack(data["x"].to_numpy()), data["toxic"].to_numpy()))


def judged(docs: DataFrame, grammar: Grammar) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), held_out(F.col("doc_id")).alias("held_out"),
                       grammar.column(F.col("text")).alias("score")).withColumn(
        "predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, below the threshold."""
    return docs.filter(fit(docs, labels).column(F.col("text")) < THRESHOLD)


@query("op4_toxicity")
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return judged(docs, fit(docs, table(spark, sf_dir, "labels")))
