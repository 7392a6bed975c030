import random
import zlib

import numpy as np
import pytest
from llm_tables import documents, rows_of

from crestline.llm import toxicity as tx


def pattern(text, words=None, starts=None):
    x = tx.features(text, tx.Lexicon(tx.fixed_words() | (words or {}), starts or {}), tx.Clause())
    return [n for n in range(tx.PATTERNS) if x[n]]


@pytest.mark.parametrize("text,patterns", [
    ("a fine day", []), ("what an idiot", [0]), ("you are an idiot", [1]), ("he is no idiot", [1 + 2]), ("that is not stupid", [2]),
    ("she said the idiot left", [4 + 1]), ("said the idiot", [4]), ("said so. the idiot left", [0]), ("\"idiot\"", [4]),
    ("you. idiot", [0]), ("i will kill you", [8]), ("kill time and go far away then you", []), ("kill. you", []), ("", []), (None, []),
    ("IDIOT!", [0]), ("Du Dummkopf", [1]),
])
def test_patterns(text, patterns):
    assert pattern(text) == patterns


def test_learned_arcs_prefer_the_longest():
    lexicon = tx.Lexicon({"blorping": (tx.OTHER, 0.0)}, {"blo": 1.0, "blorp": 3.0})
    assert lexicon.read("blorpa") == (tx.INSULT, 3.0) and lexicon.read("bloxx") == (tx.INSULT, 1.0)
    assert lexicon.read("blorping") == (tx.OTHER, 0.0) and lexicon.read("bl") == (tx.OTHER, 0.0)


def corpus(n=900):
    rng = random.Random(8)
    plain = [f"w{k}" for k in range(400)]
    bad = ["zarg", "zargen", "grubble"]
    rows, labels = [], []
    for i in range(n):
        words = rng.choices(plain, k=rng.randint(5, 60))
        toxic = rng.random() < 0.15
        for _ in range(rng.randint(2, 5) if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(bad) + rng.choice(["", "", "s"]))
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return rows, labels


def test_held_out_accuracy(spark):
    rows, labels = corpus()
    df, lf = documents(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in tx.judged(df, tx.fit(df, lf)).collect()}
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i, _ in rows)
    held = [(got[i]["predicted"], t) for i, t in labels if got[i]["held_out"]]
    assert sum(p == t for p, t in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got.values())
    clean = tx.keep_clean(df, lf)
    assert clean.columns == df.columns and clean.count() == sum(r["predicted"] == 0 for r in got.values())


def test_held_out_labels_teach_nothing(spark):
    rows, labels = corpus(300)
    held = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    df = documents(spark, rows)
    scores = [rows_of(tx.judged(df, tx.fit(df, spark.createDataFrame(own, "doc_id long, toxic int"))), "doc_id", "score")
              for own in (labels, [(i, 1 - t if held(i) else t) for i, t in labels])]
    assert scores[0] == scores[1]


def test_awkward_rows(spark):
    rows = [(1, None), (2, ""), (None, "you idiot"), (3, "you idiot " * 20_000), (4, "kind words"), (4, "kind words")]
    df = documents(spark, rows)
    labels = spark.createDataFrame([(1, None), (None, 1), (2, 0), (99, 1), (4, 0), (4, 0)], "doc_id long, toxic int")
    for taught in (labels, labels.limit(0)):
        got = rows_of(tx.judged(df, tx.fit(df, taught)), "doc_id", "held_out", "predicted")
        assert [(i, p) for i, _, p in got] == [(None, 1), (1, 0), (2, 0), (3, 1), (4, 0), (4, 0)] and got[0][1] is False
    empty = documents(spark, [])
    assert tx.judged(empty, tx.fit(empty, labels)).collect() == []


def test_logistic_regression():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, 2))
    y = (rng.random(2000) < 1 / (1 + np.exp(-(2 * x[:, 0] - x[:, 1] - 1)))).astype(int)
    assert np.allclose(tx.fitted(x, y), [2, -1, -1], atol=0.3)
