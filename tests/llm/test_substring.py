import hashlib
import random
import re

import pytest
from llm_tables import documents, rows_of

from crestline.llm import substring

COLUMNS = ("doc_id", "n_words", "n_removed", "kept_sha256")


def brute(rows, length=20):
    first = {}
    split = [(i if i is not None else -10**30, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    for i, w in split:
        for n in range(len(w) - length + 1):
            key = tuple(w[n:n + length])
            first[key] = min(first.get(key, (i, n)), (i, n))
    out = []
    for (i, _), (order, w) in zip(rows, split):
        gone = [False] * len(w)
        for n in range(len(w) - length + 1):
            if first[tuple(w[n:n + length])] < (order, n):
                gone[n:n + length] = [True] * length
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=lambda t: tuple((v is not None, v) for v in t))


def corpus(seed):
    rng = random.Random(seed)
    words = [f"w{n}" for n in range(30)]
    passages = [rng.choices(words, k=rng.choice([19, 20, 21, 40, 90])) for _ in range(8)]
    rows = []
    for n in range(120):
        text = []
        for _ in range(rng.randint(0, 4)):
            if rng.random() < 0.5:
                p = rng.choice(passages)
                a = rng.randint(0, 10)
                text += p[a:rng.randint(a, len(p))] if rng.random() < 0.5 else p
            else:
                text += rng.choices(words + ["é", "Ü."], k=rng.randint(0, 60))
        rows.append((n * 7 % 120, rng.choice([" ", "\n", " \t\x0b"]).join(text)))
    # few distinct words: overlapping repeats inside one document
    rows += [(200 + n, " ".join(rng.choices("ab", k=rng.randint(0, 300)))) for n in range(10)]
    rows += [(300, "x " * 500), (301, "x " * 25), (302, "a b " * 30), (303, "b a " * 30)]
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_brute_force(spark, seed):
    rows = corpus(seed)
    assert rows_of(substring.without_repeats(documents(spark, rows).repartition(6)), *COLUMNS) == brute(rows)


def test_across_batches(spark, monkeypatch):
    """A line of all documents, seen once or often in a batch."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        line = " ".join(f"l{n}" for n in range(25))
        rows = [(n, f"own{n} {line} tail{n}") for n in range(40)]
        assert rows_of(substring.without_repeats(documents(spark, rows).repartition(5)), *COLUMNS) == brute(rows)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "512")


def test_nulls_repeats_and_long(spark):
    text = " ".join(f"n{n}" for n in range(30))
    long = " ".join(f"l{n % 7000}" for n in range(30_000))
    rows = [(1, None), (2, ""), (3, text), (3, text), (4, text), (None, text), (5, long), (6, " \n")]
    assert rows_of(substring.without_repeats(documents(spark, rows)), *COLUMNS) == brute(rows)


def test_stage_keeps_rows_and_columns(spark):
    text = "  ".join(f"n{n}" for n in range(30))
    df = documents(spark, [(1, text), (2, f"mine {text} end"), (3, "a  b"), (4, None)])
    left = substring.remove_repeats(df)
    assert left.columns == df.columns and dict(left.dtypes) == dict(df.dtypes)
    assert rows_of(left, "doc_id", "text", "n_chars", "row") == [
        (1, text, len(text), "own row"), (2, "mine end", 8, "own row"), (3, "a  b", 4, "own row"), (4, None, 0, "own row")]


def test_empty(spark):
    assert substring.without_repeats(documents(spark, [])).collect() == []
    assert substring.remove_repeats(documents(spark, [])).count() == 0
