import hashlib
import random

import numpy as np
import pytest
from llm_tables import documents, rows_of

from crestline.llm import suffixes

COLUMNS = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
L = suffixes.LENGTH


def brute(rows):
    data = [(i, (t or "").encode()) for i, t in rows]
    first = {}
    for i, d in data:
        if i is not None:
            for n in range(len(d) - L + 1):
                first[d[n:n + L]] = min(first.get(d[n:n + L], i), i)
    out = []
    for i, d in data:
        gone = [False] * len(d)
        for n in range(len(d) - L + 1):
            if i is not None and first[d[n:n + L]] < i:
                gone[n:n + L] = [True] * L
        kept = bytes(b for b, g in zip(d, gone) if not g)
        spans = sum(g and not (n and gone[n - 1]) for n, g in enumerate(gone))
        out.append((i, len(d), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=lambda t: tuple((v is not None, v) for v in t))


def corpus(seed):
    rng = random.Random(seed)
    alphabet = "abcdefgh éÜ€\n"
    passages = ["".join(rng.choices(alphabet, k=rng.choice([30, 49, 50, 51, 80, 200, 700]))) for _ in range(8)]
    rows = []
    for n in range(120):
        text = ""
        for _ in range(rng.randint(0, 4)):
            if rng.random() < 0.5:
                p = rng.choice(passages)
                a = rng.randint(0, 10)
                text += p[a:rng.randint(a, len(p))] if rng.random() < 0.5 else p
            else:
                text += "".join(rng.choices(alphabet, k=rng.randint(0, 300)))
        rows.append((n * 7 % 120, text))
    # few distinct symbols: shared strings that overlap themselves
    rows += [(200 + n, "".join(rng.choices("ab", k=rng.randint(0, 90))) * rng.randint(1, 4)) for n in range(10)]
    rows += [(300, "x" * 400), (301, "x" * 49), (302, "ab" * 40), (303, "ba" * 40), (304, "x" * 60), (-5, "y" + "ab" * 30)]
    return rows


@pytest.mark.parametrize("crowd", [2, 20_000])
@pytest.mark.parametrize("seed", [1, 2])
def test_brute_force(spark, seed, crowd):
    """Also where most anchors are dealt out as windows."""
    rows = corpus(seed)
    assert rows_of(suffixes.without_repeats(documents(spark, rows).repartition(6), crowd=crowd), *COLUMNS) == brute(rows)


def test_small_collections_and_stretches(spark, monkeypatch):
    """A line of all documents, in batches of three; the last document has it far on."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        rng = random.Random(9)
        line = "a very common line that every document has, with many words in it. "
        rows = [(n, f"own{n} {rng.random()} {line}{rng.random()} tail{n}") for n in range(60)]
        for crowd in (5, 20_000):
            assert rows_of(suffixes.without_repeats(documents(spark, rows).repartition(5), crowd=crowd), *COLUMNS) == brute(rows)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "512")


def test_stretches_agree(monkeypatch):
    """Cut into stretches, a text has the same anchor for every window."""
    data = "".join(random.Random(3).choices("abc ", k=5000)).encode()

    def anchors(runs):
        return dict(zip(suffixes._windows(runs.starts, runs.lengths).tolist(), np.repeat(runs.anchors, runs.lengths).tolist()))

    whole = anchors(suffixes.Runs([data]))
    monkeypatch.setattr(suffixes, "STRETCH", 170)
    assert anchors(suffixes.Runs([data])) == whole and len(whole) == 5000 - L + 1


def test_joined_texts_stay_apart(monkeypatch):
    """Texts that are hashed together have the runs that each has on its own."""
    rng = random.Random(6)
    texts = ["".join(rng.choices("ab ", k=rng.choice([0, 10, 49, 50, 51, 99, 300]))).encode() for _ in range(60)]
    for joined in (1, 400, 1 << 17):
        monkeypatch.setattr(suffixes, "JOINED", joined)
        runs = suffixes.Runs(texts)
        for n, data in enumerate(texts):
            one, own = suffixes.Runs([data]), runs.texts == n
            for column in ("starts", "lengths", "places", "anchors"):
                assert getattr(runs, column)[own].tolist() == getattr(one, column).tolist()
            assert one.lengths.sum() == max(len(data) - L + 1, 0)


def test_collection_orders_and_common_prefixes():
    rng = random.Random(1)
    strings = ["".join(rng.choices("ab", k=12)).encode() for _ in range(40)] + [b"a" * 12] * 3
    c = suffixes.Collection(np.array([list(s) for s in strings], np.uint8).T.copy())
    for at in range(11, -1, -1):
        c.insert()
        tails = [strings[i][at:] for i in c.order]
        assert tails == sorted(tails)
        for x, y, n in zip(tails, tails[1:], c.common[1:].tolist()):
            same = next((i for i, (a, b) in enumerate(zip(x, y)) if a != b), len(x))
            assert n == same if same < len(x) else n >= same


def test_nulls_repeats_and_long(spark):
    text = "".join(random.Random(2).choices("abcdefghij ", k=300))
    long = "".join(random.Random(8).choices("abcdefghij ", k=400_000))
    rows = [(1, None), (2, ""), (3, text), (3, text), (3, "x" + text[:100]), (4, text + "!"), (None, text), (None, "z" + text),
            (5, long), (6, long[1000:300_000]), (7, " \n")]
    got = rows_of(suffixes.without_repeats(documents(spark, rows, ("id", "key", "data", "place", "n_bytes", "shared"))), *COLUMNS)
    assert got == brute(rows)


def test_kept_bytes(spark):
    text = "".join(random.Random(2).choices("abcdefghij ", k=80))
    got = suffixes.without_repeats(documents(spark, [(1, text), (2, f"é{text}ü")])).collect()
    assert {r["doc_id"]: r["kept"] for r in got} == {1: text.encode(), 2: "éü".encode()}


def test_empty(spark):
    assert suffixes.without_repeats(documents(spark, [])).collect() == []
