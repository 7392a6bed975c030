import math
import random

import numpy as np
import pytest
from llm_tables import CLASHES
from pyspark.sql import functions as F

from crestline.llm import maxscore


def vectors(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    return df.withColumns({c: F.lit(1) for c in CLASHES})


def brute(rows, asks, k):
    seen = []
    for i, v in rows:
        if v is not None and all(x is not None and math.isfinite(x) for x in v):
            own = (i, tuple(math.floor(1024 * float(np.float32(x))) for x in v))
            if own not in seen:
                seen.append(own)
    out = []
    for i, q in seen:
        if i is not None and asks(i):
            best = sorted((-sum(a * b for a, b in zip(q, v)), j is None, j or 0) for j, v in seen if j != i)[:k]
            out += [(i, r + 1, None if none else j, -s) for r, (s, none, j) in enumerate(best)]
    return sorted(out, key=str)


@pytest.mark.parametrize("seed,size,negative", [(1, 16, True), (2, 16, False), (3, 3, True)])
def test_brute_force(spark, monkeypatch, seed, size, negative):
    monkeypatch.setattr(maxscore, "SHARD_ROWS", 60)
    monkeypatch.setattr(maxscore, "BLOCK_QUERIES", 7)
    rng = random.Random(seed)
    # few distinct values: many ties
    rows = [(n, [rng.choice([-0.5, 0.0, 0.25, 1.0] if negative else [0.0, 0.0, 0.25, 1.0]) for _ in range(size)]) for n in range(400)]
    rows += [(1000, None), (1001, []), (1002, [None] * size), (1003, [float("nan")] + [0.0] * (size - 1)),
             (1004, [float("inf")] * size), (1005, [1.0]), (None, [1.0] * size), (30, rows[30][1]), (20, [1.0] * size)]
    got = maxscore.search(vectors(spark, rows), "vec_id % 10 = 0", 10).collect()
    got = sorted((tuple(r[c] for c in ("query_id", "rank", "vec_id", "score")) for r in got), key=str)
    assert got == brute(rows, lambda i: i % 10 == 0, 10)


def test_few_and_none(spark):
    assert maxscore.search(vectors(spark, []), "vec_id % 10 = 0").collect() == []
    assert maxscore.search(vectors(spark, [(0, [1.0])]), "vec_id % 10 = 0").collect() == []
    got = maxscore.search(vectors(spark, [(0, [1.0]), (1, [-1.0])]), "vec_id % 10 = 0").collect()
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got] == [(0, 1, 1, -1024 * 1024)]


def test_pruning_reads_less():
    rng = np.random.default_rng(5)
    matrix = (rng.random((4000, 32)) < 0.05) * rng.integers(1, 1000, (4000, 32))
    shard = maxscore.Shard(np.arange(4000), matrix)
    q = np.zeros(32, dtype=np.int64)
    q[:4] = [900, 3, 2, 1]
    rows, scores = shard.top(-1, q, 5)
    want = np.sort(matrix @ q)[::-1][:5]
    assert scores.tolist() == want.tolist()
