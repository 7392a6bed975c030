import random
import re

import pytest
from llm_tables import documents, rows_of

from crestline.llm import neardup
from crestline.llm.graph import components


def shingle_set(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(w[n:n + 5]) for n in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    """Rows have distinct ids."""
    sets = {i: shingle_set(t) for i, t in rows}
    label = {i: i for i in sets}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1:]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 85 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                label[y] = x
    return sorted((i, len(sets[i]), root(i), root(i) == i) for i in ids)


COLUMNS = ("doc_id", "n_shingles", "component_id", "kept")


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**9)}"
    return words


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{n}" for n in range(500)]
    texts = []
    for _ in range(25):  # families around and below the threshold
        base = rng.choices(vocabulary, k=rng.randint(4, 300))
        texts += [" ".join(edited(rng, base, rng.choice([0, 0, 1, 1, 2, 3, 5]))) for _ in range(rng.randint(1, 8))]
    chain = rng.choices(vocabulary, k=200)  # each step near the one before, the ends far apart
    for _ in range(12):
        texts.append(" ".join(chain))
        chain = edited(rng, chain, 2)
    hot = rng.choices(vocabulary, k=150)  # variants that are near the base, many not near each other
    texts += [" ".join(edited(rng, hot, rng.choice([1, 2, 3]))) for _ in range(60)]
    texts += ["", " \n", "one", "One", "a b c d", "A B c D", "a b c d e", "\x0b a\tb c d e", "É a b c d e", "é a b c d e"]
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("seed", [1, 2])
def test_brute_force(spark, seed):
    rows = corpus(seed)
    assert rows_of(neardup.clusters(documents(spark, rows).repartition(7)), *COLUMNS) == brute(rows)


def test_hot_group_of_copies(spark):
    base = " ".join(f"h{n}" for n in range(80))
    rows = [(n, base if n % 3 else f"{base} tail{n}") for n in range(300)]
    assert rows_of(neardup.clusters(documents(spark, rows)), *COLUMNS) == brute(rows)


def test_variants_of_one_text_rarely_meet(spark, monkeypatch):
    """Variants of one text that are not near each other met pair by pair in the prefix join: 1,371 of these rows."""
    rng = random.Random(5)
    base = [f"b{n}" for n in range(150)]
    rows = [(n, " ".join(edited(rng, base, rng.choice([1, 2, 3, 3, 4, 5])))) for n in range(250)]
    counts, real = [], neardup.confirmed
    monkeypatch.setattr(neardup, "confirmed", lambda pairs, *a: counts.append(pairs.count()) or real(pairs, *a))
    assert rows_of(neardup.clusters(documents(spark, rows)), *COLUMNS) == brute(rows)
    assert sum(counts[1 + neardup.PIVOT_ROUNDS:]) < len(rows), counts


def test_differences_need_not_share_anything(spark):
    """All near pairs meet, or are near the pivot because each differs little from it."""
    rng = random.Random(6)
    base = [f"b{n}" for n in range(120)]
    far = edited(rng, base, 4)
    texts = [base, far, *(edited(rng, base, 1) for _ in range(20)), *(edited(rng, far, k % 3) for k in range(20)), base[:100], far[7:]]
    rows = list(enumerate(map(" ".join, texts)))
    node = spark.createDataFrame([(n, 0) for n, _ in rows], "node long, family long")
    sets = neardup._full_sets(documents(spark, rows), node.select("node"))
    differences = neardup._differences(node, sets)
    early = neardup._early(differences, 85)
    alone = lambda df, node="node", name="label": df.withColumn(name, df[node])
    met = {frozenset((r["a"], r["b"])) for df in (neardup._to_pivots(differences, early, alone, 85),
                                                   neardup._may_be_near(alone(early), 85)) for r in df.collect()}
    pivot = differences.first()["pivot"]
    own = {n: shingle_set(t) for n, t in rows}
    near = [(a, b) for a in own for b in own if a < b and 100 * len(own[a] & own[b]) >= 85 * len(own[a] | own[b])]
    assert len(near) > 100
    for a, b in near:
        assert {a, b} in met or all({x, pivot} in met or x == pivot for x in (a, b))


def test_nulls_repeats_and_long(spark):
    long = " ".join(f"l{n}" for n in range(60_000))
    rows = [(1, None), (2, "x y z"), (2, "x y z"), (3, "x y z"), (None, "x y z"), (None, "alone"), (5, long), (6, long + " end"),
            (7, "first text"), (7, "second text"), (8, "second text")]
    got = rows_of(neardup.clusters(documents(spark, rows)), *COLUMNS)
    assert got == sorted([
        (None, 1, 2, False), (None, 1, None, True), (1, 0, 1, True), (2, 1, 2, True), (2, 1, 2, True), (3, 1, 2, False),
        (5, 59_996, 5, True), (6, 59_997, 5, False), (7, 1, 7, True), (7, 1, 7, True), (8, 1, 7, False)],
        key=lambda t: tuple((v is not None, v) for v in t))


def test_filter_keeps_columns(spark):
    df = documents(spark, [(1, "a b c"), (2, "a b c"), (3, "d"), (None, "a b c")])
    kept = neardup.keep_first(df)
    assert kept.columns == df.columns
    assert rows_of(kept, "doc_id", "gone_id") == [(None, "own gone_id"), (1, "own gone_id"), (3, "own gone_id")]


def test_one_row_of_each_component(spark):
    base = " ".join(f"h{n}" for n in range(80))
    rows = [(4, base), (4, base), (4, base), (None, base), (None, f"{base} end"), (9, f"{base} tail"),
            (None, "no id"), (None, "no id"), (None, f"x {base[3:]} y z u v w q r s t o p i k m"), (None, f"{base} last words"),
            (7, "first text"), (7, "second text"), (8, "second text"), (6, ""), (6, ""), (None, None), (None, None), (5, None)]
    df = documents(spark, rows).repartition(4)
    kept = neardup.keep_one(df)
    assert kept.columns == df.columns
    got = rows_of(kept, "doc_id", "text")
    want = [(4, base), (None, "no id"), (6, ""), (None, None), (None, None), (5, None)]
    odd = rows[8]
    sets = [shingle_set(odd[1]), shingle_set(base)]
    assert 100 * len(sets[0] & sets[1]) < 85 * len(sets[0] | sets[1])
    sevens = [r for r in got if r[0] == 7]
    assert len(sevens) == 1 and sevens[0] in rows
    assert sorted(got, key=str) == sorted([*want, odd, *sevens], key=str)
    # near copies without any id among themselves
    alone = [(None, base), (None, base), (None, f"{base} tail"), (None, f"{base} end"), (None, "other")]
    assert sorted(r["text"] == "other" for r in neardup.keep_one(documents(spark, alone)).collect()) == [False, True]
    assert neardup.keep_one(documents(spark, [])).count() == 0


def test_empty(spark):
    assert neardup.clusters(documents(spark, [])).collect() == []
    assert neardup.keep_first(documents(spark, [])).count() == 0


def test_signature_is_unbiased():
    import numpy as np
    rng = np.random.default_rng(3)
    values = rng.integers(0, 2**63, 1500).astype(np.uint64)
    a, b = values[:1000], values[500:]
    (la, ha), (lb, hb) = neardup.signature(a), neardup.signature(b)
    assert abs(np.concatenate([la == lb, ha == hb]).mean() - 1 / 3) < 0.2


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(n, n + 1) for n in range(200)] + [(900, 901), (901, 902), (903, 900)], "a long, b long")
    got = {r["node"]: r["label"] for r in components(links).collect()}
    assert got == {**{n: 0 for n in range(201)}, **{n: 900 for n in range(900, 904)}}
    assert components(links.limit(0)).count() == 0


def test_another_threshold(spark):
    """Brute force at 0.8, with pairs between that and the threshold of op8; bands are as many as it needs."""
    rng = random.Random(8)
    rows = []
    for n in range(30):
        base = [f"w{rng.randrange(400)}" for _ in range(150)]
        rows += [(3 * n, " ".join(base)), (3 * n + 1, " ".join(base[:-rng.randint(23, 40)])),
                 (3 * n + 2, " ".join(edited(rng, base, rng.choice([2, 3, 4]))))]
    sets = {i: shingle_set(t) for i, t in rows}
    like = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in sets for b in sets if a < b}
    assert any(0.8 <= x < 0.85 for x in like.values()) and any(0.7 < x < 0.8 for x in like.values())
    group = {i: {i} for i in sets}
    for (a, b), x in like.items():
        if x >= 0.8 and group[a] is not group[b]:
            group[a] |= group[b]
            for i in group[b]:
                group[i] = group[a]
    kept = sorted({min(g) for g in group.values()})
    assert sorted(r["doc_id"] for r in neardup.keep_first(documents(spark, rows), percent=80).collect()) == kept
    assert (1 - 0.8 ** 6) ** neardup.band_count(80) < 1e-6 and neardup.band_count(85) == 30
