import random
import re
import zlib
from collections import Counter

import pytest
from llm_tables import documents, rows_of

from crestline.llm import spelling


def one_edit(u, v):
    if len(u) > len(v):
        u, v = v, u
    if len(u) == len(v):
        return sum(a != b for a, b in zip(u, v)) == 1
    return len(v) == len(u) + 1 and any(u == v[:i] + v[i + 1:] for i in range(len(v)))


def brute_counts(rows):
    n = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 199 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= 6 and k >= 5}


def brute_forms(n):
    near = {w: [x for x in n if one_edit(w, x)] for w in n}
    form = {}
    for w in n:
        top = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = top if top is not None and n[top] >= 5 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out, key=lambda t: tuple((v is not None, v) for v in t))


def found(spark, words, **options):
    df = spark.createDataFrame(sorted(words.items()), "word string, n long")
    pairs = spelling.near_pairs(df, **options)
    return sorted((r["word"], r["near"], r["near_n"]) for r in pairs.collect())


def vocabulary(seed, letters="abé", low=1, high=8, size=300):
    rng = random.Random(seed)
    return {"".join(rng.choices(letters, k=rng.randint(low, high))): rng.randint(5, 4000) for _ in range(size)}


@pytest.mark.parametrize("crowd", [3, 20, 20_000])
def test_pairs_each_once(spark, crowd):
    """States that are read on give the same pairs, none twice."""
    for seed in (1, 2):
        words = vocabulary(seed)
        want = sorted((u, v, words[v]) for u in words for v in words if one_edit(u, v))
        assert found(spark, words, crowd=crowd) == want


def test_acceptor_is_minimal():
    m = spelling.Acceptor(["taps", "tops", "tap", "top"])
    assert len(m.arcs) == 5  # t, a|o, p, (s), end
    assert sorted(m.pairs()) == sorted([("tap", "taps"), ("tap", "top"), ("taps", "tops"), ("top", "tops")])
    assert list(spelling.Acceptor([]).pairs()) == [] and list(spelling.Acceptor([""]).pairs()) == []


def test_long_words(spark):
    long = "ab" * 3000
    words = {long: 9, long + "b": 50, "b" + long: 7, "a" * 2000: 5, "a" * 2001: 6}
    assert found(spark, words) == sorted((u, v, words[v]) for u in words for v in words if one_edit(u, v))


def test_forms_follow_to_the_root(spark):
    words = {"abcdef": 2000, "abcdeg": 300, "abcdgg": 50, "abcggg": 9, "abcdefx": 2000, "zzzzzz": 5, "abcdeé": 399, "bbcdef": 400}
    df = spark.createDataFrame(sorted(words.items()), "word string, n long")
    got = rows_of(spelling.forms(df, spelling.near_pairs(df)), "word", "form", "root", "n", "n_near", "form_n")
    assert got == brute_forms(words)
    assert {r[0]: r[2] for r in got}["abcggg"] == "abcdef"


def test_whole_texts(spark):
    rng = random.Random(4)
    words = [w + "word" for w in vocabulary(5, "xyzÀÿ", 2, 4, 80)] + ["Short", "ÉCOLES", "éCoLEs", "l'Hôtels"]
    rows = [(n if n % 50 else None, " 1,".join(rng.choices(words, k=rng.randint(0, 400)))) for n in range(300)]
    rows += [(1, None), (2, ""), (3, "longest " * 40_000), (3, "longest " * 3), (7, rows[7][1])]
    docs = documents(spark, rows, ("word", "n", "state", "size", "lo", "near", "form", "root")).repartition(5)
    n = brute_counts([(r[0], r[1]) for r in rows])
    assert rows_of(spelling.count_words(docs), "word", "n") == sorted(n.items())
    counted = spelling.count_words(docs)
    got = rows_of(spelling.forms(counted, spelling.near_pairs(counted, crowd=10)), "word", "form", "root", "n", "n_near", "form_n")
    assert got == brute_forms(n)


def test_empty(spark):
    counted = spelling.count_words(documents(spark, []))
    assert spelling.forms(counted, spelling.near_pairs(counted)).collect() == []
