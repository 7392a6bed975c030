import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from llm_tables import documents
from tokenizers import Tokenizer

from crestline.llm import packing

PATH = public_tokenizers.path(packing.TOKENIZER)


def test_word_cache_gives_the_tokenizers_ids():
    plain, cached = Tokenizer.from_file(PATH), packing.WordTokens(PATH, cache=50)
    rng = random.Random(1)
    pool = [chr(c) for c in [*range(1, 500), 0x301, 0x3A3, 0x3C2, 0x130, 0x2028, 0x3000, 0xFEFF, 0x1F600, 0x4E2D, 0x1100, 0x1161]]
    pool += ["'s", "'LL", "<|endoftext|>", " ", "\n", "\x0b", "\x1c"] * 15
    for _ in range(3000):
        text = "".join(rng.choices(pool, k=rng.randint(0, 40)))
        assert np.frombuffer(cached.ids(text), "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids, repr(text)


def test_known_words_outlive_a_task_and_are_bounded():
    tokens = packing.word_tokens(PATH)
    assert packing.word_tokens(PATH) is tokens
    tokens.ids("Climbing climbing, climbing")
    assert b"climbing" in tokens and tokens[b"climbing,"] == tokens[b"climbing"] + tokens[b","]
    small = packing.WordTokens(PATH, cache=5)
    small.ids(" ".join(f"w{n} é{n}" for n in range(50)) + " " + "x" * 10_000)
    assert len(small) <= 5 and all(len(word) <= packing.LONGEST for word in small)


def test_written_out_classes_are_the_tokenizers_pattern():
    regex = pytest.importorskip("regex")
    pattern = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
    letters = sorted({c for n in range(256) if packing.PLAIN.fullmatch(chr(n)) for c in chr(n).lower()})
    rng = random.Random(3)
    for text in [*letters, *("".join(rng.choices([*letters, *"'''streldvm"], k=rng.randint(2, 9))) for _ in range(5000))]:
        assert packing.WORDS.findall(text) == pattern.findall(text), text
    assert all(c.isalpha() == bool(regex.fullmatch(r"\p{L}", c)) for c in letters)


def check(rows, capacity=4096):
    by_bin = {}
    for r in rows:
        by_bin.setdefault(r["sequence_id"], []).append(r)
    for own in by_bin.values():
        own.sort(key=lambda r: r["offset"])
        at = 0
        for r in own:
            assert r["offset"] == at
            at += r["length"]
        assert at <= capacity
    return by_bin


def test_pieces_and_bins(spark):
    rng = random.Random(2)
    texts = [(n, " ".join(rng.choices(["alpha", "Bravo", "x1", "é"], k=rng.choice([0, 3, 200, 900, 9000])))) for n in range(60)]
    texts += [(100, None), (100, None), (None, "no id"), (7, "again")]
    rows = packing.pack(packing.pieces(documents(spark, texts))).collect()
    plain = Tokenizer.from_file(PATH)
    want = []
    for i, t in texts:
        ids = plain.encode(t or "", add_special_tokens=False).ids + [1]
        for p, at in enumerate(range(0, len(ids), 4096)):
            cut = np.array(ids[at:at + 4096], "<u4")
            want.append((i, p, at, len(cut), zlib.crc32(cut.tobytes())))
    key = lambda t: tuple((v is not None, v) for v in t)
    assert sorted((tuple(r[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")) for r in rows), key=key) == sorted(want, key=key)
    free = []  # first fit, longest first: many equal lengths leave no better bound
    for length in sorted((w[3] for w in want), reverse=True):
        at = next((n for n, f in enumerate(free) if f >= length), None)
        if at is None:
            free.append(4096 - length)
        else:
            free[at] -= length
    assert len(check(rows)) <= len(free)


def test_groups_and_empty_table(spark):
    parts = packing.pieces(documents(spark, [(n, "word " * (n % 50)) for n in range(300)]))
    check(packing.pack(parts, group_pieces=40).collect())
    assert packing.pack(packing.pieces(documents(spark, []))).collect() == []


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_every_capacity_holds(rule):
    lengths = np.sort(np.random.default_rng(4).integers(1, 100, 500))[::-1]
    bins, offsets = packing.best_fit(lengths, (100, 3, 5000 + 99 * 99), rule)
    for b in range(bins.max() + 1):
        own = lengths[bins == b]
        assert own.sum() <= 100 and len(own) <= 3 and (own ** 2).sum() <= 5000 + 99 * 99
    with pytest.raises(ValueError):
        packing.best_fit(lengths, (50, 3, 10_000), rule)


def test_best_fit_takes_the_tightest_bin():
    bins, offsets = packing.best_fit(np.array([7, 6, 4, 3]), (10, 10, 100))
    assert bins.tolist() == [0, 1, 1, 0] and offsets.tolist() == [0, 0, 6, 7]
