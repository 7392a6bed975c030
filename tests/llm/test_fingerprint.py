import hashlib
import random

import pytest
from llm_tables import documents, rows_of

from crestline.llm import fingerprint as fp


def expected(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    texts = [t or "" for _, t in rows]
    out = []
    for n, (i, _) in enumerate(rows):
        t, nxt = texts[n], texts[(n + 1) % len(rows)]
        k = len(t) // 4
        e = t[:len(t) - k] + nxt[:k]
        a, b = fp.digest(t.encode()), fp.digest(e.encode())
        out.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), a, b, fp.likeness(a, b), fp.likeness(a, fp.digest(nxt.encode()))))
    return sorted(out, key=lambda t: tuple((v is not None, v) for v in t))


COLUMNS = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


@pytest.mark.parametrize("rows", [
    [], [(5, "alone here")], [(3, None), (1, ""), (2, "a")], [(None, "x y z"), (2, "abc"), (2, "abc"), (7, "né" * 30)],
    [(i * 3 % 101, " ".join(random.Random(i).choices("alpha beta gamma delta é ü".split(), k=i % 17))) for i in range(101)],
], ids=["empty", "one", "nulls", "ties", "many"])
def test_neighbours_brute_force(spark, rows):
    df = documents(spark, rows).repartition(5)
    assert rows_of(fp.compare_neighbours(df), *COLUMNS) == expected(rows)


def test_plain_fingerprints(spark):
    rows = [(1, "same text"), (2, "same text"), (3, None), (4, "")]
    got = {r["doc_id"]: r for r in fp.fingerprints(documents(spark, rows)).collect()}
    assert got[1]["fingerprint"] == got[2]["fingerprint"] != got[3]["fingerprint"] == got[4]["fingerprint"]
    assert got[3]["n_chars"] == 0


def test_likeness_orders_edits_before_strangers():
    rng = random.Random(3)
    vocabulary = ["".join(rng.choices("etaoinshrdlu", k=rng.randint(2, 8))) for _ in range(3000)]
    a, b = (" ".join(rng.choices(vocabulary, k=600)) for _ in range(2))
    mark = fp.digest(a.encode())
    assert fp.likeness(mark, mark) == 1.0
    assert 1 > fp.likeness(mark, fp.digest(fp.edited(a, b).encode())) > fp.likeness(mark, fp.digest(b.encode())) >= 0


def test_very_long_text():
    assert len(fp.digest(b"ab c" * 500_000)) == len(fp.digest(b""))
