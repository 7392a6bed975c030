"""Grouping of spelling variants by composition of finite-state machines.

``count_words`` counts the words of all texts, ``near_pairs`` finds all pairs of words that differ by one
inserted, deleted or replaced code point, ``forms`` leads every word to its more frequent form.

The pairs are what the composition vocabulary ∘ one edit ∘ vocabulary accepts. The vocabulary is never one
machine: a pair with one edit shares either the first half of the shorter word or the rest of it, so words
are dealt out by (length, shared start) and (length, shared end). Each of these is an initial state of the
composed machine, and a task composes the minimised acceptor of what is left of its words with the edit and
with itself, and lists the accepted pairs. An initial state with more than CROWD words is read on: half of
what is not shared yet is added to its shared start or end, until few words are left or nothing can be added
(then their number is bounded by the alphabet). ``bar`` keeps a pair to one initial state: a pair that
shares the start has no part in states of the end.

Counts are merged per batch and per task before they are shuffled, so a word in all texts is no hot key.

Defined results: a null text has no words; a null doc_id is written as no digits; rows that share a doc_id
are counted like others; ties go to the first word in code-point order; an empty table gives no rows; words
of any length are taken; other columns of the table are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from itertools import groupby
from operator import itemgetter
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crestline.llm.common import query, small_batches, table, written
from crestline.session import drop_tables

#: Letters that make up words, after A-Z were lower-cased.
RUN = re.compile("[a-zÀ-ÿ]+")
#: One run in so many loses a code point.
TYPO = 199
SHORTEST, LEAST, FACTOR = 6, 5, 5
#: Words of an initial state beyond which it is read on.
CROWD = 20_000
_FAR = 1 << 30


def _with_typo(run: str, start: int) -> str:
    """``run`` without one code point, if its checksum (carried on from ``start``) says so."""
    h = crc32(run.encode(), start)
    return run if h % TYPO else run[:h % len(run)] + run[h % len(run) + 1:]


def count_words(docs: DataFrame, shortest: int = SHORTEST, least: int = LEAST) -> DataFrame:
    """(word, n) of all words of ``docs`` with at least ``shortest`` code points and ``least`` occurrences."""
    small_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total: Counter[str] = Counter()
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                start = crc32(f"{'' if doc is None else doc}:".encode())
                # bytes.lower changes A-Z only
                for run, n in Counter(RUN.findall((text or "").encode().lower().decode())).items():
                    word = _with_typo(run, start)
                    if len(word) >= shortest:
                        total[word] += n
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])

    counted = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(count, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


class Acceptor:
    """The minimal acyclic acceptor of some strings, built from them in order: equal states are one."""

    def __init__(self, strings: list[str]) -> None:
        self.arcs: list[dict[str, int]] = []
        self.final: list[bool] = []
        self.lengths: list[frozenset[int]] = []  # of the strings that lead from a state to acceptance
        known: dict[tuple, int] = {}
        # states of the last string that may still get arcs: [accepts, arcs]
        line: list[list] = [[False, {}]]
        last = ""

        def close(depth: int) -> None:
            while len(line) > depth + 1:
                accepts, arcs = line.pop()
                line[-1][1][last[len(line) - 1]] = self._state(known, accepts, arcs)

        for s in sorted(strings):
            same = 0
            while same < min(len(s), len(last)) and s[same] == last[same]:
                same += 1
            close(same)
            line += [[False, {}] for _ in range(len(s) - same)]
            line[-1][0], last = True, s
        close(0)
        self.start = self._state(known, *line[0])

    def _state(self, known: dict[tuple, int], accepts: bool, arcs: dict[str, int]) -> int:
        key = (accepts, *arcs.items())
        if key not in known:
            known[key] = len(self.arcs)
            self.arcs.append(arcs)
            self.final.append(accepts)
            self.lengths.append(frozenset({0} if accepts else ()).union(
                *({n + 1 for n in self.lengths[q]} for q in arcs.values())))
        return known[key]

    def common(self, p: int, q: int, not_first: str = "") -> Iterator[str]:
        """Strings that lead to acceptance from both states; none that begins with ``not_first``."""
        todo = [(p, q, "")]
        while todo:
            p, q, path = todo.pop()
            if not self.lengths[p] & self.lengths[q]:
                continue
            if self.final[p] and self.final[q]:
                yield path
            there = self.arcs[q]
            todo += [(t, there[a], path + a) for a, t in self.arcs[p].items() if a in there and (path or a != not_first)]

    def edits(self, q: int) -> list[tuple[str, str]]:
        """What may follow a shared start that ends in ``q``: pairs whose first symbols were replaced, or whose
        second has one more symbol in front."""
        arcs = list(self.arcs[q].items())
        swaps = [(a + z, b + z) for i, (a, p) in enumerate(arcs) for b, r in arcs[i + 1:] for z in self.common(p, r)]
        return swaps + [(z, b + z) for b, p in arcs for z in self.common(q, p, b)]

    def pairs(self) -> Iterator[tuple[str, str]]:
        """All pairs that composition with one edit accepts, each once, the shorter one first."""
        after: dict[int, list[tuple[str, str]]] = {}
        todo = [(self.start, "")]
        while todo:
            q, path = todo.pop()
            if q not in after:
                after[q] = self.edits(q)
            for x, y in after[q]:
                yield path + x, path + y
            todo += [(t, path + a) for a, t in self.arcs[q].items()]


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def _compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, near, near_n) in both directions from rows sorted by initial state."""
    schema = pa.schema([("word", pa.string()), ("near", pa.string()), ("near_n", pa.int64())])
    out: list[tuple] = []
    for _, rows in groupby(_rows(batches), itemgetter(0)):
        rows = list(rows)
        if len(rows) > 1:
            _, word, _, size, lo, hi, bar = rows[0]
            head, tail, rest = word[:lo], word[len(word) - hi:], size - lo - hi
            n = {r[1]: r[2] for r in rows}
            for x, y in Acceptor([w[lo:len(w) - hi] for w in n]).pairs():
                u, v = head + x + tail, head + y + tail
                # pairs of two longer words, or with the start that another state has, are found elsewhere
                if len(x) == rest and u[:bar] != v[:bar]:
                    out += [(u, v, n[v]), (v, u, n[u])]
                if len(out) >= 10_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
                    out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)


def _read_on(states: DataFrame) -> DataFrame:
    """Each row under two initial states that share one half more."""
    rest = F.col("size") - F.col("lo") - F.col("hi")
    half = F.floor(rest / 2).cast("int")
    start = F.struct((F.col("lo") + half).alias("lo"), F.col("hi"), F.col("bar"))
    end = F.struct(F.col("lo"), (F.col("hi") + rest - half).alias("hi"), F.least("bar", F.col("lo") + half).alias("bar"))
    rows = states.select("word", "n", "size", F.explode(F.array(start, end)).alias("s")).select("word", "n", "size", "s.*")
    key = F.concat_ws(".", "size", "lo", "hi", "bar", F.expr("substring(word, 1, lo)"), F.expr("right(word, hi)"))
    return rows.select(key.alias("state"), "word", "n", "size", "lo", "hi", "bar")


def near_pairs(words: DataFrame, crowd: int = CROWD) -> DataFrame:
    """(word, near, near_n): all ordered pairs of ``words`` (word, n; each word once) that differ by one edit."""
    size = F.length("word")
    # a word meets those of its own length or one more as the shorter one, and those of one less
    every = words.select("word", "n", F.explode(F.array(size, size - 1)).alias("size"),
                         F.lit(0).alias("lo"), F.lit(0).alias("hi"), F.lit(_FAR).alias("bar"))
    states, done = _read_on(every), []
    while True:
        states = written(states, "states")
        crowded = written(states.filter("size - lo - hi > 1").groupBy("state").count().filter(F.col("count") > crowd).select("state"), "crowded")
        if crowded.isEmpty():
            done.append(states)
            break
        done.append(states.join(crowded, "state", "left_anti"))
        states = _read_on(states.join(crowded, "state", "left_semi"))
    rows = reduce(DataFrame.unionByName, done)
    return rows.repartition("state").sortWithinPartitions("state").mapInArrow(_compose, "word string, near string, near_n long")


def forms(words: DataFrame, pairs: DataFrame, factor: int = FACTOR) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of every word."""
    best = pairs.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("n"), "near")).alias("best"))
    with_best = words.join(best, "word", "left")
    follows = -F.col("best.n") >= factor * F.col("n")
    known = written(with_best.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
                                     F.when(follows, F.col("best.near")).alias("form"),
                                     F.when(follows, -F.col("best.n")).alias("form_n")), "forms")
    # each round doubles the number of steps that a root is away; counts grow along them, so they end
    roots = written(known.filter("form IS NOT NULL").select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "roots")
    while not roots.filter("moved").isEmpty():
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("further"))
        new = written(roots.drop("moved").join(further, "root", "left").select(
            "word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        drop_tables(roots)
        roots = new
    return known.join(roots.drop("moved"), "word", "left").withColumn("root", F.coalesce("root", "word"))


_SQL = r"""
WITH RECURSIVE bits(i, v, k) AS (
  SELECT i, i, 0 FROM range(256) t(i)
  UNION ALL SELECT i, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END, k + 1 FROM bits WHERE k < 8),
crc_table AS MATERIALIZED (SELECT list(v ORDER BY i) AS t FROM bits WHERE k = 8),
runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[a-z\x{00C0}-\x{00FF}]+')) AS run FROM documents),
per_doc AS MATERIALIZED (SELECT doc_id, run, count(*) AS n, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS hx
  FROM runs GROUP BY ALL),
summed AS (SELECT run, n, xor(list_reduce(list_prepend(4294967295::BIGINT,
  list_transform(range(1, strlen(hx), 2), lambda p: ('0x' || substr(hx, p, 2))::BIGINT)),
  lambda a, b: xor(a // 256, t[1 + xor(a % 256, b)])), 4294967295) AS h FROM per_doc, crc_table),
results AS (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2)
  ELSE run END AS word, n FROM summed),
words AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM results WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
cuts AS MATERIALIZED (SELECT word, n, p, substr(word, 1, p) AS a, substr(word, p + 2) AS b
  FROM (SELECT word, n, unnest(range(length(word))) AS p FROM words)),
near AS MATERIALIZED (
  SELECT DISTINCT word, near, near_n FROM (
    SELECT x.word, y.word AS near, y.n AS near_n FROM cuts x JOIN cuts y ON x.p = y.p AND x.a = y.a AND x.b = y.b AND x.word <> y.word
    UNION ALL SELECT w.word, c.word, c.n FROM cuts c JOIN words w ON w.word = c.a || c.b
    UNION ALL SELECT c.word, w.word, w.n FROM cuts c JOIN words w ON w.word = c.a || c.b)),
best AS (SELECT word, count(*) AS n_near, max(near_n) AS top FROM near GROUP BY word),
formed AS MATERIALIZED (SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near,
  CASE WHEN b.top >= 5 * w.n THEN (SELECT min(near) FROM near x WHERE x.word = w.word AND x.near_n = b.top) END AS form,
  CASE WHEN b.top >= 5 * w.n THEN b.top END AS form_n FROM words w LEFT JOIN best b USING (word)),
walk(word, reached, form) AS (SELECT word, word, form FROM formed
  UNION ALL SELECT walk.word, f.word, f.form FROM walk JOIN formed f ON f.word = walk.form)
SELECT f.word, f.form, walk.reached AS root, f.n, f.n_near, f.form_n FROM formed f JOIN walk ON walk.word = f.word AND walk.form IS NULL
"""


@query("op11_spelling_variants", _SQL)
def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = written(count_words(table(spark, sf_dir, "documents")), "words")
    return forms(words, near_pairs(words)).select("word", "form", "root", "n", "n_near", "form_n")
