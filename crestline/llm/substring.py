"""Removal of repeated passages: seed and extend over winnowed anchors.

A window is LENGTH consecutive words. Of the word 6-grams in each window the one with the smallest hash
is its anchor, so equal windows have the same anchor at the same place and every repeated passage of at
least LENGTH words shares one. Consecutive windows with the same anchor form a run: the anchor extended
both ways as far as its windows reach.

1. Anchors that occur more than once are found by one narrow shuffle of (hash, document). A task first
   merges its batch: an anchor that repeats there is sent on once, so a line that is in a third of all
   documents is one row per batch and no key is large.
2. Documents meet their repeated anchors (the only time all texts move) and unaffected ones are done.
3. Runs of repeated anchors are matched whole, by (anchor, digest of the run's words); the first place of
   each distinct run comes from an aggregate. Other places of that run are repeats in full.
4. Where an anchor has several distinct runs, they agree only in part: their first places are extended
   window by window, matched by (anchor, window hash), and each window's first place is found likewise.
5. Windows that start earlier elsewhere cover the words to remove; covered stretches are the maximal
   repeats.

Keys of matches are two 64-bit hashes. Lists that come back to a document are as long as the document.

Defined results: a null text has no words; fewer than LENGTH words are never removed; rows that share a
doc_id are the same document, so equal places of them are not earlier than each other (if their texts
differ, a place that is first in one of them counts as first); a null doc_id comes before all others. Words are joined by one space where something was removed, else texts stay as they are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from crestline.llm import words
from crestline.llm.common import query, small_batches, table, written

LENGTH, GRAM = 20, 6
_NONE = -(1 << 63)
_P = 0x9E3779B97F4A7C15
_P_INVERSE = pow(_P, -1, 1 << 64)


class Seeds:
    """The runs of one document: start, number of windows, anchor and digest of each."""

    def __init__(self, text: str | None) -> None:
        self.words = words.split(text)
        self.hashes = words.hashes(self.words)
        self.starts = self.lengths = np.zeros(0, np.int64)
        self.anchors = np.zeros(0, np.int64)
        if len(self.words) >= LENGTH:
            grams = words.runs(self.hashes, GRAM)
            self.starts, self.places = words.first_minima(grams, LENGTH - GRAM + 1)
            self.lengths = np.diff(np.append(self.starts, len(self.words) - LENGTH + 1))
            self.anchors = grams[self.places].view(np.int64)

    def digests(self) -> np.ndarray:
        """Hash of each run's words, from its first window's start to its last one's end, and of the
        anchor's place in it."""
        if not len(self.starts):
            return np.zeros(0, np.int64)
        n = len(self.hashes)
        up, down = (np.multiply.accumulate(np.append(np.uint64(1), np.full(n, p, np.uint64))) for p in (_P, _P_INVERSE))
        sums = np.append(np.uint64(0), np.cumsum(self.hashes * up[:n], dtype=np.uint64))
        ends = self.starts + self.lengths + LENGTH - 1
        run = (sums[ends] - sums[self.starts]) * down[self.starts]
        shape = (self.lengths << 32 | (self.places - self.starts)).astype(np.uint64)
        return words.mixed(words.mixed(run) + shape).view(np.int64)

def _batch(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


_ANCHORS = pa.schema([("key", pa.int64()), ("id", pa.int64()), ("anchor", pa.int64())])


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, id, anchor). Anchors seen once in the batch: key is the anchor, ``anchor`` is null. Others:
    one row without id under the anchor as key, and known rows (id, anchor) under any key."""
    for batch in batches:
        ids = batch.column(0).to_numpy()
        found = [Seeds(t).anchors for t in batch.column(1).to_pylist()]
        sizes = [len(a) for a in found]
        if not sum(sizes):
            continue
        anchors, owner = np.concatenate(found), np.repeat(ids, sizes)
        order = np.lexsort((owner, anchors))
        anchors, owner = anchors[order], owner[order]
        new = np.append(True, anchors[1:] != anchors[:-1])
        group = np.cumsum(new) - 1
        many = np.bincount(group)[group] > 1
        fresh = new | np.append(True, owner[1:] != owner[:-1])  # once for each document
        single, notice, known = ~many, many & new, many & fresh
        key = np.concatenate([anchors[single], anchors[notice], words.mixed(owner[known].view(np.uint64)).view(np.int64)])
        blank = pa.nulls
        yield pa.RecordBatch.from_arrays([
            pa.array(key),
            pa.concat_arrays([pa.array(owner[single]), blank(int(notice.sum()), pa.int64()), pa.array(owner[known])]),
            pa.concat_arrays([blank(int(single.sum() + notice.sum()), pa.int64()),
                              pa.array(anchors[known])])], schema=_ANCHORS)


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, anchor) of the anchors whose key, in sorted rows, has several rows or one without id."""
    schema = pa.schema([("id", pa.int64()), ("anchor", pa.int64())])
    held: tuple[int, int | None] | None = None  # the last key and, while unsettled, its only row's id
    for batch in batches:
        keys, anchor = batch.column(0).to_numpy(), batch.column(2)
        known = np.asarray(anchor.is_valid())
        yield pa.RecordBatch.from_arrays([batch.column(1).filter(pa.array(known)), anchor.filter(pa.array(known))], schema=schema)
        own = pa.array(~known)
        keys, named = keys[~known], np.asarray(batch.column(1).filter(own).is_valid())
        ids = batch.column(1).filter(own).fill_null(0).to_numpy()
        if not len(keys):
            continue
        new = np.append(True, keys[1:] != keys[:-1])
        group = np.cumsum(new) - 1
        several = (np.bincount(group) > 1) | (np.bincount(group, weights=~named) > 0)
        out_ids, out_keys = [], []
        if held is not None and held[0] == keys[0]:
            several[0] = True
            if held[1] is not None:
                out_ids.append(held[1])
                out_keys.append(held[0])
        hit = several[group] & named
        yield _batch(schema, [np.append(np.array(out_ids, np.int64), ids[hit]), np.append(np.array(out_keys, np.int64), keys[hit])])
        held = (int(keys[-1]), None if several[-1] else int(ids[-1]))


def _sha(kept: list[bytes]) -> tuple[str, str]:
    data = b" ".join(kept)
    return hashlib.sha256(data).hexdigest(), data.decode()


def _spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Starts of all windows of some runs."""
    if not len(starts):
        return np.zeros(0, np.int64)
    return np.repeat(starts - np.append(0, np.cumsum(lengths)[:-1]), lengths) + np.arange(lengths.sum())


#: A run's start and its number of windows (at most 15) in one number, in the order of starts.
_SPOT = 16


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows of the wanted runs (spot, anchor)."""
    schema = pa.schema([("anchor", pa.int64()), ("win", pa.int64()), ("id", pa.int64()), ("start", pa.int64())])
    for batch in batches:
        for doc, text, wanted in zip(*(batch.column(c).to_pylist() for c in ("id", "text", "wanted"))):
            win = words.runs(words.hashes(words.split(text)), LENGTH, seed=LENGTH).view(np.int64)
            spots, anchors = (np.array([run[c] for run in wanted], np.int64) for c in ("spot", "anchor"))
            at, anchor = _spread(spots // _SPOT, spots % _SPOT), np.repeat(anchors, spots % _SPOT)
            own = at < len(win)  # else another text with the same id is meant
            yield _batch(schema, [anchor[own], win[at[own]], np.full(own.sum(), doc), at[own]])


def _removed(n_words: int, spots: np.ndarray, digests: np.ndarray, firsts: list, wins: list) -> np.ndarray:
    """Which words are covered by windows that start earlier elsewhere. ``firsts``: (spot, digest,
    several) of the runs that are the first of their kind, ``wins``: starts of such windows."""
    first = {(f["spot"], f["digest"]): f["several"] for f in firsts}
    state = np.array([first.get(k, -1) for k in zip(spots.tolist(), digests.tolist())], np.int64)
    starts, lengths = spots // _SPOT, spots % _SPOT
    part = _spread(starts[state == 1], lengths[state == 1])
    at = np.concatenate([_spread(starts[state == -1], lengths[state == -1]), part[~np.isin(part, np.array(wins, np.int64))]])
    step = np.zeros(n_words + 1, np.int64)
    np.add.at(step, at, 1)
    np.add.at(step, at + LENGTH, -1)
    return np.cumsum(step[:-1]) > 0


def without_repeats(docs: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every row. With ``carry``, a list of columns, also
    ``row``, a struct of them, and ``text``, what is left of the text."""
    spark = docs.sparkSession
    small_batches(spark)
    whole = carry is not None
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NONE)).alias("id"),
                       F.struct(F.col("doc_id").cast("long").alias("doc_id"), *(
                           [F.struct(*[F.col(f"`{c}`") for c in carry]).alias("carried")] if whole else [])).alias("row"), "text")
    seen = rows.select("id", "text").mapInArrow(_anchors, "key long, id long, anchor long")
    repeated = seen.repartition("key").sortWithinPartitions("key").mapInArrow(_repeated, "id long, anchor long")
    by_doc = repeated.groupBy("id").agg(F.collect_set("anchor").alias("repeated"))

    row = rows.schema["row"]
    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Results of unaffected rows, whose texts go on only if asked for; the repeated anchors' runs of
        the others."""
        for batch in batches:
            out = []
            for text, repeated in zip(batch.column("text").to_pylist(), batch.column("repeated").to_pylist()):
                if repeated is None:
                    kept = words.split(text)
                    out.append((text if whole else None, len(kept), _sha(kept)[0], None, None, None))
                else:
                    s = Seeds(text)
                    hit = np.isin(s.anchors, np.array(repeated, np.int64))
                    out.append((text, len(s.words), None, (s.starts * _SPOT + s.lengths)[hit], s.anchors[hit], s.digests()[hit]))
            text, n, sha, *runs = zip(*out) if out else [()] * 6
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("row"), pa.array(text, pa.string()), pa.array(n, pa.int64()),
                 pa.array(sha, pa.string()), *[pa.array(r, pa.list_(pa.int64())) for r in runs]],
                names=["id", "row", "text", "n_words", "kept_sha256", "spots", "anchors", "digests"])

    base = StructType([StructField("id", LongType()), row, StructField("text", StringType()), StructField("n_words", LongType()),
                       StructField("kept_sha256", StringType()), *[StructField(c, ArrayType(LongType())) for c in ("spots", "anchors", "digests")]])
    settled = written(rows.join(by_doc, "id", "left").select("id", "row", "text", "repeated").mapInArrow(settle, base), "settled")
    affected = settled.filter("spots IS NOT NULL")

    runs = affected.select("id", F.explode(F.arrays_zip("anchors", "digests", "spots")).alias("r")).select(
        "id", F.col("r.anchors").alias("anchor"), F.col("r.digests").alias("digest"), F.col("r.spots").alias("spot"))
    kinds = written(runs.groupBy("anchor", "digest").agg(F.min(F.struct("id", "spot")).alias("first")), "runs")
    several = kinds.groupBy("anchor").agg((F.count("*") > 1).cast("int").alias("several"))
    firsts = kinds.join(several, "anchor").select("first.id", "first.spot", "anchor", "digest", "several")
    firsts = written(firsts.groupBy("id").agg(F.collect_list(F.struct("spot", "anchor", "digest", "several")).alias("firsts")), "firsts")
    wanted = firsts.select("id", F.transform(F.filter("firsts", lambda f: f["several"] == 1), lambda f: F.struct(
        f["spot"].alias("spot"), f["anchor"].alias("anchor"))).alias("wanted")).filter(F.size("wanted") > 0)
    windows = affected.select("id", "text").join(wanted, "id").select("id", "text", "wanted").mapInArrow(
        _windows, "anchor long, win long, id long, start long")
    wins = windows.groupBy("anchor", "win").agg(F.min(F.struct("id", "start")).alias("first")).groupBy("first.id").agg(
        F.collect_list("first.start").alias("wins"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, spots, digests, first, win in zip(*(batch.column(c).to_pylist() for c in (
                    "text", "spots", "digests", "firsts", "wins"))):
                own = words.split(text)
                gone = _removed(len(own), np.array(spots, np.int64), np.array(digests, np.int64), first or [], win or [])
                n = int(gone.sum())
                sha, kept = _sha([w for w, g in zip(own, gone.tolist()) if not g] if n else own)
                out.append((n, sha, (kept if n else text) if whole else None))
            n, sha, kept = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("n_words"), pa.array(n, pa.int64()), pa.array(sha, pa.string()),
                 pa.array(kept, pa.string())], names=["row", "n_words", "n_removed", "kept_sha256", "text"])

    result = StructType([row, StructField("n_words", LongType()), StructField("n_removed", LongType()),
                         StructField("kept_sha256", StringType()), StructField("text", StringType())])
    changed = affected.join(firsts, "id", "left").join(wins, "id", "left").select(
        "row", "text", "n_words", "spots", "digests", "firsts", "wins").mapInArrow(finish, result)
    rest = settled.filter("spots IS NULL").select("row", "n_words", F.lit(0).cast("long").alias("n_removed"), "kept_sha256", "text")
    both = changed.unionByName(rest)
    out = ["row.doc_id", "n_words", "n_removed", "kept_sha256"]
    return both.select(*out, F.col("row.carried").alias("row"), "text") if whole else both.select(*out)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with all columns and rows, repeated passages taken out of ``text`` (``n_chars`` follows)."""
    carry = [c for c in docs.columns if c != "text"]
    left = without_repeats(docs, carry)
    columns = [F.col("text") if c == "text" else F.col("row")[c] for c in docs.columns]
    if "n_chars" in docs.columns:
        n = F.when(F.col("n_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row")["n_chars"])
        columns[docs.columns.index("n_chars")] = n
    return left.select(*[c.alias(n) for c, n in zip(columns, docs.columns)])


@query("op9_substring_dedup")
def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(table(spark, sf_dir, "documents"))
