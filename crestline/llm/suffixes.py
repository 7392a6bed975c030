"""Removal of repeated byte strings by column-wise multi-document construction.

A collection is built column by column from the right: a round puts one symbol in front of the last round's
suffix of every string. The new order follows from the old one and the column of symbols in front (the round's
part of the collection's Burrows-Wheeler transform): equal symbols stay in the order that they have there. The
common prefix of two neighbours is one more than the least of the old ones between them, or none where their
symbols differ. A round reads the last round's two arrays in order and leaves the next two.

What makes this work for any number of documents is that the strings are short and aligned:

1. Each window of LENGTH bytes has an anchor, the GRAM bytes with the least hash in it, so equal windows have
   the same anchor at the same place. Consecutive windows with one anchor are a string of at most
   2 LENGTH - GRAM bytes. One narrow shuffle of (hash, document) finds the anchors that several documents have;
   an anchor that repeats within a batch is sent once, so none is a hot key.
2. Documents meet their shared anchors (texts move once) and list the strings of these anchors.
3. Equal strings become one with the smallest doc_id. Strings of one anchor go to one task, which builds
   collections of whole anchors, aligned at the anchor. A suffix that starts left of the anchor by a number of
   columns is only ever equal to suffixes of the same round, so rounds need not be merged.
4. In each round, neighbours whose common prefix has LENGTH symbols or more are a group of equal windows. Strings
   with the group's smallest doc_id own the window; what a document doesn't own is removed.
5. An anchor with more than CROWD distinct strings (a line in many texts, with other words around it) is dealt
   out as single windows by their own hash, equal ones merged before; these are collections of one round.

Texts are cut into stretches of STRETCH windows, which bounds the memory for very long ones.

Defined results: a null text is empty; fewer than LENGTH bytes are never removed; rows that share a doc_id are one
document, so they never remove each other's bytes; a row without doc_id has no place in the order: nothing is
removed from it, and it removes nothing; an empty table gives no rows; other columns of the table are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from crestline.llm import words
from crestline.llm.common import query, small_batches, table, written
from crestline.session import drop_tables

LENGTH, GRAM = 50, 16
#: Places of an anchor in a window, and so the most windows of a string.
PLACES = LENGTH - GRAM + 1
#: Distinct strings of an anchor beyond which it is dealt out as windows.
CROWD = 20_000
#: Strings of a collection, unless one anchor has more.
COLLECTION = 32_768
STRETCH = 1 << 20
#: Bytes from which joined texts are hashed.
JOINED = 1 << 17
#: Bits of a place in joined texts.
_PLACE = np.uint64((1 << 22) - 1)
_PAD = 0xFF  # no byte of UTF-8
_SINGLE = -1  # marks a window that is a string of its own
_SIGN = 1 << 63


def _digest(data: bytes) -> int:
    h = xxh3_64_intdigest(data)
    return h - (1 << 64) if h >= _SIGN else h


class Runs:
    """Runs of windows with one anchor in several texts: text, start, number of windows, place of the anchor in the
    first window, hash of the anchor. Texts are joined to stretches, and cut where they are longer."""

    def __init__(self, texts: list[bytes]) -> None:
        parts, held, size = [], [], 0
        for n, data in enumerate(texts):
            for at in range(0, max(len(data) - LENGTH + 1, 0), STRETCH):
                held.append((n, at, data[at:at + STRETCH + LENGTH - 1] if len(data) > STRETCH else data))
                size += len(held[-1][2])
                if size >= JOINED:
                    parts.append(self._of(held))
                    held, size = [], 0
        if held:
            parts.append(self._of(held))
        none = np.zeros(0, np.int64)
        self.texts, self.starts, self.lengths, self.places, self.anchors = (
            np.concatenate(c) for c in zip(*parts)) if parts else [none] * 5

    @staticmethod
    def _of(held: list[tuple[int, int, bytes]]) -> tuple[np.ndarray, ...]:
        texts, offsets, data = zip(*held)
        sizes = np.array([len(d) for d in data])
        ends = np.cumsum(sizes)
        grams, size = np.frombuffer(b"".join(data), np.uint8).astype(np.uint64), 1
        while size < GRAM:  # a hash of 2 size bytes from two of size bytes
            grams = grams[:-size] * words._STEP + grams[size:]
            grams ^= grams >> words._HALF
            size *= 2
        grams = words.mixed(grams)
        # the least hash of every window and, in its low bits, the first place that has it
        low, size = grams & ~_PLACE | np.arange(len(grams), dtype=np.uint64), 1
        while size < PLACES:
            step = min(size, PLACES - size)
            low, size = np.minimum(low[:-step], low[step:]), size + step
        places = (low & _PLACE).astype(np.int64)
        new = np.append(True, places[1:] != places[:-1])
        new[ends - sizes] = True
        over = _windows(ends[:-1] - LENGTH + 1, np.full(len(ends) - 1, LENGTH - 1))  # windows across two texts
        new[over] = True
        starts = np.flatnonzero(new)
        lengths = np.diff(np.append(starts, len(places)))
        within = np.ones(len(new), bool)
        within[over] = False
        kept = within[starts]
        starts, lengths = starts[kept], lengths[kept]
        own = np.searchsorted(ends, starts, side="right")
        shift = np.array(offsets) - (ends - sizes)
        return np.array(texts)[own], starts + shift[own], lengths, places[starts] - starts, grams[places[starts]].view(np.int64)


def _bytes(text: str | None) -> bytes:
    return text.encode() if text else b""


def _windows(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Starts of all windows of some runs."""
    return np.repeat(starts - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())


_SEEN = pa.schema([("key", pa.int64()), ("id", pa.int64()), ("anchor", pa.int64())])


def _seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Anchors of one document in the batch as (anchor, id, null). Those of several documents: (anchor, null,
    null) once, and (any key, id, anchor) for each, since they are known to be shared."""
    for batch in batches:
        ids = batch.column(0).to_numpy()
        runs = Runs([_bytes(t) for t in batch.column(1).to_pylist()])
        anchors, owner = runs.anchors, ids[runs.texts]
        order = np.lexsort((owner, anchors))
        anchors, owner = anchors[order], owner[order]
        new = np.append(True, anchors[1:] != anchors[:-1])[:len(anchors)]
        own = np.append(True, owner[1:] != owner[:-1])[:len(anchors)] | new  # once for each document
        group = np.cumsum(new) - 1
        shared = np.bincount(group, weights=own)[group] > 1 if len(group) else new
        once, notice, known = ~shared & new, shared & new, shared & own
        blank = pa.nulls(int(notice.sum()), pa.int64())
        yield pa.RecordBatch.from_arrays([
            pa.array(np.concatenate([anchors[once], anchors[notice], words.mixed(anchors[known].view(np.uint64) ^ owner[known].view(np.uint64)).view(np.int64)])),
            pa.concat_arrays([pa.array(owner[once]), blank, pa.array(owner[known])]),
            pa.concat_arrays([pa.nulls(int(once.sum()), pa.int64()), blank, pa.array(anchors[known])])], schema=_SEEN)


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, anchor) of shared anchors, from rows of ``_seen`` that are sorted by key and id."""
    last: tuple[int, int | None, bool] | None = None  # key, id, whether it was found to be shared
    for batch in batches:
        keys, ids, anchor = batch.column(0).to_numpy(), batch.column(1), batch.column(2)
        known = np.asarray(anchor.is_valid())
        out_ids, out_anchors = [np.asarray(ids.filter(pa.array(known)))], [np.asarray(anchor.filter(pa.array(known)))]
        rest = ~known
        keys, named = keys[rest], np.asarray(ids.is_valid())[rest]
        ids = ids.fill_null(0).to_numpy()[rest]
        if len(keys):
            new = np.append(True, keys[1:] != keys[:-1])
            other = np.append(True, ids[1:] != ids[:-1]) | new
            group = np.cumsum(new) - 1
            several = (np.bincount(group, weights=other) > 1) | (np.bincount(group, weights=~named) > 0)
            if last is not None and last[0] == keys[0]:
                several[0] |= last[2] or last[1] != ids[0]
                if several[0] and not last[2]:
                    out_ids.append(np.array([last[1]], np.int64))
                    out_anchors.append(np.array([last[0]], np.int64))
            hit = several[group] & named
            out_ids.append(ids[hit])
            out_anchors.append(keys[hit])
            last = (int(keys[-1]), int(ids[-1]), bool(several[-1]))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_ids), pa.int64()), pa.array(np.concatenate(out_anchors), pa.int64())],
                                         names=["id", "anchor"])


class Collection:
    """Aligned strings that get one column more in every round. ``order`` has their suffixes from the current
    column on in order, ``common`` how many symbols each shares with the one before it."""

    def __init__(self, columns: np.ndarray) -> None:
        self.columns = columns  # a row for each column
        self.at, n = len(columns), columns.shape[1]
        self.order, self.common = np.arange(n), np.zeros(n, np.uint8)
        self.common[1:] = LENGTH  # nothing was read: all are equal, and longer prefixes are never asked for

    def insert(self) -> None:
        """The next column on the left."""
        self.at -= 1
        front = self.columns[self.at][self.order]  # the symbols in front, in the old order
        moved = np.argsort(front, kind="stable")
        symbols = front[moved]
        same = np.flatnonzero(symbols[1:] == symbols[:-1]) + 1
        common = np.zeros(len(moved), np.uint8)
        common[same] = np.minimum(self._least(moved[same - 1] + 1, moved[same]), LENGTH) + 1
        self.order, self.common = self.order[moved], common

    def _least(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """The least of ``common`` between two places, both included, for many pairs of places."""
        span = last - first + 1
        level = np.frexp(span.astype(np.float64))[1] - 1
        out = np.empty(len(first), np.uint8)
        least = self.common
        for k in range(int(level.max(initial=-1)) + 1):
            if k:
                half = 1 << k - 1
                least = np.minimum(least[:-half], least[half:])
            here = np.flatnonzero(level == k)
            out[here] = np.minimum(least[first[here]], least[last[here] - (1 << k) + 1])
        return out


def owned(strings: list[bytes], places: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For each string the bits of those of its windows that no string of a smaller id has. ``places`` are the
    places of the anchors in the strings."""
    n = len(strings)
    sizes = np.array([len(s) for s in strings])
    first = PLACES - 1 - places.astype(np.int64)
    columns = np.full((2 * LENGTH - GRAM, n), _PAD, np.uint8)
    within = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    columns[np.repeat(first, sizes) + within, np.repeat(np.arange(n), sizes)] = np.frombuffer(b"".join(strings), np.uint8)
    collection, bits = Collection(columns), np.zeros(n, np.int64)
    for at in range(len(columns) - 1, -1, -1):
        collection.insert()
        if at < PLACES:
            has = (first <= at) & (first + sizes >= at + LENGTH)
            group = np.cumsum(collection.common < LENGTH) - 1
            order_ids = np.where(has, ids, np.iinfo(np.int64).max)[collection.order]
            least = np.minimum.reduceat(order_ids, np.flatnonzero(np.append(True, group[1:] != group[:-1])))
            mine = np.zeros(n, bool)
            mine[collection.order] = order_ids == least[group]
            here = mine & has
            bits[here] |= 1 << (at - first[here])
    return bits


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, digest, bits) of strings that own windows, from rows sorted by key: collections of whole keys. The bits
    of a window on its own are _SINGLE."""
    held: list[pa.RecordBatch] = []

    def result(rows: pa.Table) -> pa.RecordBatch:
        ids, single = rows["id"].to_numpy(), rows["single"].to_numpy(zero_copy_only=False)
        strings = rows["string"].to_pylist()
        bits = owned(strings, rows["place"].to_numpy(), ids)
        hit = np.flatnonzero(bits)
        return pa.RecordBatch.from_arrays(
            [pa.array(ids[hit]), pa.array([_digest(strings[i]) for i in hit], pa.int64()),
             pa.array(np.where(single, _SINGLE, bits)[hit])], names=["id", "digest", "bits"])

    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= COLLECTION:
            rows = pa.Table.from_batches(held)
            keys = rows["key"].to_numpy()
            cut = int(np.searchsorted(keys, keys[-1]))
            if cut:
                yield result(rows.slice(0, cut))
            held = rows.slice(cut).combine_chunks().to_batches()
    if held and sum(b.num_rows for b in held):
        yield result(pa.Table.from_batches(held))


def _covered(data: bytes, starts: np.ndarray, lengths: np.ndarray, owns: list[dict]) -> np.ndarray:
    """Which bytes are in windows of the runs that the document doesn't own."""
    bits = {o["digest"]: o["bits"] for o in owns if o["bits"] != _SINGLE}
    digests = [_digest(data[s:e]) for s, e in zip(starts.tolist(), (starts + lengths + LENGTH - 1).tolist())]
    own = np.repeat(np.array([bits.get(d, 0) for d in digests], np.int64), lengths)
    at = _windows(starts, lengths)
    lost = at[own >> (at - np.repeat(starts, lengths)) & 1 == 0]
    single = {o["digest"] for o in owns if o["bits"] == _SINGLE}
    if single:
        lost = lost[[_digest(data[a:a + LENGTH]) not in single for a in lost.tolist()]]
    step = np.zeros(len(data) + 1, np.int64)
    np.add.at(step, lost, 1)
    np.add.at(step, lost + LENGTH, -1)
    return np.cumsum(step[:-1]) > 0


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Results of rows without shared anchors; text and runs of shared anchors of the others. A shape is a run's number
    of windows and the place of its anchor."""
    for batch in batches:
        shared = batch.column("shared")
        meets = np.asarray(shared.is_valid())
        data = [_bytes(t) for t in batch.column("text").to_pylist()]
        runs = Runs([d if m else b"" for d, m in zip(data, meets.tolist())])
        hit = np.isin(runs.anchors, shared.flatten().to_numpy())
        sizes = np.bincount(runs.texts[hit], minlength=len(data))
        offsets = pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32))
        lists = [pa.ListArray.from_arrays(offsets, pa.array(c[hit].astype(np.int32))) for c in (
            runs.starts, runs.lengths * _SHAPE + runs.places)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), pa.array([len(d) for d in data], pa.int64()),
             pa.array([None if m else hashlib.sha256(d).hexdigest() for d, m in zip(data, meets.tolist())], pa.string()),
             pa.array([d if m else None for d, m in zip(data, meets.tolist())], pa.binary()), *lists],
            names=["id", "n_bytes", "kept_sha256", "data", "starts", "shapes"])


_SHAPE = 64
_LISTED = "id long, n_bytes long, kept_sha256 string, data binary, starts array<int>, shapes array<int>"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for n, (data, owns) in enumerate(zip(batch.column("data").to_pylist(), batch.column("owns").to_pylist())):
            starts, shapes = (batch.column(c)[n].values.to_numpy().astype(np.int64) for c in ("starts", "shapes"))
            gone = _covered(data, starts, shapes // _SHAPE, owns or [])
            kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
            spans = int((np.diff(np.append(0, gone.view(np.int8))) == 1).sum())
            out.append((len(data) - len(kept), spans, hashlib.sha256(kept).hexdigest(), kept))
        removed, spans, sha, kept = zip(*out) if out else [()] * 4
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), batch.column("n_bytes"), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()),
             pa.array(sha, pa.string()), pa.array(kept, pa.binary())],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def without_repeats(docs: DataFrame, crowd: int = CROWD) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) of every row; ``kept`` are the remaining bytes, null where
    nothing was removed because nothing is shared. Each step is written, so what it shuffled can go, and tables that
    no later step reads are dropped."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), "text")
    seen = rows.filter("id IS NOT NULL").mapInArrow(_seen, "key long, id long, anchor long")
    shared = seen.repartition("key").sortWithinPartitions("key", "id").mapInArrow(_shared, "id long, anchor long")
    lists = written(shared.groupBy("id").agg(F.collect_set("anchor").alias("shared")), "shared")
    listed = written(rows.join(lists, "id", "left").select("id", "text", "shared").mapInArrow(_listed, _LISTED), "listed")
    drop_tables(lists)
    affected = listed.filter("data IS NOT NULL")

    items = affected.select("id", "data", F.explode(F.arrays_zip("starts", "shapes")).alias("r")).select(
        "id", (F.col("r.shapes") % _SHAPE).alias("place"),
        F.expr(f"substring(data, r.starts + 1, CAST(r.shapes DIV {_SHAPE} AS INT) + {LENGTH - 1})").alias("string"))
    strings = written(items.groupBy("place", "string").agg(F.min("id").alias("id")), "strings")
    keyed = strings.select(F.xxhash64(F.expr(f"substring(string, place + 1, {GRAM})")).alias("key"), "place", "string", "id")
    crowded = written(keyed.groupBy("key").count().filter(F.col("count") > crowd).select("key"), "crowded")
    whole = keyed.join(crowded, "key", "left_anti").withColumn("single", F.lit(False))
    singles = keyed.join(crowded, "key", "left_semi").select("id", "place", "string", F.explode(
        F.sequence(F.lit(0), F.octet_length("string") - LENGTH)).alias("at")).groupBy(
        (F.col("place") - F.col("at")).alias("place"), F.expr(f"substring(string, at + 1, {LENGTH})").alias("string")).agg(F.min("id").alias("id"))
    singles = singles.select(F.xxhash64("string").alias("key"), "place", "string", "id", F.lit(True).alias("single"))
    owns = written(whole.unionByName(singles).repartition("key").sortWithinPartitions("key").mapInArrow(
        _build, "id long, digest long, bits long"), "owns")
    drop_tables(strings, crowded)
    by_doc = owns.groupBy("id").agg(F.collect_list(F.struct("digest", "bits")).alias("owns"))

    changed = affected.join(by_doc, "id", "left").select("id", "n_bytes", "data", "starts", "shapes", "owns").mapInArrow(
        _cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    rest = listed.filter("data IS NULL").select(F.col("id").alias("doc_id"), "n_bytes", F.lit(0).cast("long").alias("n_removed"),
                                                F.lit(0).cast("long").alias("n_spans"), "kept_sha256", F.lit(None).cast("binary").alias("kept"))
    return changed.unionByName(rest)


_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS hx FROM documents),
w AS MATERIALIZED (SELECT doc_id, p, substr(hx, 2 * p + 1, 100) AS s FROM (
  SELECT doc_id, hx, unnest(range(strlen(hx) // 2 - 49)) AS p FROM d)),
f AS (SELECT s, min(doc_id) AS first_id FROM w GROUP BY s HAVING min(doc_id) < max(doc_id)),
lost AS (SELECT w.doc_id, w.p FROM w JOIN f USING (s) WHERE w.doc_id > f.first_id),
steps AS (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS before FROM lost),
spans AS (SELECT doc_id, p, sum(CASE WHEN before IS NULL OR p > before + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM steps),
gone AS (SELECT doc_id, k, min(p) AS a, max(p) + 50 AS b FROM spans GROUP BY doc_id, k),
pieces AS (SELECT doc_id, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS open FROM gone),
kept AS (SELECT g.doc_id, sum(g.b - g.a) AS n_removed, count(*) AS n_spans,
  string_agg(substr(d.hx, (2 * g.open + 1)::BIGINT, (2 * (g.a - g.open))::BIGINT), '' ORDER BY g.a) AS front, max(g.b) AS rest
  FROM pieces g JOIN d USING (doc_id) GROUP BY g.doc_id)
SELECT d.doc_id, strlen(hx) // 2 AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(CASE WHEN n_spans IS NULL THEN hx ELSE front || substr(hx, (2 * rest + 1)::BIGINT) END)) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""


@query("op13_suffix_dedup", _SQL)
def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(table(spark, sf_dir, "documents")).drop("kept")
