"""Files that are one JSON array (or object), read by many tasks.

Spark cuts the text at opening braces, so every task gets its byte range of a file in any store that Spark
reads, and no row is larger than what lies between two braces. What a brace means depends on what came
before: whether it stands in a string and how deep. Three steps settle that:

1. Each split is reduced to what it does to (in a string, depth), once for either start, since nobody knows
   yet whether it begins in a string. One row a split.
2. The rows of a file are folded in order: the state that each split begins with, and the split that holds
   the start of the record which is open there. A file has as many rows as splits.
3. Each split is read again with its state and gives its whole records, and the parts of records that cross
   its ends; parts are put together by the split where the record begins.

Splits are what the three steps count in; tasks are fewer when splits are small, and read neighbours one after
the other. The text is read twice, and what is found is written to the shared folder, where later readers share it by
ordinary splits. A task holds one batch and one record.

A file whose brackets don't close, or whose root is neither array nor object, is one row with ``broken``
set, like a file that a whole-file reader can't parse. Elements that are no objects are left out. White
space, escapes, and brackets and quotes in strings may lie across any boundary.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crestline.session import written_table

_QUOTE, _BACKSLASH = ord('"'), ord("\\")
_STEP = np.zeros(256, np.int8)
_STEP[[ord("{"), ord("[")]] = 1
_STEP[[ord("}"), ord("]")]] = -1
#: Text of a broken file that is kept; also the most that a member's name may have in front of its value.
_SAMPLE = 1000
#: Text of one task. Splits may be smaller (a task reads several) and are never larger than the reader made them.
TASK_BYTES = 16 << 20
#: Depth of records in an array of the root object.
_IN_MEMBER = 2
_STATES = ("file_path string, block long, in_string long, depth long, owner long, base long, broken boolean")
_PIECES = "kind string, file_path string, owner long, part long, row long, value string"


def _marks(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of brackets, the step of each, and the number of quotes before each; last, of all quotes."""
    b = np.frombuffer(data, np.uint8)
    quote = b == _QUOTE
    slashes = np.flatnonzero(b == _BACKSLASH)
    if len(slashes):
        # what follows an odd run of backslashes is escaped
        ends = np.flatnonzero(np.append(slashes[1:] != slashes[:-1] + 1, True))
        odd = np.diff(np.append(-1, ends)) % 2 == 1
        after = slashes[ends[odd]] + 1
        quote[after[after < len(b)]] = False
    quotes = np.flatnonzero(quote)
    at = np.flatnonzero(_STEP[b])
    return at, _STEP[b[at]].astype(np.int64), np.append(np.searchsorted(quotes, at), len(quotes))


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], bytes, dict]]:
    """(file, block), bytes and other columns of consecutive rows of a split."""
    opened: set[tuple[str, int]] = set()
    for batch in batches:
        if not batch.num_rows:
            continue
        paths, blocks = batch.column("file_path").to_pylist(), batch.column("block").to_pylist()
        values = batch.column("value").cast(pa.binary()).to_pylist()
        for key, rows in groupby(range(batch.num_rows), lambda i: (paths[i], blocks[i])):
            rows = list(rows)
            data = b"{".join(values[rows[0]:rows[-1] + 1])
            if key[1] or key in opened:  # all but a file's first piece follow a brace
                data = b"{" + data
            opened = {key}
            yield key, data, {c: batch.column(c)[rows[0]].as_py() for c in batch.schema.names[3:]}


def _effects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each split: its first character that is no white space, and for a start outside and inside of a string:
    whether it ends in one, by how much the depth changes, the least depth on the way."""
    for (path, block), chunks in groupby(_chunks(batches), lambda c: c[0]):
        root, quotes = "", 0
        depth, low = np.zeros(2, np.int64), np.zeros(2, np.int64)
        for _, data, _ in chunks:
            if not root:
                root = data.removeprefix(b"\xef\xbb\xbf").lstrip()[:1].decode("ascii", "replace")
            at, step, before = _marks(data)
            for start in (0, 1):
                free = step[(before[:-1] + quotes + start) % 2 == 0]
                if len(free):
                    walk = depth[start] + np.cumsum(free)
                    low[start], depth[start] = min(low[start], walk.min()), walk[-1]
            quotes += int(before[-1])
        yield pa.RecordBatch.from_pylist([{
            "file_path": path, "block": block, "root": root, "odd": quotes % 2, "depth": depth.tolist(), "low": low.tolist()}], schema=_EFFECT)


_EFFECT = pa.schema([("file_path", pa.string()), ("block", pa.int64()), ("root", pa.string()), ("odd", pa.int64()),
                     ("depth", pa.list_(pa.int64())), ("low", pa.list_(pa.int64()))])


def _folded(in_object: bool):
    def fold(splits: pa.Table) -> pa.Table:
        rows = sorted(splits.to_pylist(), key=lambda r: r["block"])
        root = next((r["root"] for r in rows if r["root"]), "")
        # records lie this deep: below the array, or are the root, or below an array in the root
        base = _IN_MEMBER if in_object else 1 if root == "[" else 0
        broken = root not in (("{",) if in_object else ("[", "{")) and root != ""
        out, quoted, depth, owner = [], 0, 0, None
        for r in rows:
            out.append({"file_path": r["file_path"], "block": r["block"], "in_string": quoted, "depth": depth, "owner": owner, "base": base})
            low, after = depth + r["low"][quoted], depth + r["depth"][quoted]
            broken |= low < 0
            if after <= base:
                owner = None
            elif low <= base or owner is None:  # the record that is open now begins here
                owner = r["block"]
            depth, quoted = after, (quoted + r["odd"]) % 2
        broken |= bool(depth or quoted)
        return pa.Table.from_pylist([{**r, "broken": broken} for r in out], schema=_STATE)
    return fold


_STATE = pa.schema([("file_path", pa.string()), ("block", pa.int64()), ("in_string", pa.int64()), ("depth", pa.int64()),
                    ("owner", pa.int64()), ("base", pa.int64()), ("broken", pa.bool_())])
_PIECE = pa.schema([("kind", pa.string()), ("file_path", pa.string()), ("owner", pa.int64()), ("part", pa.int64()),
                    ("row", pa.int64()), ("value", pa.string())])


def _key_before(data: bytes) -> str | None:
    """The member name in front of a value: ``"name" :``."""
    head = data.rstrip()
    if not head.endswith(b":") or not (head := head[:-1].rstrip()).endswith(b'"'):
        return None
    return head[head.rfind(b'"', 0, -1) + 1:-1].decode("utf-8", "replace")


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records, parts of records and names of members of the root (kinds record, part, name, broken). The row of a
    record is the number of those that begin before it in the split, -1 in parts that don't have its start."""
    for (path, block), chunks in groupby(_chunks(batches), lambda c: c[0]):
        first, begun, quotes = True, 0, 0
        held: list[bytes] = []  # of the record that is open
        before_chunk = b""
        for _, data, state in chunks:
            if first:
                if state["depth"] is None:
                    raise RuntimeError(f"splits of {path} changed between two passes")
                first, base, depth, quotes = False, state["base"], state["depth"], state["in_string"]
                owner, row, broken = state["owner"], -1, state["broken"]
                if broken and not block:
                    yield _batch([("broken", path, 0, 0, 0, data[:_SAMPLE])])
            if broken:
                continue
            at, step, before = _marks(data)
            free = (before[:-1] + quotes) % 2 == 0
            quotes += int(before[-1])
            at, step = at[free], step[free]
            walk = depth + np.cumsum(step)
            depth = int(walk[-1]) if len(walk) else depth
            begin = at[(step > 0) & (walk == base + 1)].tolist()
            end = (at[(step < 0) & (walk == base)] + 1).tolist()
            out: list[tuple] = []
            if base == _IN_MEMBER:
                for p in at[(step > 0) & (walk == base)].tolist():
                    out.append(("name", path, block, 0, begun + bisect_left(begin, p), _key_before(before_chunk + data[:p])))
                before_chunk = (before_chunk + data)[-_SAMPLE:]
            if owner is not None:
                held.append(data[:end[0]] if end else data)
                if end:
                    out.append(("record" if owner == block else "part", path, owner, block, row, b"".join(held)))
                    held, owner, end = [], None, end[1:]
            out += [("record", path, block, block, begun + i, data[b:e]) for i, (b, e) in enumerate(zip(begin, end))]
            if len(begin) > len(end):
                owner, row, held = block, begun + len(begin) - 1, [data[begin[-1]:]]
            begun += len(begin)
            if out:
                yield _batch(out)
        if held:
            yield _batch([("part", path, owner, block, row, b"".join(held))])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows))
    columns[5] = [v.decode("utf-8", "replace") if isinstance(v, bytes) else v for v in columns[5]]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _PIECE)], schema=_PIECE)


@contextmanager
def _setting(spark: SparkSession, key: str, value: int | None):
    old = spark.conf.get(key, None)
    if value is not None:
        spark.conf.set(key, str(value))
    try:
        yield
    finally:
        if value is not None:
            spark.conf.unset(key) if old is None else spark.conf.set(key, old)


def _tasks(text: DataFrame, split_bytes: int) -> int:
    """Number of tasks that read the splits of ``text``: enough for all cores, each with about ``TASK_BYTES``."""
    splits = text.rdd.getNumPartitions()
    return max(1, min(splits, max(4 * text.sparkSession.sparkContext.defaultParallelism, -(-splits * split_bytes // TASK_BYTES))))


def split_records(spark: SparkSession, paths: str | Sequence[str], member: str | None = None,
                  split_bytes: int | None = None) -> DataFrame:
    """(file_path, area_pos, value, broken): the text of every record of array files, with its place in the file
    (order by it). With ``member``, records are the elements of that array in a root object; a file without it
    is an error. ``split_bytes`` overrides the session's size of a split."""
    def text() -> DataFrame:
        df = spark.read.option("lineSep", "{").option("ignoreMissingFiles", True).text(paths if isinstance(paths, str) else list(paths))
        rows = df.select(F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_block_start").alias("block"), "value")
        return rows.coalesce(_tasks(rows, split_bytes)) if split_bytes else rows

    in_object = member is not None
    with _setting(spark, "spark.sql.files.maxPartitionBytes", split_bytes):
        effects = text().mapInArrow(_effects, "file_path string, block long, root string, odd long, depth array<long>, low array<long>")
        states = written_table(effects.groupBy("file_path").applyInArrow(_folded(in_object), _STATES), "splits")
        # one short row for each split, of which the driver holds more itself; rows of a split must stay in order
        pieces = written_table(text().join(F.broadcast(states), ["file_path", "block"], "left").mapInArrow(_pieces, _PIECES), "records")
    parts = pieces.filter("kind = 'part'").groupBy("file_path", "owner").agg(
        F.max("row").alias("row"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "value"))), lambda p: p["value"]), "").alias("value"))
    whole = pieces.filter("kind IN ('record', 'broken')")
    place = F.struct(F.col("owner").alias("block"), "row").alias("area_pos")
    columns = ["file_path", place, "value"]
    out = whole.select(*columns, (F.col("kind") == "broken").alias("broken")).unionByName(
        parts.select(*columns, F.lit(False).alias("broken")))
    out = out.filter("broken OR startswith(value, '{')")
    return _of_member(states, pieces, out, member) if in_object else out


def _of_member(states: DataFrame, pieces: DataFrame, records: DataFrame, member: str) -> DataFrame:
    """Records of one array of the root object: those after its name and before the next name."""
    names = pieces.filter("kind = 'name'").groupBy("file_path").agg(F.array_sort(F.collect_list(F.struct(
        F.struct(F.col("owner").alias("block"), "row").alias("place"), "value"))).alias("names"))
    has = F.coalesce(F.exists("names", lambda n: n["value"] == member), F.lit(False))
    if not states.select("file_path").distinct().join(names, "file_path", "left").filter(~has).isEmpty():
        raise ValueError(f"expected an object with an array {member!r}")
    last = F.filter("names", lambda n: n["place"] <= F.col("area_pos"))
    return records.join(names, "file_path").filter(F.element_at(last, -1)["value"] == member).drop("names")
