"""Document fingerprints: quartile bucket digests.

Byte triplets of the UTF-8 text (positions 0-1-2, 0-1-3 and 0-2-4 of a sliding window) are hashed
into 512 buckets and counted. The digest holds one byte for the length (logarithmic), one for the
ratios of the quartiles of the counts, and two bits per bucket: how many quartiles its count
exceeds. Two digests differ by the sum of their code differences plus the (cyclic) length and ratio
differences; likeness is one minus that sum over its largest value that counts, not below 0.

Defined results: a null text counts as empty; texts shorter than a triplet have only zero buckets;
equal texts have equal digests. Work per row is linear in its text, rows are independent.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crestline.llm.common import query, small_batches, table, written

BITS = 9
BUCKETS = 1 << BITS
TRIPLETS = ((0, 1, 2), (0, 1, 3), (0, 2, 4))
#: Difference at which two digests have nothing in common (likeness 0): a code step per bucket.
MOST = float(BUCKETS)


def digest(data: bytes) -> str:
    """Hexadecimal digest of a byte string."""
    b = np.frombuffer(data, dtype=np.uint8).astype(np.uint32)
    counts = np.zeros(BUCKETS, dtype=np.int64)
    for salt, (i, j, k) in enumerate(TRIPLETS):
        m = len(b) - k
        if m > 0:
            x = b[i:m + i] * np.uint32(0x9E3779B1) ^ b[j:m + j] * np.uint32(0x85EBCA77)
            x += b[k:m + k] * np.uint32(0xC2B2AE3D) + np.uint32(salt * 7919)
            x ^= x >> np.uint32(15)
            x *= np.uint32(0x2C1B3C6D)
            counts += np.bincount(x >> np.uint32(32 - BITS), minlength=BUCKETS)
    ordered = np.sort(counts)
    q1, q2, q3 = (int(ordered[BUCKETS * n // 4 - 1]) for n in (1, 2, 3))
    length = min(255, int(8 * math.log2(len(data) + 1)))
    ratios = (q1 * 15 // q3 << 4 | q2 * 15 // q3) if q3 else 0
    codes = ((counts > q1).astype(np.uint8) + (counts > q2) + (counts > q3)).reshape(-1, 4)
    packed = codes[:, 0] << 6 | codes[:, 1] << 4 | codes[:, 2] << 2 | codes[:, 3]
    return f"{length:02x}{ratios:02x}" + packed.astype(np.uint8).tobytes().hex()


def likeness(a: str, b: str) -> float:
    """1 for equal digests down to 0."""
    if a == b:
        return 1.0
    x, y = (np.frombuffer(bytes.fromhex(s), dtype=np.uint8) for s in (a, b))
    codes = [np.stack([v[2:] >> s & 3 for s in (6, 4, 2, 0)]).astype(np.int16) for v in (x, y)]
    apart = int(np.abs(codes[0] - codes[1]).sum())
    apart += min(16, abs(int(x[0]) - int(y[0])))
    for shift in (4, 0):  # quartile ratios, cyclic
        d = abs(int(x[1] >> shift & 15) - int(y[1] >> shift & 15))
        apart += min(d, 16 - d)
    return max(0.0, 1.0 - apart / MOST)


FINGERPRINTS = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("fingerprint", pa.string())])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, fingerprint) of every row; no shuffle."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(t) for t in texts], pa.int64()),
                 pa.array([digest(t.encode()) for t in texts], pa.string())], schema=FINGERPRINTS)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, n_chars long, fingerprint string")


def edited(text: str, following: str) -> str:
    """The last quarter (rounded down) replaced by as many first code points of the next text."""
    k = len(text) // 4
    return text[:len(text) - k] + following[:k]


_NEIGHBOURS = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
               "near_edited double, near_next double")
_ROW = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()),
                  ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()),
                  ("near_edited", pa.float64()), ("near_next", pa.float64()),
                  ("part", pa.int32()), ("first_text", pa.string()), ("last_text", pa.string())])


def _judge(doc_id, text: str, mark: str, following: str, next_mark: str) -> tuple:
    new = edited(text, following)
    data = new.encode()
    new_mark = digest(data) if new != text else mark
    return (doc_id, len(text), hashlib.sha256(data).hexdigest(), mark, new_mark,
            likeness(mark, new_mark), likeness(mark, next_mark))


def compare_neighbours(docs: DataFrame) -> DataFrame:
    """Fingerprint of every text, of its edited text, and the likeness to both the edited and the
    next text in the order (doc_id, text), nulls first; the first row follows the last one.

    Texts are range partitioned and sorted once; a task streams its range and keeps two rows. The
    last row of a range waits for the first of the next range that has rows: a task hands on these
    two texts, and a join on the range's number pairs them. Rows of one doc_id stay in one range.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, first, before = TaskContext.get().partitionId(), None, None
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                text = text or ""
                now = (doc_id, text, digest(text.encode()))
                if before is None:
                    first = text
                else:
                    out.append(_judge(*before, *now[1:]) + (None, None, None))
                before = now
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(zip(*out), _ROW)], schema=_ROW)
        if before is not None:
            edge = (before[0], None, None, None, None, None, None, part, first, before[1])
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(edge, _ROW)], schema=_ROW)

    ordered = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange("doc_id").sortWithinPartitions(
        "doc_id", "text")
    rows = written(ordered.mapInArrow(run, _NEIGHBOURS + ", part int, first_text string, last_text string"),
                   "neighbours")
    edges = rows.filter("part IS NOT NULL")
    # one narrow row per range: bounded by the number of partitions
    order = Window.orderBy("part")
    pairs = edges.select("part").withColumn("next_part", F.coalesce(
        F.lead("part").over(order), F.min("part").over(Window.partitionBy())))
    heads = edges.select(F.col("part").alias("next_part"), F.col("first_text").alias("following"))
    waiting = edges.select("part", "doc_id", "last_text").join(pairs, "part").join(heads, "next_part").select(
        "doc_id", "last_text", "following")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(list(_ROW)[:7])
        for batch in batches:
            out = [_judge(i, t, digest(t.encode()), n, digest(n.encode()))
                   for i, t, n in zip(*(c.to_pylist() for c in batch.columns))]
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    done = rows.filter("part IS NULL").drop("part", "first_text", "last_text")
    return done.unionByName(waiting.mapInArrow(finish, _NEIGHBOURS))


@query("op1_fingerprints")
def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_neighbours(table(spark, sf_dir, "documents"))
