"""Near-duplicate documents by min-max hashing, confirmed on full shingle sets.

A document's set holds its distinct runs of five words, ASCII letters in lower case; a shorter text is
one run. Under each permutation both the minimum and the maximum of the set are kept, so 90 hash passes
give 180 signature values. A band is the minima and maxima of three permutations; at the similarity of
the threshold a pair shares no band with probability (1 - 0.85 ** 6) ** 30 = 7e-7. Other thresholds take as
many bands as that needs: 47 at 0.8.

Documents with equal sets are one class from the start (a group by a 128-bit digest), so exact copies
cost one row each. Classes that share a band's bucket are candidates, but no bucket is turned into all
its pairs:

1. every member of a bucket is compared with the bucket's smallest member (its pivot);
2. components of the confirmed links settle every bucket whose members are all connected;
3. in the others, members outside the component of another, hashed pivot are compared with that one;
4. what is still apart in some bucket meets by an exact prefix join. Sets that are linked by buckets are a family
   with a pivot of its own, and each set is replaced by its difference from that pivot's: two sets differ
   from each other in just what their differences don't share, and what the variants of one text have in
   common is in none of them. With a difference's shingles ordered from rare to frequent, two sets can only
   be near if they share a shingle so early in both orders that enough is left behind it. Members of a
   shingle are compared with the one nearest to the pivot first; then those of different components, and of
   the members of a frequent shingle those outside its largest component with the others.

So each pair of a bucket is confirmed, refuted, or joined already, at any bucket size, and of the variants of one
text that are not near each other only those meet as pairs that differ from it in mostly the same places. Confirmation joins the full sets of both classes;
pivots are salted.

Defined results: texts without words have an empty set and no links; null texts too. Rows that share a
doc_id are linked. A row without doc_id has the component of its copies and is marked as kept only if
none of them has an id. Extra columns are ignored (``keep_first`` and ``keep_one`` carry them along).
``kept`` and ``keep_first`` go by doc_id, so repeated rows and rows without one stay; ``keep_one`` goes by row.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from xxhash import xxh3_128_hexdigest

from crestline.llm import words
from crestline.llm.common import query, small_batches, table, written
from crestline.llm.graph import components
from crestline.session import drop_tables

SHINGLE = 5
#: Links need 100 * intersection >= PERCENT * union.
PERCENT = 85
PER_BAND = 3
#: Probability at most that a pair at the threshold shares no band.
MISSED = 7.5e-7
PIVOT_ROUNDS = 2
SALTS = 32
#: Shingles hashed under all permutations at once.
CHUNK = 4096

_HALF = np.uint64(32)
_EARLY = ("node", "label", "behind", "over")


def band_count(percent: int = PERCENT) -> int:
    return math.ceil(math.log(MISSED) / math.log(1 - (percent / 100) ** (2 * PER_BAND)))


BANDS = band_count()


@lru_cache
def _permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    seeds = words.mixed(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return seeds[::2, None], seeds[1::2, None] | np.uint64(1)


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the document's set."""
    found = words.hashes(words.split(text.lower() if text and text.isascii() else _lower(text)))
    if len(found) < SHINGLE:
        return words.runs(found, len(found), seed=len(found)) if len(found) else found
    return np.unique(words.runs(found, SHINGLE))


def _lower(text: str | None) -> str | None:
    return text.encode().lower().decode() if text else text  # bytes.lower() changes A-Z only


def signature(values: np.ndarray, n: int = BANDS * PER_BAND) -> tuple[np.ndarray, np.ndarray]:
    """Minimum and maximum of the set under each of n permutations."""
    xor, mul = _permutations(n)
    low = np.full(n, np.iinfo(np.uint64).max, np.uint64)
    high = np.zeros(n, np.uint64)
    for at in range(0, len(values), CHUNK):
        x = (values[at:at + CHUNK] ^ xor) * mul
        x ^= x >> _HALF
        np.minimum(low, x.min(axis=1), out=low)
        np.maximum(high, x.max(axis=1), out=high)
    return low, high


def bands(values: np.ndarray, n: int = BANDS) -> np.ndarray:
    """A bucket number for each of n bands."""
    low, high = (s.reshape(n, PER_BAND) for s in signature(values, n * PER_BAND))
    key = np.arange(1, n + 1, dtype=np.uint64)
    for i in range(PER_BAND):
        key = words.mixed(words.mixed(key + low[:, i]) + high[:, i])
    return key.view(np.int64)


_SIGNED = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.string()),
                     ("buckets", pa.list_(pa.int64()))])


def signed(docs: DataFrame, n: int = BANDS) -> DataFrame:
    """(doc_id, n_shingles, digest, buckets) of every row; empty sets have neither digest nor buckets."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([len(s) for s in sets], pa.int64()),
                pa.array([xxh3_128_hexdigest(s.tobytes()) if len(s) else None for s in sets], pa.string()),
                pa.array([bands(s, n) if len(s) else None for s in sets], pa.list_(pa.int64()))], schema=_SIGNED)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, n_shingles long, digest string, buckets array<long>")


def _full_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, s): sorted shingle sets of the documents whose ids are in ``wanted`` (node)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("node", pa.int64()), ("s", pa.list_(pa.int64()))])
        for batch in batches:
            sets = [shingles(t).view(np.int64) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], schema=schema)

    texts = docs.select(F.col("doc_id").cast("long").alias("node"), "text").join(wanted, "node", "left_semi")
    return texts.mapInArrow(run, "node long, s array<long>")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The ``pairs`` (a, b) whose full sets are similar enough. Many pairs may share b: its set is dealt
    to as many salted copies as there are salts among them, so none of them meets all pairs."""
    salted = pairs.select("a", "b", _salt("a"))
    left = salted.join(sets.select(F.col("node").alias("a"), F.col("s").alias("sa")), "a")
    right = salted.select("b", "salt").distinct().join(sets.select(F.col("node").alias("b"), F.col("s").alias("sb")), "b")
    na, nb = F.size("sa"), F.size("sb")
    near = F.least(na, nb) * 100 >= F.greatest(na, nb) * percent  # else the sizes alone refute it
    common = F.size(F.array_intersect("sa", "sb"))
    return left.join(right, ["b", "salt"]).filter(near).filter(
        common * 100 >= (na + nb - common) * percent).select("a", "b").distinct()


def _other_pairs(found: DataFrame, tested: DataFrame) -> DataFrame:
    """Distinct pairs (a, b) that were not tested in either direction."""
    lo, hi = F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")
    return found.select("a", "b", lo, hi).dropDuplicates(["lo", "hi"]).join(
        tested.select(lo, hi), ["lo", "hi"], "left_anti").select("a", "b")


def _salt(node: str) -> Column:
    return F.pmod(F.xxhash64(node), F.lit(SALTS)).alias("salt")


def _differences(left: DataFrame, sets: DataFrame) -> DataFrame:
    """(family, node, set, size, differs, pivot, pivot_size): in what the sets of ``left`` (node, family) differ from
    that of their family's pivot, a member of median size; all differences hold at most three times the sets."""
    own = written(sets.join(left, "node").groupBy("family", "node", F.xxhash64("s").alias("set")).agg(
        F.any_value("s").alias("s")).withColumn("size", F.size("s")), "own-sets")
    median = own.groupBy("family").agg(F.percentile_approx("size", 0.5).alias("size"))
    chosen = own.join(median, ["family", "size"]).groupBy("family").agg(F.min(F.struct("node", "set")).alias("first"))
    pivots = own.join(chosen.select("family", "first.*"), ["family", "node", "set"]).select(
        "family", F.col("node").alias("pivot"), F.col("size").alias("pivot_size"), F.col("s").alias("p"))
    salted = own.withColumn("salt", _salt("node"))
    dealt = salted.select("family", "salt").distinct().join(pivots, "family")
    out = written(salted.join(dealt, ["family", "salt"]).select(
        "family", "node", "set", "size", F.concat(F.array_except("s", "p"), F.array_except("p", "s")).alias("differs"),
        "pivot", "pivot_size"), "differences")
    drop_tables(own)
    return out


def _early(differences: DataFrame, percent: int) -> DataFrame:
    """(family, token, node, behind, over): the shingles that lie early enough in their difference. Sets a and b
    are only near if their differences share (over_a + over_b) / 2 / (100 + percent) shingles; before the first
    shared one, in an order common to all, lie only shingles of one of them, so as many are behind it in both.
    That holds for any order; rare ones first leaves the fewest pairs."""
    unit, size = 100 + percent, F.col("size")
    tokens = differences.select("family", "node", "set", "size", F.size("differs").alias("d"), F.explode("differs").alias("token"))
    frequency = tokens.groupBy("family", "token").agg(F.count("*").alias("n")).filter("n > 1")
    one = Window.partitionBy("family", "node", "set")  # a document's own shingles
    shared = tokens.join(frequency, ["family", "token"]).withColumn("rank", F.row_number().over(one.orderBy("n", "token"))).withColumn(
        "behind", F.count("*").over(one) - F.col("rank") + 1)  # shared shingles from this one on; the single ones lie before
    # a near set is at most 100 / percent times as large, and its difference holds what is shared
    far = written(shared.filter(F.col("behind") * percent >= F.col("d") * percent - size * (100 - percent)).select(
        "family", "token", "node", "rank", "behind", (F.col("d") * unit - size * (100 - percent)).cast("long").alias("over")),
        "shared-shingles")
    # neither set's part of 2 * unit * shared is more than all it has: over <= room of the other
    heads = far.filter("rank = 1").select("family", "over", (F.col("behind") * 2 * unit - F.col("over")).alias("room"))
    level = lambda c: F.floor(F.col(c) / unit).alias("level")
    levels = heads.select("family", level("room"), "over").unionByName(
        heads.select("family", level("over"), F.lit(None).cast("long").alias("over"))).groupBy("family", "level").agg(
        F.min("over").alias("over"))
    upwards = Window.partitionBy("family").orderBy(F.desc("level"))  # a row per size of sets, not per set
    least = levels.select("family", "level", F.min("over").over(upwards).alias("other")).filter("other IS NOT NULL")
    early = written(far.withColumn("level", level("over")).join(least, ["family", "level"]).filter(
        F.col("behind") * 2 * unit >= F.col("over") + F.col("other")).select("family", "token", "node", "behind", "over"),
        "early-shingles")
    drop_tables(far)
    return early


def _enough(percent: int) -> Column:
    return (F.col("label") != F.col("label_b")) & (
        F.least("behind", "behind_b") * (2 * (100 + percent)) >= F.col("over") + F.col("over_b"))


def _to_pivots(differences: DataFrame, early: DataFrame, labelled: Callable[..., DataFrame], percent: int) -> DataFrame:
    """Pairs (a, b) of different labels: sets that are near their family's pivot with it, as sets whose
    differences are so small that they need share nothing are; early ones with the one of a shingle's
    that differs least from the pivot."""
    near = labelled(differences.filter(F.size("differs") * (100 + percent) <= (F.col("size") + F.col("pivot_size")) * (100 - percent)))
    pairs = labelled(near, "pivot", "label_b").filter("label <> label_b").select(F.col("node").alias("a"), F.col("pivot").alias("b"))
    early = labelled(early)
    least = early.groupBy("family", "token").agg(F.min_by(F.struct(*[F.col(c).alias(f"{c}_b") for c in _EARLY]), F.struct(
        "over", "node")).alias("p")).select("family", "token", "p.*")
    return pairs.unionByName(early.join(least, ["family", "token"]).filter(_enough(percent)).select(
        F.col("node").alias("a"), F.col("node_b").alias("b")))


def _may_be_near(early: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different labels that no place of a shared ``early`` shingle refutes."""
    most = early.groupBy("family", "token", "label").agg(F.count("*").alias("n")).groupBy("family", "token").agg(
        F.max_by("label", F.struct("n", "label")).alias("main"))
    strays = early.join(most, ["family", "token"]).filter("label <> main").select("family", "token", *[
        F.col(c).alias(f"{c}_b") for c in _EARLY])
    return early.join(strays, ["family", "token"]).filter(_enough(percent)).select(
        F.col("node").alias("a"), F.col("node_b").alias("b"))


def clusters(docs: DataFrame, percent: int = PERCENT, same: DataFrame | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row. ``same`` = (doc_id, name), for docs with
    distinct ids: rows with equal names are linked, empty ones too."""
    rows = written(signed(docs, band_count(percent)), "signed")
    classes = written(rows.filter("digest IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("node")), "classes")
    # left side: a class may hold a third of all rows
    member = rows.select("doc_id", "n_shingles", "digest").join(classes, "digest", "left")
    shared = member.filter("doc_id IS NOT NULL AND node IS NOT NULL").groupBy("doc_id").agg(
        F.min("node").alias("a"), F.max("node").alias("b")).filter("a < b")
    same_id = shared.select("a", "b").unionByName(shared.select(F.col("doc_id").alias("a"), "b")).filter("a <> b")
    if same is not None:
        member = member.withColumn("node", F.coalesce("node", "doc_id"))
        named = member.select("doc_id", "node").join(same.filter("name IS NOT NULL"), "doc_id")
        lowest = named.groupBy("name").agg(F.min("node").alias("b"), F.max("node").alias("last")).filter("b < last")
        same_id = named.join(lowest, "name").select(F.col("node").alias("a"), "b").filter("a <> b").distinct()

    heads = rows.select(F.col("doc_id").alias("node"), "digest", "buckets").join(
        classes.filter("node IS NOT NULL"), ["digest", "node"], "left_semi")
    dealt = heads.select("node", F.explode("buckets").alias("bucket"))
    pivots = dealt.groupBy("bucket").agg(F.min("node").alias("pivot"), F.max("node").alias("last")).filter(
        "pivot < last").drop("last")
    members = written(dealt.join(pivots, "bucket"), "members")
    tested = written(members.filter("node <> pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b")).distinct(), "pairs")
    wanted = members.select("node").distinct()
    sets = written(_full_sets(docs, wanted), "shingle-sets")
    links = written(confirmed(tested, sets, percent).unionByName(same_id), "links")
    labels = components(links)

    def labelled(df: DataFrame, node: str = "node", name: str = "label") -> DataFrame:
        """With the label of each ``node``."""
        found = labels.select(F.col("node").alias(node), F.col("label").alias(name))
        return df.join(found, node, "left").withColumn(name, F.coalesce(name, node))

    def apart() -> DataFrame:
        """Members of the buckets that are not one component, with their label."""
        own = labelled(members.select("bucket", "node"))
        split = own.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo < hi")
        return own.join(split.select("bucket"), "bucket")

    def compare(pairs: DataFrame) -> bool:
        """Confirm new pairs and renew the labels; whether there were any."""
        nonlocal tested, links, labels
        pairs = written(pairs, "pairs")
        if pairs.isEmpty():
            return False
        found = written(confirmed(pairs, sets, percent), "links")
        tested = tested.unionByName(pairs)
        if not found.isEmpty():
            links = links.unionByName(found)
            labels = components(links)
        return True

    for n in range(PIVOT_ROUNDS):
        own = written(apart(), "apart")
        chosen = own.groupBy("bucket").agg(F.min_by(F.struct("node", "label"), F.xxhash64("node", F.lit(n))).alias("p"))
        if not compare(_other_pairs(own.join(chosen, "bucket").filter("label <> p.label").select(
                F.col("node").alias("a"), F.col("p.node").alias("b")), tested)):
            break
    left = written(apart().select("bucket", "node"), "apart")
    if not left.isEmpty():
        first = left.groupBy("bucket").agg(F.min("node").alias("b"))
        family = components(left.join(first, "bucket").select(F.col("node").alias("a"), "b").filter("a <> b").distinct())
        differences = _differences(family.withColumnRenamed("label", "family"), sets)
        early = _early(differences, percent)
        compare(_other_pairs(_to_pivots(differences, early, labelled, percent), tested))
        compare(_other_pairs(_may_be_near(labelled(early), percent), tested))
        drop_tables(differences, early)

    drop_tables(sets, members)  # what follows reads only rows, classes and labels
    component = F.coalesce("label", "node", "doc_id")
    return member.join(labels, "node", "left").select(
        "doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))


def keep_first(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs``, all columns, that their component keeps; rows without doc_id stay."""
    gone = clusters(docs, percent).filter("NOT kept")
    ids = gone.filter("doc_id IS NOT NULL").select(F.col("doc_id").alias("gone_id")).distinct()
    return docs.join(ids, docs["doc_id"] == ids["gone_id"], "left_anti")


def keep_one(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``docs``, all columns, with exactly one row of each component: one of the smallest doc_id, one
    without doc_id only where no row has any. Copies without doc_id and rows that are repeated as a whole
    are told apart by the number of the row in a written copy, which takes the place of doc_id."""
    keyed = written(docs.select(F.monotonically_increasing_id().alias("at"), F.struct("*").alias("own")), "keyed")
    ids = keyed.select(F.col("at").alias("doc_id"), F.col("own.doc_id").cast("long").alias("name"))
    found = clusters(keyed.select(F.col("at").alias("doc_id"), "own.text"), percent, ids).select("doc_id", "component_id")
    ranked = found.join(ids, "doc_id").select("doc_id", "component_id", F.col("name").isNull().alias("unnamed"), "name")
    ranked = written(ranked, "components")
    first = ranked.groupBy("component_id").agg(
        F.min(F.struct("unnamed", "name", "doc_id")).alias("first"), F.count("*").alias("n")).filter("n > 1")
    gone = ranked.join(first, "component_id").filter("doc_id <> first.doc_id").select(F.col("doc_id").alias("at"))
    return keyed.join(gone, "at", "left_anti").select("own.*")


@query("op8_near_duplicates")
def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters(table(spark, sf_dir, "documents"))
