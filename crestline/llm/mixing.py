"""Mixing sources to target weights by Pfair scheduling, in DataFrame and SQL functions only.

A source's documents are dealt into blocks in a random but fixed order (by the MD5 of the id). A round has
as many slots as all sources have shares together, a source's share being its target weight in whole slots.
Block j of a source with ``share`` of ``slots`` is released at slot floor(j * slots / share) and due by
ceil((j + 1) * slots / share). Each slot takes the released block with the earliest deadline (ties: first
source by name). Shares add up to all slots, so every block runs inside its window: after any number of
slots a source is less than one block away from its target, as long as no source is used up. All rows are
kept: slots of sources that ran out close up, and the others go on in proportion.

The windows repeat every round, so one round is scheduled, in one row with an array per source (bounded by
the number of slots and sources, not by rows), and every block finds its slot by an equi join.

No group is gathered: ranks inside a source are counted within parts of the MD5's range, whose number
follows the rows, plus the rows of the parts before.

Defined results: a null source is a source of its own, before all others; a source without a target weight,
or with none above zero, gets one slot a round; rows without doc_id come in the order of a null id's MD5;
rows that repeat an id follow each other in any order. An empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crestline.llm.common import query, table

SLOTS = 1000
BLOCK = 16
#: Rows of one part of the MD5's range, about.
PART_ROWS = 20_000


def source_key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), source), F.lit(""))


def damped(counts: DataFrame) -> DataFrame:
    """Target weights (key, weight) in proportion to the square root of the number of documents."""
    return counts.select("key", F.floor(F.sqrt("n") * 1000).alias("weight"))


def shares(counts: DataFrame, targets: DataFrame, slots: int = SLOTS) -> DataFrame:
    """(key, share): each source's slots a round, at least one."""
    weight = F.when(F.col("weight") > 0, F.col("weight")).otherwise(0)
    known = counts.select("key").join(targets.groupBy("key").agg(F.max("weight").alias("weight")), "key", "left").select(
        "key", F.coalesce(weight, F.lit(0)).alias("weight"))
    total = F.sum("weight").over(Window.partitionBy()).alias("total")  # over one row per source
    return known.select("key", "weight", total).select("key", F.greatest(F.lit(1), F.coalesce(F.floor(
        (F.col("weight") * slots + F.col("total") / 2) / F.when(F.col("total") > 0, F.col("total"))), F.lit(1))).cast("long").alias("share"))


#: One slot: of the released blocks that are left in this round, the source with the earliest deadline.
_STEP = """
aggregate(sequence(0L, slots - 1),
  named_struct('done', transform(own, x -> 0L), 'picks', cast(array() AS array<int>)),
  (acc, t) -> element_at(transform(array(int(array_min(transform(
      filter(sequence(0, size(own) - 1), i -> acc.done[i] < own[i].share AND (acc.done[i] * slots) div own[i].share <= t),
      i -> (((acc.done[i] + 1) * slots + own[i].share - 1) div own[i].share) * size(own) + i)) % size(own))),
    p -> named_struct('done', transform(acc.done, (d, i) -> if(i = p, d + 1, d)), 'picks', concat(acc.picks, array(p)))), 1),
  acc -> acc.picks)
"""


def schedule(share: DataFrame) -> DataFrame:
    """(key, turn, share, slots, spot): the slot of each source's turn in a round."""
    one = share.agg(F.array_sort(F.collect_list(F.struct("key", "share"))).alias("own"), F.sum("share").alias("slots")).filter(
        F.size("own") > 0)
    slot = one.select("own", "slots", F.posexplode(F.expr(_STEP)).alias("spot", "pick"))
    turns = Window.partitionBy("pick").orderBy("spot")  # at most a round's slots
    return slot.select(F.col("own")[F.col("pick")]["key"].alias("key"), F.col("own")[F.col("pick")]["share"].alias("share"),
                       "slots", F.col("spot").cast("long").alias("spot"), (F.row_number().over(turns) - 1).cast("long").alias("turn"))


def _ranked(rows: DataFrame, total: int) -> DataFrame:
    """``rows`` (key, doc_id, ...) with ``place``, the number of rows of the source before."""
    digits = max(1, math.ceil(math.log(max(1, total / PART_ROWS), 16)))
    mark = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    marked = rows.withColumn("mark", mark).withColumn("part", F.substring("mark", 1, digits))
    before = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = marked.groupBy("key", "part").agg(F.count("*").alias("n")).select(
        "key", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("key", "part").orderBy("mark", "doc_id"))
    return marked.withColumn("own", own).join(starts, ["key", "part"]).withColumn(
        "place", F.col("before") + F.col("own") - 1).drop("mark", "part", "own", "before")


def interleaved(rows: DataFrame, targets: DataFrame | None = None, slots: int = SLOTS, block: int = BLOCK) -> DataFrame:
    """``rows`` (doc_id, source, ...) with block, release, deadline, slot and position, the order of the
    mix. ``targets`` = (source, weight); unset: damped numbers of documents."""
    keyed = rows.withColumn("key", source_key(F.col("source")))
    counts = keyed.groupBy("key").agg(F.count("*").alias("n"))
    weights = damped(counts) if targets is None else targets.select(source_key(F.col("source")).alias("key"), "weight")
    turns = schedule(shares(counts, weights, slots))
    blocks = _ranked(keyed, rows.count()).withColumn("block", F.expr(f"place div {block}"))
    # at most a round's slots
    turn = blocks.join(F.broadcast(turns.select("key", "share", "slots").distinct()), "key").withColumn(
        "turn", F.expr("block % share")).join(F.broadcast(turns.select("key", "turn", "spot")), ["key", "turn"])
    return turn.withColumn("slot", F.expr("block div share * slots + spot")).withColumn(
        "release", F.expr("block * slots div share")).withColumn(
        "deadline", F.expr("((block + 1) * slots + share - 1) div share")).withColumn(
        "position", F.expr(f"slot * {block} + place % {block}")).drop("key", "share", "slots", "turn", "spot", "place")


def mix(docs: DataFrame, targets: DataFrame | None = None, slots: int = SLOTS, block: int = BLOCK) -> DataFrame:
    """All rows and columns of ``docs`` in the order of the mix."""
    rows = docs.select(F.col("doc_id"), F.col("source"), F.struct("*").alias("row"))
    return interleaved(rows, targets, slots, block).orderBy("position").select("row.*")


_SQL = f"""
WITH RECURSIVE keyed AS (SELECT doc_id, source, coalesce('=' || source, '') AS key FROM documents),
counts AS (SELECT key, floor(sqrt(count(*)) * 1000)::BIGINT AS weight FROM keyed GROUP BY key),
shares AS (SELECT key, greatest(1, floor((weight * {SLOTS} + (SELECT sum(weight) FROM counts) / 2)
    / (SELECT sum(weight) FROM counts))::BIGINT) AS share FROM counts),
l AS (SELECT list(key ORDER BY key) AS ks, list(share ORDER BY key) AS cs, sum(share)::BIGINT AS q, count(*)::BIGINT AS n FROM shares),
s AS (SELECT -1::BIGINT AS t, list_transform(cs, lambda x: 0::BIGINT) AS done, NULL::BIGINT AS pick FROM l
  UNION ALL
  SELECT t, list_transform(done, lambda d, i: CASE WHEN i - 1 = pick THEN d + 1 ELSE d END), pick FROM (
    SELECT t + 1 AS t, done, list_min(list_transform(list_filter(range(n),
        lambda i: done[i + 1] < cs[i + 1] AND (done[i + 1] * q) // cs[i + 1] <= t + 1),
        lambda i: (((done[i + 1] + 1) * q + cs[i + 1] - 1) // cs[i + 1]) * n + i)) % n AS pick
    FROM s, l WHERE t + 1 < q)),
turns AS (SELECT ks[pick + 1] AS key, cs[pick + 1] AS share, q, t AS spot, row_number() OVER (PARTITION BY pick ORDER BY t) - 1 AS turn
  FROM s, l WHERE pick IS NOT NULL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY md5(coalesce(doc_id::VARCHAR, '')), doc_id NULLS FIRST) - 1 AS place FROM keyed),
b AS (SELECT *, place // {BLOCK} AS block FROM ranked)
SELECT doc_id, source, block, block * q // share AS release, ((block + 1) * q + share - 1) // share AS deadline,
  block // share * q + spot AS slot, (block // share * q + spot) * {BLOCK} + place % {BLOCK} AS position
FROM b JOIN shares USING (key) JOIN (SELECT key, spot, turn, q FROM turns) t2 ON b.key = t2.key AND t2.turn = block % share
"""


@query("op10_source_mixing", _SQL)
def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "source")
    return interleaved(rows).select("doc_id", "source", "block", "release", "deadline", "slot", "position")
