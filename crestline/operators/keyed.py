"""First-wins and last-wins rows per key.

Both fold with ``min_by``/``max_by``, which combine map-side: a key that owns a
third of all rows is reduced before the shuffle and never sorted in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _pick(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], chooser) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    order_cols = [F.col(c) if isinstance(c, str) else c for c in order]
    row = F.struct(*rest) if rest else F.struct(F.lit(1).alias("_"))
    picked = df.groupBy(*keys).agg(chooser(row, F.struct(*order_cols)).alias("_row"))
    return picked.select(*[F.col(k) if k in keys else F.col(f"_row.{k}").alias(k) for k in df.columns])


def first_wins(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    return _pick(df, keys, order, F.min_by)


def last_wins(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    return _pick(df, keys, order, F.max_by)


FEW_KEYS = 100_000  # of some hundred bytes; more are not broadcast


def chosen(rows: DataFrame, keys: DataFrame, key: str, how: str, few: int = FEW_KEYS) -> DataFrame:
    """Semi or anti join (``how``) of wide rows with a table of their keys, which is counted: keys that come from
    compressed files or lists are many times as large as the plan says, and would be broadcast by that. Few keys
    are broadcast; for more, rows are dealt out by the key to enough tasks for heavy work on them."""
    spark = rows.sparkSession
    if keys.count() <= few:
        return rows.join(keys.hint("broadcast"), key, how)
    # a number of its own: the rows follow it, and small tasks are not put together again
    tasks = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))) + 1
    return rows.join(keys.repartition(tasks, key).hint("merge"), key, how)
