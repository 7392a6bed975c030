"""Exact top-k search by inner product with MaxScore.

Vectors are turned to integers, floor(1024 x). A dimension and a sign are a term: its postings are the
vectors whose component has that sign, its bound for a query is the query's component times the
largest posting of the matching sign. Terms are split so that the bounds of the non-essential ones
together stay below the current k-th score: a vector in no essential posting can't enter. Essential
postings are traversed, then the other dimensions are probed, largest bound first, only for vectors
whose partial score plus the bounds left still reaches the k-th score.

Vectors are dealt into shards and queries into blocks of bounded size; every block meets every shard
once, and the shards' k best per query are merged.

Defined results: vectors that are null or hold a null or non-finite component take no part; a shorter
vector counts as filled up with zeros; rows that repeat an id and vector count once; rows with the
query's own id are no candidates; an id with several vectors asks once for each of them; a null id is
no query and ranks behind all ids among ties (it counts as the largest long, which no id may be).
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crestline.llm.common import query, table

SCALE = 1024
SHARD_ROWS = 8192
BLOCK_QUERIES = 2048
#: Vectors scored in full to set the first threshold, and dimensions probed between two prunings.
SEED_ROWS, PROBE = 256, 8


def integers(vectors: DataFrame) -> DataFrame:
    """(vec_id, v): valid vectors as integers, repeated rows once."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    v = F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE).cast("long"))
    return vectors.filter(F.col("embedding").isNotNull() & ~bad).select(
        F.col("vec_id").cast("long"), v.alias("v")).dropDuplicates(["vec_id", "v"])


class Shard:
    """Postings of one shard: rows in id order, one column per dimension."""

    def __init__(self, ids: np.ndarray, matrix: np.ndarray) -> None:
        order = np.argsort(ids, kind="stable")
        self.ids, self.matrix = ids[order], np.ascontiguousarray(matrix[order])
        self.high, self.low = self.matrix.max(axis=0, initial=0), self.matrix.min(axis=0, initial=0)

    def top(self, own: int, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(row numbers, scores) of the k best rows that don't have the id ``own``."""
        bounds = np.where(q > 0, q * self.high, q * self.low)
        order = np.argsort(-bounds, kind="stable")
        left = np.append(np.cumsum(bounds[order][::-1])[::-1], 0)  # bounds of the terms from here on
        seed = np.flatnonzero(self.ids[:SEED_ROWS] != own)
        scores = self.matrix[seed] @ q
        least = np.partition(scores, -k)[-k] if len(scores) >= k else None
        essential = int(np.argmax(left < least)) if least is not None and least > 0 else 0
        rows = np.flatnonzero(self.ids != own)
        done = 0
        if essential:
            terms = order[:essential]
            hit = ((self.matrix[:, terms] > 0) & (q[terms] > 0)) | ((self.matrix[:, terms] < 0) & (q[terms] < 0))
            rows = rows[hit.any(axis=1)[rows]]
        partial = np.zeros(len(rows), dtype=np.int64)
        while done < len(q):
            dims = order[done:done + PROBE]
            partial += self.matrix[np.ix_(rows, dims)] @ q[dims]
            done += len(dims)
            if least is not None:
                stay = partial + left[done] >= least
                if not stay.all():
                    rows, partial = rows[stay], partial[stay]
        best = np.lexsort((self.ids[rows], -partial))[:k]
        return rows[best], partial[best]


def _matrix(column: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(column), width), dtype=np.int64)
    for i, v in enumerate(column):
        out[i, :len(v)] = v
    return out


_NO_ID = np.iinfo(np.int64).max


def search(vectors: DataFrame, is_query: str, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows for each row of ``vectors`` where the SQL
    condition ``is_query`` holds."""
    rows = integers(vectors).withColumn("vec_id", F.coalesce("vec_id", F.lit(_NO_ID)))
    n, asked = rows.agg(F.count("*"), F.count_if(F.expr(is_query))).first()
    shards, blocks = max(1, math.ceil(n / SHARD_ROWS)), max(1, math.ceil(asked / BLOCK_QUERIES))
    key = F.xxhash64("vec_id", "v")
    all_of = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    cells = rows.select(F.pmod(key, F.lit(shards)).cast("int").alias("shard"), all_of(blocks).alias("block"),
                        "vec_id", "v", key.alias("asked"), F.lit(False).alias("asks")).unionByName(
        rows.filter(is_query).filter(F.col("vec_id") != _NO_ID).select(
            all_of(shards).alias("shard"), F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int").alias("block"),
            "vec_id", "v", key.alias("asked"), F.lit(True).alias("asks")))

    def run(cell: pd.DataFrame) -> pd.DataFrame:
        asks, rest = cell[cell["asks"]], cell[~cell["asks"]]
        out = []
        if len(asks) and len(rest):
            width = max(map(len, cell["v"]))
            shard = Shard(rest["vec_id"].to_numpy(), _matrix(rest["v"], width))
            for own, tag, q in zip(asks["vec_id"], asks["asked"], _matrix(asks["v"], width)):
                found, scores = shard.top(int(own), q, k)
                out.append(pd.DataFrame({"query_id": int(own), "asked": tag, "vec_id": shard.ids[found], "score": scores}))
        return pd.concat(out) if out else pd.DataFrame(
            {c: np.zeros(0, np.int64) for c in ("query_id", "asked", "vec_id", "score")})

    parts = cells.groupBy("shard", "block").applyInPandas(run, "query_id long, asked long, vec_id long, score long")
    order = Window.partitionBy("query_id", "asked").orderBy(F.desc("score"), "vec_id")
    return parts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(
        "query_id", F.col("rank").cast("int"), F.when(F.col("vec_id") != _NO_ID, F.col("vec_id")).alias("vec_id"), "score")


_SQL = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 1024)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM e q JOIN e c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""


@query("op5_topk_search", _SQL)
def op5_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), "vec_id % 100 = 0", 10)
