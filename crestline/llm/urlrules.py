"""URL filters: a sort-merge range join of reversed-host keys with prefix rules.

A rule is (host, path, verdict): it fits its host and every subdomain where the path starts with the
rule's. A host becomes its labels in reverse, each followed by a dot (``www.example.com`` ->
``com.example.www.``), so a rule's hosts are one interval of the sorted keys and intervals either nest
or lie apart. URLs and rules are sorted together by key; one sweep keeps the stack of rules whose
interval is open and takes the longest (host and path together) that fits the path.

A host with a large share of all rows is cut by path and id as well: the ranges are those of (key,
path, page_id), and a rule goes to each range that its interval meets.

Defined results: a null url, or one without ``://``, has an empty host and path; only a rule with an
empty host can fit it. Of rules with the same host and path the blocking one counts. Rules with a
null host or path fit nothing. Null page ids are kept. Repeated rows are judged one by one.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crestline.llm.common import query, table, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
         ("net", "/es/", "block"), ("net", "/fr/", "block"))
DEFAULT = "allow"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: Column) -> Column:
    """Reversed labels, each with a dot behind it; no label holds a dot, so keys are unambiguous."""
    return F.when(host == "", F.lit("")).otherwise(
        F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit(".")))


class Sweep:
    """The stack of open intervals while keys come in order."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, int, dict[str, str], list[int]]] = []

    def advance(self, key: str) -> None:
        while self.stack and not key.startswith(self.stack[-1][0]):
            self.stack.pop()

    def open(self, key: str, host: str, path: str, verdict: str) -> None:
        self.advance(key)
        if not self.stack or self.stack[-1][0] != key:
            self.stack.append((key, host, {}, []))
        _, _, verdicts, lengths = self.stack[-1]
        if verdicts.get(path) != "block":
            verdicts[path] = verdict
        at = bisect_left(lengths, len(path))
        if at == len(lengths) or lengths[at] != len(path):
            lengths.insert(at, len(path))

    def longest(self, key: str, path: str) -> tuple[str, str] | None:
        """(rule, verdict) of the longest open rule that fits the path."""
        self.advance(key)
        best, size = None, -1
        for _, host, verdicts, lengths in self.stack:
            for n in reversed(lengths):
                if n <= len(path) and path[:n] in verdicts:
                    if len(host) + n >= size:
                        best, size = (host + path[:n], verdicts[path[:n]]), len(host) + n
                    break
        return best


_OUT = pa.schema([("page_id", pa.int64()), ("host", pa.string()), ("path", pa.string()),
                  ("rule", pa.string()), ("verdict", pa.string())])


def judge(pages: DataFrame, rules: DataFrame, default: str = DEFAULT) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row; ``rules`` = (host, path, verdict)."""
    urls = pages.select(F.col("page_id").cast("long"), host_of(F.col("url")).alias("host"),
                        path_of(F.col("url")).alias("path"))
    urls = urls.withColumn("key", host_key(F.col("host")))
    ranged = written(urls.repartitionByRange("key", "path", "page_id").withColumn("part", F.spark_partition_id()),
                     "urls")
    # two keys per range: bounded by the number of partitions, not by rows or hosts
    bounds = ranged.groupBy("part").agg(F.min("key").alias("lo"), F.max("key").alias("hi"))
    limits = F.array(*[F.struct(F.lit(r["part"]).alias("part"), F.lit(r["lo"]).alias("lo"), F.lit(r["hi"]).alias("hi"))
                       for r in bounds.collect()]).cast("array<struct<part:int,lo:string,hi:string>>")
    host = F.translate("host", UPPER, LOWER)
    keyed = rules.filter("host IS NOT NULL AND path IS NOT NULL").select(
        host_key(host).alias("key"), host.alias("host"), "path", "verdict").distinct()

    def meets(b: Column) -> Column:  # the interval [key, every key that starts with it] and the range [lo, hi]
        return (b["hi"] >= F.col("key")) & ((b["lo"] <= F.col("key")) | F.startswith(b["lo"], F.col("key")))

    placed = keyed.select("key", "host", "path", "verdict", F.explode(F.filter(limits, meets)).alias("b"))
    events = ranged.select("part", "key", F.lit(1).alias("kind"), "page_id", "host", "path",
                           F.lit(None).cast("string").alias("verdict")).unionByName(
        placed.select(F.col("b.part").alias("part"), "key", F.lit(0).alias("kind"),
                      F.lit(None).cast("long").alias("page_id"), "host", "path", "verdict"))
    ordered = events.repartition("part").sortWithinPartitions("part", "key", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, sweep = None, Sweep()
        for batch in batches:
            out = []
            for p, key, kind, page_id, host, path, verdict in zip(*(c.to_pylist() for c in batch.columns)):
                if p != part:
                    part, sweep = p, Sweep()
                if kind == 0:
                    sweep.open(key, host, path, verdict)
                else:
                    out.append((page_id, host, path, *(sweep.longest(key, path) or (None, default))))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _OUT)], schema=_OUT)

    return ordered.mapInArrow(run, "page_id long, host string, path string, rule string, verdict string")


_SQL = r"""
WITH u AS (SELECT page_id,
  translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''),
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
r(rhost, rpath, rverdict) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'),
  ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
hits AS (SELECT u.*, rhost || rpath AS rule, rverdict, row_number() OVER (
    PARTITION BY page_id ORDER BY length(rhost || rpath) DESC NULLS LAST) AS rn
  FROM u LEFT JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT page_id, host, path, rule, coalesce(rverdict, 'allow') AS verdict FROM hits WHERE rn = 1
"""


@query("op7_url_rules", _SQL)
def op7_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(list(RULES), "host string, path string, verdict string")
    return judge(table(spark, sf_dir, "pages"), rules)
