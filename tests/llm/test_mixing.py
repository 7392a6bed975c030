from collections import Counter

import pytest
from llm_tables import documents
from pyspark.sql import functions as F

from crestline.llm import mixing


def mixed(spark, rows, **options):
    return sorted((r.asDict() for r in mixing.interleaved(documents(spark, rows), **options).collect()), key=lambda r: r["position"])


def skewed(n):
    return [(i, "t", "hot" if i % 3 == 0 else f"s{i % 11}") for i in range(n)]


def test_windows_and_deviation(spark):
    rows = mixed(spark, skewed(3000), slots=50, block=4)
    assert len(rows) == 3000 and len({r["position"] for r in rows}) == 3000
    assert all(r["release"] <= r["slot"] < r["deadline"] for r in rows)
    blocks = {(r["slot"], r["source"]) for r in rows}
    assert len(blocks) == len({s for s, _ in blocks})  # one source a slot
    last = min(max(r["slot"] for r in rows if r["source"] == s) for s in {r["source"] for r in rows})
    counts = documents(spark, skewed(3000)).groupBy(mixing.source_key(F.col("source")).alias("key")).agg(F.count("*").alias("n"))
    share = {r["key"][1:]: r["share"] for r in mixing.shares(counts, mixing.damped(counts), 50).collect()}
    slots = sum(share.values())
    assert last > slots and share["hot"] == max(share.values())
    done = Counter()
    for t in range(last):
        done.update(s for at, s in blocks if at == t)
        assert all(abs(done[s] - n * (t + 1) / slots) < 1 for s, n in share.items())


def test_targets(spark):
    targets = spark.createDataFrame([("hot", 1.0), ("s1", 8.0), ("gone", 5.0), ("s2", None), ("s3", -1.0)], "source string, weight double")
    rows = mixed(spark, skewed(2000), targets=targets, slots=9, block=2)
    # 8 and 1 slots of the two targets, one each of the ten sources without; no source runs out in one round
    first = Counter(r["source"] for r in rows if r["slot"] < 19)
    assert first["s1"] == 8 * first["hot"] and first["s2"] == first["s3"] == 2


def test_nulls_ties_and_repeats(spark):
    rows = mixed(spark, [(1, None, None), (1, None, None), (None, "", ""), (None, "x", "a"), (2, "y", "=a")], block=1)
    assert sorted(Counter((r["doc_id"], r["source"]) for r in rows).values()) == [1, 1, 1, 2]
    assert len({r["position"] for r in rows}) == 5


@pytest.mark.parametrize("rows", [[], [(1, "t", "only")]])
def test_small(spark, rows):
    assert len(mixed(spark, rows)) == len(rows)


def test_parts_do_not_change_the_order(spark, monkeypatch):
    rows = skewed(500)
    want = mixed(spark, rows)
    monkeypatch.setattr(mixing, "PART_ROWS", 1)
    assert mixed(spark, rows) == want


def test_stage_keeps_rows_and_columns(spark):
    df = documents(spark, skewed(300))
    out = mixing.mix(df)
    assert out.columns == df.columns
    assert [r["doc_id"] for r in out.collect()] == [r["doc_id"] for r in mixed(spark, skewed(300))]


def test_no_python(spark):
    plan = mixing.mix(documents(spark, skewed(10)).withColumn("x", F.lit(1)))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
