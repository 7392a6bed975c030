"""Choices as columns against the functions on single values."""

import itertools

from pyspark.sql import functions as F

from crestline import fixed
from crestline.functions import choices, grades
from crestline.operators import hierarchy, sorting
from crestline.sources import nested


def test_choices(spark):
    some = ["5.6", "5.9", "5.10c", "5.12a", "odd", fixed.WEB_GRADES[-1]]
    rows = list(itertools.product(("min", "max"), some, some, some))
    df = spark.createDataFrame(rows, "changed string, value string, low string, high string")
    got = df.select(choices.coupled_range(*map(F.col, df.columns)).alias("r")).collect()
    assert [(r["r"]["low"], r["r"]["high"]) for r in got] == [grades.couple_range(*r) for r in rows]
    rows = list(itertools.product(("a", "b"), ("asc", "desc"), ("a", "b")))
    df = spark.createDataFrame(rows, "key string, direction string, chosen string")
    got = df.select(choices.toggled_sort(*map(F.col, df.columns)).alias("s")).collect()
    assert [tuple(r["s"]) for r in got] == [sorting.toggle((k, d), c) for k, d, c in rows]
    rows = [(["a", "b"], "a"), (["a"], "b"), ([], "x")]
    df = spark.createDataFrame(rows, "selected array<string>, path string")
    got = df.select(choices.toggled_path(F.col("selected"), F.col("path")).alias("p")).collect()
    assert [r["p"] for r in got] == [hierarchy.toggle_selection(s, p) for s, p in rows]
    rows = [("s3a://b/data/", "/x.json"), ("/data", "x.json"), ("/data", "s3a://b/x.json")]
    df = spark.createDataFrame(rows, "base string, name string")
    got = df.select(choices.located(F.col("base"), F.col("name")).alias("p")).collect()
    assert [r["p"] for r in got] == [nested.location(b, n) for b, n in rows]
