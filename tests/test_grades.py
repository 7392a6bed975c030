import pytest
from pyspark.sql import functions as F

from crestline import fixed
from crestline.functions import grades

# input, tuple, migrate index, web form, web rank, sub form, sub rank
PINNED = [
    ("5.3", (3, 1, 0), 0, "5.3", 9, "5.3", 0),
    ("5.9", (9, 1, 0), 13, "5.9", 22, "5.9", 13),
    ("5.9+", (9, 2, 0), 14, "5.9", 22, "5.9", 13),
    ("5.10", (10, 1, 0), 18, "5.10b", 28, "5.10a", 16),
    ("5.10-", (10, 0, 0), 15, "5.10a", 25, "5.10a", 16),
    ("5.10a/b", (10, 1, 1), 17, "5.10a", 25, "5.10a", 16),
    ("5.10a PG13", (10, 1, 1), 16, "5.10a PG13", -1, "5.10a", 16),
    ("5.5-", (5, 0, 0), 2, "5.5a", -1, "5.5", 2),
    ("5.16a", (16, 1, 1), 76, "5.16a", 85, "5.1", 15),
    ("5.2", (2, 1, 0), 0, "5.2", 8, "5.2", 0),
    ("V4", (999, 999, 999), 0, "V4", -1, "5.0", 0),
    ("", (999, 999, 999), 0, "", -1, "5.0", 0),
    (None, (999, 999, 999), 0, "", -1, "5.0", 0),
    ("5.10A", (10, 1, 0), 16, "5.10A", -1, "5.10a", 16),
    ("5.6a", (6, 1, 1), 0, "5.6a", -1, "5.6", 4),
    ("5.9+a", (9, 2, 1), 13, "5.9+a", -1, "5.9", 13),
    ("5.10a+", (10, 1, 1), 16, "5.10ad", -1, "5.10a", 16),
]


def test_scale_sizes():
    assert len(fixed.FLATTEN_GRADES) == 85
    assert len(fixed.WEB_GRADES) == 94
    assert len(fixed.WEB_PICKER_GRADES) == 35
    assert len(fixed.STORE_PICKER_GRADES) == 31
    assert sum(len(t) for t in fixed.TAG_VOCABULARY.values()) == 54


def test_pinned(spark):
    df = spark.createDataFrame([(i, p[0]) for i, p in enumerate(PINNED)], "i int, g string")
    g = F.col("g")
    rows = df.select(
        "i", grades.grade_tuple(g).alias("t"), grades.grade_migrate(g).alias("m"), grades.grade_web(g).alias("w"),
        grades.grade_web_rank(g).alias("wr"), grades.grade_sub(g).alias("s"), grades.grade_sub_rank(g).alias("sr"),
        grades.head_key(grades.grade_head(g)).alias("key")).orderBy("i").collect()
    for (text, tup, ix, web, web_rank, sub, sub_rank), r in zip(PINNED, rows):
        assert (tuple(r["t"]), r["m"]["index"], r["w"], r["wr"], r["s"], r["sr"]) == (
            tup, ix, web, web_rank, sub, sub_rank), text
    # the single number orders like the tuple
    by_tuple = [r["i"] for r in sorted(rows, key=lambda r: (tuple(r["t"]), r["i"]))]
    assert by_tuple == [r["i"] for r in sorted(rows, key=lambda r: (r["key"], r["i"]))]


def test_migrate_normal_form(spark):
    df = spark.createDataFrame([("5.10A/B",), ("5.10a PG13",), (" 5.9",), ("5.9x",)], "g string")
    got = [r[0] for r in df.select(grades.grade_migrate(F.col("g"))["normalized"]).collect()]
    assert got == ["5.10a", "5.10a", "", "5.9x"]


@pytest.mark.parametrize("changed,value,low,high,want", [
    ("min", "5.12a", "5.10a", "5.11a", ("5.12a", "5.12a")),
    ("min", "5.9", "5.10a", "5.11a", ("5.9", "5.11a")),
    ("max", "5.9", "5.10a", "5.11a", ("5.9", "5.9")),
    ("max", "5.13a", "5.10a", "5.11a", ("5.10a", "5.13a")),
])
def test_range_coupling(changed, value, low, high, want):
    assert grades.couple_range(changed, value, low, high) == want
