"""Array files read in splits give the rows of a reader of whole files."""

import json
import random

import pytest
from pyspark.sql import functions as F

from crestline.sources import arrays, nested

TEXTS = ['plain', 'a "quoted" one', 'brace { in } text', '[{"x": "y"}]', 'back\\slash', 'ends with \\', '\\"{', 'é€😀 {', '',
         'line\nbreak\t}', '\\\\\\" {[', '"areas": [{']


def records(seed, n=60):
    rng = random.Random(seed)

    def text():
        return "".join(rng.choices(TEXTS, k=rng.randint(0, 6)))

    out = []
    for i in range(n):
        routes = [{"route_id": f"r{i}-{k}", "route_name": text(), "route_tags": {text(): [text()]}, "route_comments": [
            {"comment_text": text()} for _ in range(rng.randint(0, 2))]} for k in range(rng.choice([0, 1, 2, 30]))]
        out.append({"area_id": f"a{i}", "area_name": text(), "area_description": text() * rng.choice([1, 40]), "routes": routes})
    return out


def dumped(rows, seed, ascii_only):
    return json.dumps(rows, indent=random.Random(seed).choice([None, None, 2]), ensure_ascii=ascii_only)


def plain(rows):
    """Rows as JSON; raw text of nested values without its white space."""
    out = [r.asDict(True) for r in rows]
    for route in (route for r in out for route in r["routes"]):
        route["route_tags"] = json.loads(route["route_tags"])
    return [json.dumps(r, sort_keys=True) for r in out]


def whole(spark, path):
    df = spark.read.schema(nested._RECORD).option("multiLine", True).option("columnNameOfCorruptRecord", "corrupt").json(path)
    return plain(df.drop("corrupt").collect())


@pytest.mark.parametrize("seed, n, split_bytes", [(1, 4, 90), (2, 20, 900), (3, 60, 20_000)])
def test_rows_of_whole_files(spark, tmp_path, seed, n, split_bytes):
    """Also their order; strings with brackets, quotes and escapes lie across ends of splits."""
    path = str(tmp_path / "areas.json")
    with open(path, "w", encoding="utf-8") as f:
        f.write(dumped(records(seed, n), seed, seed % 2 == 0))
    df = nested.read_nested(spark, path, split_bytes=split_bytes).orderBy("area_pos")
    got = df.drop("corrupt", "file_path", "area_pos").collect()
    assert plain(got) == whole(spark, path)
    assert df.filter("corrupt IS NOT NULL").isEmpty()
    assert len({r[0] for r in df.select("area_pos.block").collect()}) > 1


def test_several_tasks_read_one_file(spark, tmp_path):
    path = str(tmp_path / "areas.json")
    with open(path, "w", encoding="utf-8") as f:
        f.write(dumped(records(3, 300), 3, True))
    text = spark.read.option("lineSep", "{").text(path)
    with arrays._setting(spark, "spark.sql.files.maxPartitionBytes", 10_000):
        assert text.rdd.getNumPartitions() > 4
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    assert nested.read_nested(spark, path, split_bytes=10_000).count() == 300
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") == before


def test_record_larger_than_splits(spark, tmp_path):
    path = str(tmp_path / "areas.json")
    big = {"area_id": "big", "area_description": "{x}\\\"" * 800, "routes": [{"route_id": f"r{i}"} for i in range(60)]}
    with open(path, "w") as f:
        json.dump([{"area_id": "first"}, big, {"area_id": "last"}], f)
    got = nested.read_nested(spark, path, split_bytes=900).orderBy("area_pos").collect()
    assert [r["area_id"] for r in got] == ["first", "big", "last"]
    assert got[1]["area_description"] == big["area_description"] and len(got[1]["routes"]) == 60


def test_shapes_of_files(spark, tmp_path):
    files = {"one": '{"area_id": "o", "routes": [{"route_id": "{"}]}', "none": "[]", "empty": "", "blank": " \n", "broken": '[{"area_id": "x"}, {"area_id"',
             "closed": '[{"area_id": "x"}]]', "text": '"[{}]"', "others": '[1, null, ["a", {"area_id": "no"}], {"area_id": "yes"}, "{"]',
             "bom": '﻿[{"area_id": "b"}]', "bad": '[{"area_id": "g"}, {"area_id": tru}, {"area_id": "h"}]'}
    for name, text in files.items():
        (tmp_path / f"{name}.json").write_text(text, encoding="utf-8")
    name = F.regexp_extract("file_path", r"([a-z]+)\.json$", 1).alias("name")
    for size in (8, 1000):
        df = nested.read_nested(spark, str(tmp_path), split_bytes=size)
        got = sorted((r[0], r[1] or "", r[2]) for r in df.select(name, "area_id", F.col("corrupt").isNotNull()).collect())
        assert got == [("bad", "", True), ("bad", "g", False), ("bad", "h", False), ("bom", "b", False), ("broken", "", True),
                       ("closed", "", True), ("one", "o", False), ("others", "yes", False), ("text", "", True)]


def test_member_of_an_object(spark, tmp_path):
    path = str(tmp_path / "areas.json")
    rows = records(5, 6)
    for doc in ({"meta": {"a": {"areas": [{}]}}, "n": 3, "areas": rows, "more": [{"area_id": "no"}]}, {"areas": rows}):
        with open(path, "w", encoding="utf-8") as f:
            f.write(json.dumps(doc))
        for size in (400, 50_000):
            got = arrays.split_records(spark, path, "areas", size).orderBy("area_pos").collect()
            assert [json.loads(r["value"]) for r in got] == rows
    for doc in ({"other": []}, {"areas": {"x": 1}}, [{"areas": []}], {"areas": None}):
        with open(path, "w", encoding="utf-8") as f:
            f.write(json.dumps(doc))
        if doc != {"areas": {"x": 1}}:
            with pytest.raises(ValueError):
                arrays.split_records(spark, path, "areas")


def test_splits_that_changed(spark, tmp_path):
    """States of other splits are an error, never other rows."""
    path = str(tmp_path / "areas.json")
    with open(path, "w") as f:
        f.write(dumped(records(1), 1, True))
    rows = spark.createDataFrame([("p", 7, "x", None, None, None, None, None)],
                                 "file_path string, block long, value string, in_string long, depth long, owner long, base long, broken boolean")
    with pytest.raises(Exception, match="changed between two passes"):
        rows.mapInArrow(arrays._pieces, arrays._PIECES).collect()


def test_small_splits_share_tasks(spark, tmp_path):
    rows = records(9, 400)
    for i in range(4):
        (tmp_path / f"f{i}.json").write_text(dumped(rows[i::4], i, False), encoding="utf-8")
    seen = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("small-splits", "")
    try:
        got = nested.read_nested(spark, str(tmp_path), split_bytes=512)
        ids = sorted(r["area_id"] for r in got.select("area_id").collect())
        stages = [seen.getStageInfo(s) for j in seen.getJobIdsForGroup("small-splits") for s in seen.getJobInfo(j).stageIds]
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert ids == sorted(r["area_id"] for r in rows)
    splits = sum(-(-f.stat().st_size // 512) for f in tmp_path.glob("*.json"))
    assert splits > 200
    assert max(s.numTasks for s in stages if s) < splits / 4  # small stages of the union and of the join come on top
