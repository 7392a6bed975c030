"""Nested trees against plain recursion."""

import json

import pytest
from test_intervals import frame, tree

from crestline.operators import nesting


def plain(rows, at):
    children = sorted(((n or "", i) for i, n, p in rows if p == at))
    names = {i: n for i, n, _ in rows}
    return [{"area_id": i, "area_name": names[i], "children": plain(rows, i)} for _, i in children]


@pytest.mark.parametrize("per_part", [1, 7, 40, 1000])
def test_parts_make_up_the_tree(spark, per_part):
    rows = tree(5, 120)
    got = nesting.nested_roots(frame(spark, rows).repartition(4), per_part).collect()
    parts = {}
    for r in sorted(got, key=lambda r: r["part"]):
        assert r["n_areas"] < 2 * per_part + 120 * any(c["area_id"] in {g["area_id"] for g in got} for c in json.loads(r["children"]))
        parts.setdefault(r["area_id"], []).extend(json.loads(r["children"]))

    def joined(children):
        return [{**c, "children": joined(parts[c["area_id"]]) if c["area_id"] in parts else joined(c["children"])} for c in children]

    roots = [i for i, _, p in rows if p is None]
    assert {i: joined(parts[i]) for i in roots} == {i: plain(rows, i) for i in roots}
    if per_part == 1000:
        assert sorted(parts) == roots and all(r["part"] == 0 for r in got)


def test_wide_node_in_parts(spark):
    rows = [("root", "R", None)] + [(f"c{n:05}", "x", "root") for n in range(5000)]
    got = nesting.nested_roots(frame(spark, rows), 500).collect()
    assert sorted(r["part"] for r in got) == list(range(10)) and {r["n_areas"] for r in got} == {500}
    assert nesting.nested_roots(frame(spark, [])).collect() == []
