"""The contract of transforms, flow fields that are read on demand, and what a transform covers."""

import pytest

from cellweave.sources import transforms as T

SCHEMA = """fov long, round int, semantics struct<representation string, composition string>,
scope struct<coverage string, origin array<int>, shape array<int>, full array<int>, grid array<int>, tile int>, flow struct<name string, shape array<int>>"""
GOOD = ("tile_local", [0, 8, 8], [2, 8, 8], [2, 16, 16], [2, 2], 4)
ROWS = [
    (1, 1, None, None, None), (2, 1, ("displacement", "composed"), GOOD, ("a", [3, 2, 8, 8])), (3, 1, None, ("tile", *GOOD[1:]), None),
    (4, 1, None, ("full_fov", [0, 0], [2, 16, 16], None, None, None), None), (5, 1, None, ("tile_local", [0, 9, 8], *GOOD[2:5], 5), ("x/y", [1])),
    (6, 1, None, ("tile_local", *GOOD[1:4], None, None), ("", None)), (7, 1, None, ("full_fov", [0, -1, 0], [0, 16, 16], [2, 16, 16], None, None), None),
]


def test_each_rule_is_reported(spark):
    got = {}
    for r in T.problems(spark.createDataFrame(ROWS, SCHEMA)).collect():
        got.setdefault(r.fov, []).append(r.problem)
    assert got == {
        3: ["coverage"], 4: ["origin is not three numbers", "full is not three numbers"], 5: ["region ends beyond the volume", "tile beyond the grid", "flow without a plain name", "flow is not four-dimensional"],
        6: ["grid is not two numbers", "tile below 1", "flow without a plain name"], 7: ["origin below 0", "shape below 1"],
    }
    asked = T.problems(spark.createDataFrame(ROWS[:2], SCHEMA), "displacement", "single").collect()
    assert [(r.fov, r.problem) for r in asked] == [(1, "representation is not displacement"), (1, "composition is not single"), (2, "composition is not single")]
    assert T.problems(spark.createDataFrame([], SCHEMA)).count() == 0


def test_a_broken_transform_raises_when_read(spark):
    frame = spark.createDataFrame(ROWS, SCHEMA)
    assert [r["round"] for r in T.checked(frame.where("fov <= 2")).collect()] == [1, 1]
    with pytest.raises(Exception, match="transform of 5/1: region ends"):
        T.checked(frame.where("fov = 5")).select("fov", "round").collect()


def test_flows_are_joined_where_they_are_referred_to(spark):
    frame = spark.createDataFrame(ROWS, SCHEMA)
    flows = spark.createDataFrame([("a", 0, [1.0]), ("a", 1, [2.0]), ("b", 0, [3.0])], "name string, block int, values array<double>")
    assert sorted((r.fov, r.block, r["values"]) for r in T.with_flows(frame.where("fov <= 4"), flows).collect()) == [(2, 0, [1.0]), (2, 1, [2.0])]
    with pytest.raises(Exception, match="no flow field x/y"):
        T.with_flows(frame, flows).collect()


def test_places_outside_a_tile_are_not_covered(spark):
    spots = spark.createDataFrame([(2, 1, 0, 8, 15), (2, 1, 0, 7, 15), (2, 1, 1, 8, 16), (1, 1, 99, 0, 0), (1, 2, 0, 0, 0), (2, 1, None, 8, 8)], "fov long, round int, z int, y int, x int")
    got = {(r.fov, r["round"], r.z, r.y, r.x): r.covered for r in T.covered(spots, spark.createDataFrame(ROWS, SCHEMA)).collect()}
    assert got == {(2, 1, 0, 8, 15): True, (2, 1, 0, 7, 15): False, (2, 1, 1, 8, 16): False, (1, 1, 99, 0, 0): True, (1, 2, 0, 0, 0): False, (2, 1, None, 8, 8): False}
