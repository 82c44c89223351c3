"""Tables of transforms, one row for each field of view and round, their contract, and the flow fields that they refer to.

transforms(fov, round, semantics struct<representation, composition>, scope struct<coverage, origin, shape, full, grid, tile>,
flow struct<name, shape>); origin, shape and full are arrays (z, y, x), grid is (y, x), tile counts from 1. Without a
scope a transform covers its whole field of view; without semantics both are "unknown"; without a flow it is a shift only.
flows(name, block, values) holds the blocks of the flow fields, and is read only by with_flows().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How far a transform reaches. Fixed values of the table's format.
COVERAGE = ("full_fov", "tile_local")
UNKNOWN = "unknown"


def _ints(name: str, length: int, least: int) -> tuple[Column, Column]:
    """(name holds `length` numbers, and each is at least `least`); neither is null."""
    value = F.col(f"scope.{name}")
    whole = F.coalesce((F.size(value) == length) & F.forall(value, lambda v: v.isNotNull()), F.lit(False))
    return whole, F.coalesce(F.forall(value, lambda v: v >= least), F.lit(True))


def _rules(expected: dict[str, str]) -> list[tuple[Column, str]]:
    """(condition that must hold, the problem where it does not), in the order of report."""
    scoped = F.col("scope").isNotNull()
    tiled = scoped & F.coalesce(F.col("scope.coverage") == COVERAGE[1], F.lit(False))
    rules = [(F.coalesce(F.col(f"semantics.{axis}"), F.lit(UNKNOWN)) == want, f"{axis} is not {want}") for axis, want in expected.items()]
    rules.append((~scoped | F.coalesce(F.col("scope.coverage").isin(*COVERAGE), F.lit(False)), "coverage"))
    whole = F.lit(True)
    for name, least in (("origin", 0), ("shape", 1), ("full", 1)):
        three, enough = _ints(name, 3, least)
        whole = whole & three
        rules += [(~scoped | three, f"{name} is not three numbers"), (~scoped | enough, f"{name} below {least}")]
    ends = F.zip_with(F.zip_with("scope.origin", "scope.shape", lambda o, s: o + s), "scope.full", lambda e, f: e <= f)
    rules.append((~scoped | ~whole | F.coalesce(F.forall(ends, lambda ok: ok), F.lit(True)), "region ends beyond the volume"))
    two, enough = _ints("grid", 2, 1)
    rules += [(~tiled | two, "grid is not two numbers"), (~tiled | enough, "grid below 1"), (~tiled | F.coalesce(F.col("scope.tile") >= 1, F.lit(False)), "tile below 1")]
    last = F.try_element_at("scope.grid", F.lit(1)) * F.try_element_at("scope.grid", F.lit(2))
    rules.append((~tiled | F.coalesce(F.col("scope.tile") <= last, F.lit(True)), "tile beyond the grid"))
    flow = F.col("flow").isNotNull()
    rules.append((~flow | F.coalesce(F.length("flow.name") > 0, F.lit(False)) & ~F.coalesce(F.contains("flow.name", F.lit("/")), F.lit(False)), "flow without a plain name"))
    rules.append((~flow | F.col("flow.shape").isNull() | (F.size("flow.shape") == 4), "flow is not four-dimensional"))
    return rules


def _expected(representation: str | None, composition: str | None) -> dict[str, str]:
    return {k: v for k, v in (("representation", representation), ("composition", composition)) if v is not None}


def problems(transforms: DataFrame, representation: str | None = None, composition: str | None = None) -> DataFrame:
    """IMG28: (fov, round, problem), one row for each rule of the contract that a transform breaks; none where all is well.

    With a representation or composition, transforms of another, or of an unknown one, break the contract too. A
    projection of one pass: no shuffle.
    """
    found = F.array(*[F.when(~ok, F.lit(text)) for ok, text in _rules(_expected(representation, composition))])
    return transforms.select("fov", "round", F.explode(F.array_compact(found)).alias("problem"))


def checked(transforms: DataFrame, representation: str | None = None, composition: str | None = None) -> DataFrame:
    """IMG28: the transforms as they are; reading one that breaks the contract raises with its first problem."""
    first = F.coalesce(*[F.when(~ok, F.lit(text)) for ok, text in _rules(_expected(representation, composition))])
    message = F.concat(F.lit("transform of "), F.concat_ws("/", "fov", "round"), F.lit(": "), first)
    # the check is part of a column that every reader needs, so it is not pruned away
    return transforms.withColumn("round", F.when(first.isNull(), F.col("round")).otherwise(F.raise_error(message).cast(transforms.schema["round"].dataType)))


def with_flows(transforms: DataFrame, flows: DataFrame) -> DataFrame:
    """SRC15: (fov, round, block, values) of the transforms that refer to a flow field; one that is not there raises.

    Only here are flow blocks read: a filter of transforms reaches the join's side, and columns that nobody asks for are
    not read. Shifts without a flow give no rows.
    """
    wanted = transforms.where("flow is not null").select("fov", "round", F.col("flow.name").alias("name"))
    met = wanted.join(flows.select("name", "block", "values"), "name", "left")
    missing = F.raise_error(F.concat(F.lit("no flow field "), F.col("name")))
    block = F.when(F.col("block").isNotNull(), F.col("block")).otherwise(missing.cast(flows.schema["block"].dataType))
    return met.select("fov", "round", block.alias("block"), "values")


def covered(spots: DataFrame, transforms: DataFrame) -> DataFrame:
    """IMG28: spots (fov, round, z, y, x, ...) with `covered`: whether their transform's region holds them, both ends counting
    as in an array's slice. Outside a tile's region a field says nothing, and nothing is made up for it.

    A transform without a scope, or of the full field, covers all places; a spot without a transform or with a null place none.
    """
    region = transforms.select("fov", "round", F.col("scope").alias("_scope"), F.lit(True).alias("_given"))
    met = spots.join(region, ["fov", "round"], "left")
    inside = F.lit(True)
    for k, c in enumerate(("z", "y", "x")):
        inside = inside & (F.col(c) >= F.col("_scope.origin")[k]) & (F.col(c) < F.col("_scope.origin")[k] + F.col("_scope.shape")[k])
    placed = F.col("z").isNotNull() & F.col("y").isNotNull() & F.col("x").isNotNull() & F.col("_given").isNotNull()
    local = F.coalesce(F.col("_scope.coverage") == COVERAGE[1], F.lit(False))
    return met.withColumn("covered", placed & (~local | F.coalesce(inside, F.lit(False)))).drop("_scope", "_given")
