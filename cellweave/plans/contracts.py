"""Queries on transforms, their contract and the places that they cover. Each part stands for the transform of a field of view."""

from pyspark.sql import functions as F

from cellweave.plans.registry import query
from cellweave.sources import bindings as B
from cellweave.sources import transforms as T

_TRANSFORMS = """transforms AS (SELECT p_partkey AS fov, CASE p_size % 7 WHEN 0 THEN 'tile' WHEN 1 THEN 'full_fov' ELSE 'tile_local' END AS coverage,
  CASE WHEN p_size % 3 > 0 THEN 'displacement' END AS representation, p_size % 5 - 1 AS o, p_size AS s, p_size % 11 AS grid, p_size % 13 AS tile FROM part)"""


def _transforms(spark, sf_dir):
    size = F.col("p_size").cast("int")
    coverage = F.when(size % 7 == 0, "tile").when(size % 7 == 1, "full_fov").otherwise("tile_local")
    three = lambda c: F.array(c, c, c)
    scope = F.struct(coverage.alias("coverage"), three(size % 5 - 1).alias("origin"), three(size).alias("shape"), three(F.lit(50)).alias("full"), F.array(size % 11, F.lit(1)).alias("grid"), (size % 13).alias("tile"))
    semantics = F.struct(F.when(size % 3 > 0, "displacement").alias("representation"), F.lit("unknown").alias("composition"))
    flow = F.lit(None).cast("struct<name string, shape array<int>>")
    return B.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("fov"), F.lit(1).alias("round"), semantics.alias("semantics"), scope.alias("scope"), flow.alias("flow"))


@query(f"""WITH {_TRANSFORMS}, broken AS (SELECT fov, unnest([
  CASE WHEN representation IS NULL THEN 'representation is not displacement' END, CASE WHEN coverage = 'tile' THEN 'coverage' END,
  CASE WHEN o < 0 THEN 'origin below 0' END, CASE WHEN s < 1 THEN 'shape below 1' END, CASE WHEN o + s > 50 THEN 'region ends beyond the volume' END,
  CASE WHEN coverage = 'tile_local' AND grid < 1 THEN 'grid below 1' END, CASE WHEN coverage = 'tile_local' AND tile < 1 THEN 'tile below 1' END,
  CASE WHEN coverage = 'tile_local' AND tile > grid THEN 'tile beyond the grid' END]) AS problem FROM transforms)
SELECT fov, 1 AS round, problem FROM broken WHERE problem IS NOT NULL""")
def broken_transforms(spark, sf_dir):
    """IMG28: every rule that a transform breaks."""
    return T.problems(_transforms(spark, sf_dir), representation="displacement")


@query(f"""WITH {_TRANSFORMS} SELECT l_orderkey, l_linenumber, l_partkey AS fov, coalesce(coverage <> 'tile_local' OR
  (l_linenumber >= o AND l_linenumber < o + s AND l_quantity >= o AND l_quantity < o + s AND l_tax * 100 >= o AND l_tax * 100 < o + s), false) AS covered
FROM lineitem LEFT JOIN transforms ON fov = l_partkey""")
def covered_spots(spark, sf_dir):
    """IMG28: whether each spot lies where its transform is defined."""
    rows = B.table(spark, sf_dir, "lineitem")
    spots = rows.select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("fov"), F.lit(1).alias("round"), F.col("l_linenumber").alias("z"), F.col("l_quantity").alias("y"), (F.col("l_tax") * 100).alias("x"))
    return T.covered(spots, _transforms(spark, sf_dir)).select("l_orderkey", "l_linenumber", "fov", "covered")
