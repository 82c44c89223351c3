"""Queries on cells made from reads."""

from pyspark.sql import functions as F

from cellweave.operators import segment
from cellweave.plans.registry import query
from cellweave.sources import bindings as B
from cellweave.sources.shared import materialised

RADIUS, REACH, FLATTEN, LEAST = 150.0, 400.0, 2.0, 4

_APART = f"sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z * {FLATTEN} - b.z * {FLATTEN}) * (a.z * {FLATTEN} - b.z * {FLATTEN}))"
#: Everything by read, without heaps or rings: reads within the radius, their genes, cosines in millionths.
_COMPOSITION = f"""WITH RECURSIVE {B.SPOTS},
near AS MATERIALIZED (SELECT a.read AS a, b.read AS b, b.gene FROM spots a JOIN spots b ON a.section = b.section AND {_APART} <= {RADIUS}),
comp AS MATERIALIZED (SELECT a AS read, gene, count(*) AS n FROM near GROUP BY 1, 2)"""
_DENSITY = f"""{_COMPOSITION}, norms AS (SELECT read, sum(n * n)::BIGINT AS norm FROM comp GROUP BY 1),
dense AS MATERIALIZED (SELECT a AS read, sum(floor(1000000.0::DOUBLE * dot / sqrt(na.norm::DOUBLE * nb.norm::DOUBLE)))::BIGINT AS density FROM
  (SELECT near.a, near.b, sum(ca.n * cb.n)::BIGINT AS dot FROM near JOIN comp ca ON ca.read = near.a JOIN comp cb ON cb.read = near.b AND cb.gene = ca.gene GROUP BY 1, 2)
  JOIN norms na ON na.read = a JOIN norms nb ON nb.read = b GROUP BY 1)"""
_POINTER = f"""{_DENSITY}, reps AS (SELECT section, x, y, z, min(read) AS read FROM spots GROUP BY ALL),
cand AS MATERIALIZED (SELECT a.read AS a, b.read AS b, {_APART} AS apart FROM reps a JOIN reps b ON a.section = b.section AND {_APART} <= {REACH}
  JOIN dense da ON da.read = a.read JOIN dense db ON db.read = b.read WHERE db.density > da.density OR (db.density = da.density AND b.read < a.read)),
dots AS (SELECT cand.a, cand.b, sum(ca.n * cb.n)::BIGINT AS dot FROM cand JOIN comp ca ON ca.read = cand.a JOIN comp cb ON cb.read = cand.b AND cb.gene = ca.gene GROUP BY 1, 2),
gaps AS (SELECT cand.a, cand.b, apart * (1.0::DOUBLE + (1.0::DOUBLE - floor(1000000.0::DOUBLE * coalesce(dot, 0) / sqrt(na.norm::DOUBLE * nb.norm::DOUBLE)) / 1000000.0::DOUBLE)) AS gap
  FROM cand LEFT JOIN dots ON dots.a = cand.a AND dots.b = cand.b JOIN norms na ON na.read = cand.a JOIN norms nb ON nb.read = cand.b),
best AS (SELECT a, b, gap FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY gap, b) AS k FROM gaps WHERE gap <= {REACH}) WHERE k = 1),
pointer AS MATERIALIZED (SELECT reps.read AS place, best.b AS parent, best.gap FROM reps LEFT JOIN best ON best.a = reps.read)"""
_CELL = f"""{_POINTER}, chain AS (SELECT place, place AS root FROM pointer WHERE parent IS NULL
  UNION ALL SELECT p.place, c.root FROM pointer p JOIN chain c ON p.parent = c.place),
member AS MATERIALIZED (SELECT s.*, c.root FROM spots s JOIN reps ON reps.section = s.section AND reps.x = s.x AND reps.y = s.y AND reps.z = s.z JOIN chain c ON c.place = reps.read),
cell AS MATERIALIZED (SELECT root, count(*) AS reads, floor(avg(x))::BIGINT AS cx, floor(avg(y))::BIGINT AS cy, floor(avg(z))::BIGINT AS cz FROM member GROUP BY 1 HAVING count(*) >= {LEAST})"""


@query(f"{_COMPOSITION} SELECT read, gene, n FROM comp")
def neighbourhood_compositions(spark, sf_dir):
    """MDL16: genes of the reads around each read."""
    return segment.compositions(segment.usable(B.spots(spark, sf_dir), FLATTEN), RADIUS)


def _dense(spark, sf_dir):
    reads = materialised(segment.usable(B.spots(spark, sf_dir), FLATTEN))
    return reads, segment.densities(materialised(segment.profiles(reads, RADIUS)), RADIUS)


@query(f"{_DENSITY} SELECT read, density FROM dense")
def read_densities(spark, sf_dir):
    """MDL16: reads around each read, weighted by the cosine of their neighbourhoods."""
    reads, places = _dense(spark, sf_dir)
    return places.join(reads, ["section", "x", "y", "z"]).select("read", "density")


@query(f"{_POINTER} SELECT place, parent, round(gap, 6) AS gap FROM pointer")
def denser_reads(spark, sf_dir):
    """MDL16: the nearest denser place of each place, by growing rings."""
    reads, places = _dense(spark, sf_dir)
    names = reads.groupBy("section", "x", "y", "z").agg(F.min("read").alias("place"))
    table = materialised(places.join(names, ["section", "x", "y", "z"]))
    return segment.denser(table, RADIUS, REACH).select("place", "parent", F.round("gap", 6).alias("gap"))


@query(f"""{_CELL} SELECT read, coalesce(cell.root, -1) AS cell, coalesce(reads, 0) AS reads, coalesce(cx, -1) AS cx, coalesce(cy, -1) AS cy, coalesce(cz, -1) AS cz
FROM member LEFT JOIN cell USING (root)""")
def segmented_reads(spark, sf_dir):
    """MDL16: the cell of each read, with its centre."""
    reads = B.spots(spark, sf_dir)
    cells = materialised(segment.segmented(reads, RADIUS, REACH, FLATTEN, least_reads=LEAST))
    return segment.cell_centres(reads, cells)
