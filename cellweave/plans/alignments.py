"""Queries on aligned tables and graphs."""

from pyspark.sql import functions as F

from cellweave.operators import alignment as A
from cellweave.plans.geometry import KNN, kernel_edges, knn
from cellweave.plans.registry import query
from cellweave.sources import bindings as B


def r(c, n=6):
    return F.round(c, n).alias(c)


@query(f"WITH {B.EXPR}, a AS (SELECT * FROM expr WHERE cell % 3 <> 0 AND gene < 50), b AS (SELECT * FROM expr WHERE cell % 5 <> 0 AND gene >= 10) SELECT cell, gene, round(value, 4) AS value FROM a WHERE cell IN (SELECT cell FROM b) AND gene IN (SELECT gene FROM b)")
def aligned_matrices(spark, sf_dir):
    """JON22: a matrix cut to the cells and genes that another one has as well."""
    expr = B.expression(spark, sf_dir)
    first, _ = A.aligned([expr.where("cell % 3 <> 0 and gene < 50"), expr.where("cell % 5 <> 0 and gene >= 10")])
    return first.select("cell", "gene", r("value", 4))


@query("SELECT e.event_id, e.value, f.user_id FROM events e JOIN events f ON f.event_id = e.event_id")
def rows_by_key(spark, sf_dir):
    """JON16: the halves of a table are joined by an explicit key, never by position."""
    events = B.table(spark, sf_dir, "events")
    return A.joined_by_position(events.select("event_id", "value"), events.select("event_id", "user_id"), "event_id")


_W = f"{KNN}, sig AS (SELECT src AS cell, distance AS sigma FROM knn WHERE rank = 10), w AS (SELECT knn.src, knn.dst, exp(-distance * distance / (a.sigma * b.sigma)) AS weight FROM knn JOIN sig a ON a.cell = knn.src JOIN sig b ON b.cell = knn.dst)"


@query(f"WITH {_W}, e AS (SELECT src, dst FROM knn WHERE rank <= 4) SELECT e.src, e.dst, round(greatest(coalesce(a.weight, 0), coalesce(b.weight, 0)), 6) AS other_weight FROM e LEFT JOIN (SELECT * FROM w WHERE src % 2 = 0) a ON a.src = e.src AND a.dst = e.dst LEFT JOIN (SELECT * FROM w WHERE src % 2 = 0) b ON b.src = e.dst AND b.dst = e.src")
def looked_up_weights(spark, sf_dir):
    """JON19: the weight that another graph gives to each edge, in either direction."""
    edges = knn(spark, sf_dir).where("rank <= 4").select("src", "dst")
    return A.edge_weights(edges, kernel_edges(spark, sf_dir).where("src % 2 = 0")).select("src", "dst", r("other_weight"))


@query(f"WITH {KNN}, j AS (SELECT a.src, b.src AS dst, count(*) / (20.0::DOUBLE - count(*)) AS jaccard FROM knn a JOIN knn b ON a.dst = b.dst AND a.src <> b.src GROUP BY 1, 2), k AS (SELECT knn.src, distance, row_number() OVER (PARTITION BY knn.src ORDER BY round(jaccard, 9) DESC, knn.dst) AS k FROM knn JOIN j ON j.src = knn.src AND j.dst = knn.dst) SELECT src AS cell, round(avg(distance), 6) AS sigma FROM k WHERE k <= 3 GROUP BY src")
def jaccard_bandwidths(spark, sf_dir):
    """GRF02: bandwidth over the three neighbours that share most neighbours."""
    return A.jaccard_bandwidth(knn(spark, sf_dir).select("src", "dst", "distance"), 3).select("cell", r("sigma"))


@query(f"WITH {KNN}, a AS (SELECT src, dst FROM knn WHERE rank = 1), b AS (SELECT src, dst FROM knn WHERE rank = 2 AND src % 3 <> 0), na AS (SELECT src AS cell FROM a UNION SELECT dst FROM a), nb AS (SELECT src AS cell FROM b UNION SELECT dst FROM b) SELECT cell, 'second' AS missing_in FROM na WHERE cell NOT IN (SELECT cell FROM nb) UNION ALL SELECT cell, 'first' FROM nb WHERE cell NOT IN (SELECT cell FROM na)")
def inconsistent_graphs(spark, sf_dir):
    """GRF30, JON07: cells that only one of two graphs has."""
    edges = knn(spark, sf_dir)
    return A.inconsistent_cells(edges.where("rank = 1").select("src", "dst"), edges.where("rank = 2 and src % 3 <> 0").select("src", "dst"))


@query(f"""WITH {B.CELLS}, s AS (SELECT fov, count(*) AS n FROM cells GROUP BY fov), p AS (SELECT a.fov AS grp, a.cell AS src, b.cell AS dst, n, row_number() OVER (PARTITION BY a.cell ORDER BY sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)), b.cell) AS k
  FROM cells a JOIN cells b ON b.fov = a.fov AND b.cell <> a.cell JOIN s ON s.fov = a.fov)
SELECT grp, least(src, dst) AS a, greatest(src, dst) AS b, count(*) AS weight FROM p WHERE n <= 60 OR k <= 4 GROUP BY 1, 2, 3""")
def label_graphs(spark, sf_dir):
    """GRF26, GRF27: complete graphs of small groups, nearest neighbours within larger ones."""
    cells = B.cells(spark, sf_dir).select("cell", F.col("fov").alias("grp"), F.array("x", "y").alias("v"))
    return A.label_graph(cells, 60, 4)


@query("WITH c AS (SELECT l_linenumber::BIGINT AS step, avg(l_discount) AS change FROM lineitem GROUP BY 1) SELECT step FROM (SELECT step, row_number() OVER (ORDER BY step) AS k FROM c WHERE change < 0.06) WHERE k = 2")
def stop_steps(spark, sf_dir):
    """WIN12: where a diffusion stops."""
    changes = B.table(spark, sf_dir, "lineitem").groupBy(F.col("l_linenumber").cast("long").alias("step")).agg(F.avg("l_discount").alias("change"))
    return A.stop_step(changes, 0.06)


@query(f"WITH {B.CELLS} SELECT cell, x, y FROM cells WHERE x >= 50 AND x < 950 AND y >= 50 AND y < 950 AND cell % 40 <= 30 AND x + y > 1e-6::DOUBLE")
def usable_cells(spark, sf_dir):
    """FLT08, FLT10, FLT17: planes up to a limit, signal above zero, away from the border."""
    return B.cells(spark, sf_dir).where("x >= 50 and x < 950 and y >= 50 and y < 950 and cell % 40 <= 30").where(F.col("x") + F.col("y") > 1e-6).select("cell", "x", "y")
