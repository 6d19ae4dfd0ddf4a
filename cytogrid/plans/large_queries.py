"""One region that grows with the table: the ways that hold no group in one task."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.ranking import exact_quantiles, score_against
from ..operators import features, graph, spatial, windows
from ..session import cut_lineage
from . import bindings as b
from . import oracle_parts as o
from .registry import query, rounded, with_parts

CELLS = o.CELLS + """,
wide AS (SELECT floor(32 * sqrt(count(*))) AS w FROM orders),
large AS (
  SELECT * REPLACE (CAST(0 AS BIGINT) AS region_id, x / 1239 * w AS x, y / 1239 * w AS y) FROM cells, wide)"""

# Candidates by tiles of the radius, for the comparison only.
NEAR = """
tiles AS (SELECT *, CAST(floor(x / 70) AS INT) AS tx, CAST(floor(y / 70) AS INT) AS ty FROM large),
near AS (
  SELECT a.cell_id AS src, b.cell_id AS dst, (a.x - b.x) ** 2 + (a.y - b.y) ** 2 AS d,
         a.cell_type AS src_type, b.cell_type AS dst_type
  FROM tiles a, range(-1, 2) i(i), range(-1, 2) j(j), tiles b
  WHERE b.tx = a.tx + i AND b.ty = a.ty + j AND (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= 4900)"""

EDGES = """
kept AS (
  SELECT src, dst, src_type, dst_type FROM (
    SELECT *, row_number() OVER (PARTITION BY src ORDER BY d, dst) AS rn FROM near WHERE src <> dst) WHERE rn <= 6),
edges AS (
  SELECT src, dst, src_type, dst_type FROM kept UNION SELECT dst, src, dst_type, src_type FROM kept)"""


@query(with_parts(CELLS, NEAR, select="""
SELECT CAST(0 AS BIGINT) AS region_id, src AS cell_id, count(*) - 1 AS local_density FROM near GROUP BY src"""))
def radius_density_large(spark, sf_dir):
    return spatial.radius_counts(b.cells_large(spark, sf_dir))


@query(with_parts(CELLS, NEAR, EDGES, select="""
SELECT CAST(0 AS BIGINT) AS region_id, src, dst, 'spatial' AS kind FROM edges GROUP BY ALL"""))
def spatial_edges_large(spark, sf_dir):
    """Nearest neighbours by grid: the region is beyond what one task compares."""
    return spatial.spatial_edges(b.cells_large(spark, sf_dir))


@query(with_parts(CELLS, NEAR, EDGES, """
reach(cell_id, seen) AS (
  SELECT cell_id, cell_id FROM large
  UNION SELECT e.dst, r.seen FROM reach r JOIN edges e ON e.src = r.cell_id AND e.src_type = e.dst_type)""", select="""
SELECT CAST(0 AS BIGINT) AS region_id, cell_id, min(seen) AS component FROM reach GROUP BY cell_id""", recursive=True))
def components_large(spark, sf_dir):
    """Components of cells of one type in one large region."""
    cells = b.cells_large(spark, sf_dir).withColumn("cluster", F.col("cell_type"))
    inner = graph.induced_edges(spatial.spatial_edges(cells), cells)
    return graph.connected_components(cells, inner)


@query(with_parts(CELLS, o.EXPRESSION, """
placed AS (
  SELECT l.cell_id, l.x, l.y, e.qty, e.price, e.disc, e.tax
  FROM large l LEFT JOIN expression e ON l.cell_id = e.cell_id),
held AS (
  SELECT p.*, -64 + 64 * ix AS x0, -64 + 64 * iy AS y0 FROM placed p,
         unnest(generate_series(CAST(ceil((x - 64) / 64) AS BIGINT), CAST(floor((x + 64) / 64) AS BIGINT))) a(ix),
         unnest(generate_series(CAST(ceil((y - 64) / 64) AS BIGINT), CAST(floor((y + 64) / 64) AS BIGINT))) b(iy))""",
    o.means("(SELECT * FROM held QUALIFY count(*) OVER (PARTITION BY x0, y0) >= 5)", "x0, y0", b.BIOMARKERS, "avgs"), """
ranked AS (
  SELECT *, avg(value) OVER g AS mean, stddev_pop(value) OVER g AS sd, count(value) OVER g AS n,
         rank() OVER (PARTITION BY biomarker ORDER BY value) - 1 AS below,
         count(*) OVER (PARTITION BY biomarker, value) AS ties
  FROM avgs WHERE value IS NOT NULL WINDOW g AS (PARTITION BY biomarker))""", select="""
SELECT x0, y0, biomarker, round((value - mean) / nullif(sd, 0), 6) AS z,
       round((below + below + ties + 1) * 50.0::DOUBLE / n, 6) AS percentile FROM ranked"""))
def scores_large(spark, sf_dir):
    """z-scores and percentiles of all windows of one region, a group per biomarker."""
    cells = b.cells_large(spark, sf_dir).join(b.expression(spark, sf_dir), "cell_id", "left")
    members = windows.sliding_windows(cells, origin=b.CORNER, keep=b.BIOMARKERS)
    means = windows.window_averages(members, b.BIOMARKERS)
    long = cut_lineage(features.means_to_long(means, ["region_id", "x0", "y0"], b.BIOMARKERS).where("value IS NOT NULL"))
    scored = score_against(long, None, ["region_id", "biomarker"])
    return rounded(scored.select("x0", "y0", "biomarker", "z", "percentile"), "z", "percentile")


@query(with_parts(o.EXPRESSION, o.EXPRESSION_LONG, select="""
SELECT biomarker, round(quantile_cont(value, 0.2), 6) AS low, round(quantile_cont(value, 0.5), 6) AS middle
FROM expression_long GROUP BY biomarker"""))
def quantiles_large(spark, sf_dir):
    """Exact quantiles of all cells' expression as one group per biomarker."""
    long = b.expression(spark, sf_dir).unpivot(["cell_id"], b.BIOMARKERS, "biomarker", "value")
    found = exact_quantiles(long, ["biomarker"], {"low": 0.2, "middle": 0.5})
    return rounded(found, "low", "middle")
