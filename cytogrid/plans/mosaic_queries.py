"""Feature blocks, scaling, clusters of windows and their representatives."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import features, mosaic, windows
from ..schema import PATCH
from ..session import cut_lineage
from . import bindings as b
from . import oracle_parts as o
from .registry import query, rounded, with_parts

B = b.BIOMARKERS
SHAPE = ["size_area", "shape_circularity", "shape_eccentricity", "shape_solidity"]
KEY = list(PATCH)

SCALED = """
scaled AS (
  SELECT region_id, cell_id, x, y, """ + ", ".join(
    f"{c} / stddev_samp({c}) OVER (PARTITION BY region_id) AS {c}" for c in B) + """ FROM enriched)"""
BLOCK = (o.CELLS, o.EXPRESSION, o.ENRICHED, SCALED, o.windows("scaled"), """
blocks AS (
  SELECT region_id, x0, y0, """ + ", ".join(f"round(avg({c}), 9) AS {c}" for c in B) + """
  FROM window_members GROUP BY ALL)""", """
pairs AS (
  SELECT a.region_id, sqrt(""" + " + ".join(f"(a.{c} - b.{c}) ** 2" for c in B) + """) AS d
  FROM blocks a JOIN blocks b ON a.region_id = b.region_id
   AND (a.x0 < b.x0 OR (a.x0 = b.x0 AND a.y0 < b.y0)))""")


def biomarker_block(spark, sf_dir):
    cells = mosaic.scale_columns(
        b.enriched(spark, sf_dir).select("region_id", "cell_id", "x", "y", *B), B)
    means = windows.window_averages(windows.sliding_windows(cells, origin=b.CORNER, keep=B), B)
    return means.select(*KEY, F.array(*B).alias("block"))


def shape_block(spark, sf_dir):
    cells = mosaic.scale_columns(
        b.cells(spark, sf_dir).select("region_id", "cell_id", "x", "y", *SHAPE), SHAPE)
    means = windows.window_averages(windows.sliding_windows(cells, origin=b.CORNER, keep=SHAPE), SHAPE)
    return means.select(*KEY, F.array(*SHAPE).alias("block"))


def type_block(spark, sf_dir):
    cells = b.cells(spark, sf_dir)
    members = windows.cap_members(windows.sliding_windows(cells, origin=b.CORNER, keep=["cell_type"]))
    return features.type_vector(members, cells, KEY).select(*KEY, F.col("shares").alias("block"))


@query(with_parts(*BLOCK, select="""
SELECT region_id, count(*) AS n_pairs, round(avg(d), 6) AS mean_distance, round(max(d), 6) AS max_distance
FROM pairs GROUP BY ALL"""))
def pairwise_distance(spark, sf_dir):
    block = cut_lineage(biomarker_block(spark, sf_dir))
    found = mosaic.pair_summary(block, "region_id", KEY[1:], "block")
    return rounded(found, "mean_distance", "max_distance")


@query(with_parts(*BLOCK, select="""
SELECT region_id, round(quantile_cont(d, 0.95), 6) AS scale FROM (
  SELECT region_id, d FROM pairs
  UNION ALL SELECT region_id, 0.0::DOUBLE FROM (
    SELECT region_id, unnest(range(n * (n + 1) // 2)) FROM (
      SELECT region_id, count(*) AS n FROM blocks GROUP BY ALL)))
GROUP BY ALL"""))
def roi_block_scale(spark, sf_dir):
    block = cut_lineage(biomarker_block(spark, sf_dir))
    return rounded(mosaic.pair_quantile(block, "region_id", KEY[1:], "block"), "scale")


VECTORS = """
vectors AS (
  SELECT vec_id AS member, label AS region_id, CAST(vec_id % 3 AS INT) AS cluster, embedding FROM embeddings),
long AS (
  SELECT region_id, cluster, member, CAST(i AS INT) AS dim, CAST(embedding[i + 1] AS DOUBLE) AS value
  FROM vectors, range(64) t(i)),
medians AS (
  SELECT region_id, cluster, dim, quantile_cont(value, 0.5) AS median FROM long GROUP BY ALL),
far AS (
  SELECT region_id, cluster, member, round(sqrt(sum((value - median) ** 2)), 9) AS distance
  FROM long JOIN medians USING (region_id, cluster, dim) GROUP BY ALL),
sizes AS (SELECT region_id, cluster, count(*) AS n FROM vectors GROUP BY ALL)"""


def vectors(spark, sf_dir):
    return b.table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("member"), F.col("label").alias("region_id"),
        F.expr("CAST(vec_id % 3 AS INT)").alias("cluster"),
        F.col("embedding").cast("array<double>").alias("features"))


@query(with_parts(VECTORS, select="""
SELECT region_id, cluster, dim, round(median, 6) AS median FROM medians"""))
def cluster_median(spark, sf_dir):
    return rounded(mosaic.cluster_medians(vectors(spark, sf_dir), ["region_id", "cluster"]), "median")


@query(with_parts(VECTORS, select="""
SELECT region_id, cluster, member, round(distance, 6) AS distance, CAST(turn AS INT) AS position FROM (
  SELECT *, row_number() OVER (PARTITION BY region_id, cluster ORDER BY distance, member) AS turn
  FROM far JOIN sizes USING (region_id, cluster) WHERE n >= 6) WHERE turn <= 3"""))
def cluster_center(spark, sf_dir):
    picked = mosaic.pick_representatives(
        vectors(spark, sf_dir), ["region_id", "cluster"], ["member"], 3, "center")
    return rounded(picked.drop("features"), "distance")


@query(with_parts(VECTORS, """
weighed AS (
  SELECT f.*, greatest(1 / (distance + 1e-5::DOUBLE) - quantile_cont(1 / (distance + 1e-5::DOUBLE), 0.5)
           OVER (PARTITION BY region_id, cluster), 0) ** 2 AS w
  FROM far f JOIN sizes USING (region_id, cluster) WHERE n >= 6)""", """
tickets AS (
  SELECT *, ln((CAST('0x' || left(md5('123:' || region_id || ':' || cluster || ':' || member), 8) AS BIGINT)
                + 0.5::DOUBLE) / 4294967296) / w AS ticket FROM weighed WHERE w > 0)""", select="""
SELECT region_id, cluster, member, round(distance, 6) AS distance,
       CAST(row_number() OVER (PARTITION BY region_id, cluster ORDER BY distance, member) AS INT) AS position
FROM (SELECT *, row_number() OVER (PARTITION BY region_id, cluster ORDER BY ticket DESC, member) AS turn
      FROM tickets) WHERE turn <= 3"""))
def cluster_sample(spark, sf_dir):
    picked = mosaic.pick_representatives(
        vectors(spark, sf_dir), ["region_id", "cluster"], ["member"], 3, "sample")
    return rounded(picked.drop("features"), "distance")


@query(with_parts(VECTORS, """
picked AS (
  SELECT region_id, cluster, member AS pivot FROM (
    SELECT *, row_number() OVER (PARTITION BY region_id, cluster ORDER BY distance, member) AS turn
    FROM far JOIN sizes USING (region_id, cluster) WHERE n >= 6) WHERE turn <= 3)""", """
nearest AS (
  SELECT region_id, cluster, member, min(d) AS distance FROM (
    SELECT a.region_id, a.cluster, a.member, p.pivot, round(sqrt(sum((a.value - b.value) ** 2)), 9) AS d
    FROM long a JOIN picked p ON p.region_id = a.region_id AND p.cluster = a.cluster AND p.pivot <> a.member
    JOIN long b ON b.member = p.pivot AND b.dim = a.dim GROUP BY ALL) GROUP BY ALL)""", """
cuts AS (
  SELECT region_id, quantile_cont(distance, 0.1) AS low, quantile_cont(distance, 0.8) AS high
  FROM nearest GROUP BY ALL)""", select="""
SELECT region_id, cluster, member, round(distance, 6) AS distance,
       round(1 - least(greatest((distance - low) / (high - low), 0), 1), 6) AS score
FROM nearest JOIN cuts USING (region_id) WHERE distance < high"""))
def roi_retrieve(spark, sf_dir):
    points = vectors(spark, sf_dir)
    pivots = mosaic.pick_representatives(points, ["region_id", "cluster"], ["member"], 3, "center")
    found = mosaic.retrieve_similar(points, pivots, ["member"])
    return rounded(found, "distance", "score")


@query()
def mosaic_rois(spark, sf_dir):
    blocks = {"biomarkers": biomarker_block(spark, sf_dir), "types": type_block(spark, sf_dir),
              "shape": shape_block(spark, sf_dir)}
    members = windows.sliding_windows(b.cells(spark, sf_dir), origin=b.CORNER)
    centers = windows.describe_windows(members).select(*KEY, "center_x", "center_y")
    _, picked = mosaic.mosaic(blocks, centers, KEY)
    return rounded(picked.drop("features"), "distance")
