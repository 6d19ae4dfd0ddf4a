"""Filters, lookups, scans and joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import filters
from ..operators.features import arcsinh_normalize, to_long
from ..sources import tables
from . import bindings as b
from .oracle_parts import CELLS, ENRICHED, EXPRESSION, EXPRESSION_LONG, ROIS, roi_members
from .registry import query, rounded, with_parts


@query(with_parts(CELLS, select="SELECT region_id, cell_id, round(x, 6) AS x, round(y, 6) AS y FROM cells"))
def scan_cells(spark, sf_dir):
    root = tables.export_native(
        b.cells(spark, sf_dir).select("region_id", "cell_id", "x", "y"), "cell_data")
    scanned = tables.read_cells(spark, root)
    return rounded(scanned.withColumn("region_id", F.col("region_id").cast("long")), "x", "y")


@query(with_parts(CELLS, select="""
SELECT region_id, cell_id, CAST(left(cell_type, 1) AS BIGINT) AS value, cell_type FROM cells"""))
def scan_cell_types(spark, sf_dir):
    types = b.cells(spark, sf_dir).select(
        "region_id", "cell_id", F.left("cell_type", F.lit(1)).alias("code"), "cell_type")
    root = tables.export_native(types, "cell_types")
    scanned = tables.read_cell_types(spark, root)
    return scanned.withColumn("region_id", F.col("region_id").cast("long"))


@query(with_parts(CELLS, select="""
SELECT CAST(left(cell_type, 1) AS BIGINT) AS value, cell_type FROM cells GROUP BY ALL"""))
def cell_type_lookup(spark, sf_dir):
    types = b.cells(spark, sf_dir).withColumn(
        "value", F.left("cell_type", F.lit(1)).cast("long"))
    return tables.type_lookup(types)


@query(with_parts(EXPRESSION, EXPRESSION_LONG, select="""
SELECT region_id, cell_id, biomarker, round(value, 6) AS value FROM expression_long
WHERE biomarker IN ('qty', 'tax')"""))
def scan_expression(spark, sf_dir):
    root = tables.export_native(b.expression_by_region(spark, sf_dir), "expression")
    scanned = tables.read_expression(spark, root, ["qty", "tax"])
    return rounded(scanned.withColumn("region_id", F.col("region_id").cast("long")), "value")


@query(with_parts(CELLS, select="""
SELECT region_id, cell_id, round(x, 6) AS x, round(y, 6) AS y FROM cells
WHERE x BETWEEN 100 AND 500 AND y BETWEEN 200 AND 700"""))
def roi_filter(spark, sf_dir):
    inside = filters.cells_in_rectangle(b.cells(spark, sf_dir), 100, 500, 200, 700)
    return rounded(inside.select("region_id", "cell_id", "x", "y"), "x", "y")


@query(with_parts(CELLS, ROIS, roi_members(), select="""
SELECT region_id, roi_id, cell_id FROM roi_members"""))
def roi_range_join(spark, sf_dir):
    inside = filters.cells_in_rois(b.cells(spark, sf_dir), b.rois(spark, sf_dir))
    return inside.select("region_id", "roi_id", "cell_id")


@query(with_parts(EXPRESSION, EXPRESSION_LONG, select="""
SELECT region_id, cell_id, biomarker, round(value, 6) AS value FROM expression_long
WHERE cell_id IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')"""))
def subset_semi(spark, sf_dir):
    features = to_long(b.expression_by_region(spark, sf_dir), ["region_id", "cell_id"], b.BIOMARKERS)
    subset = b.table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(
        F.col("o_orderkey").alias("cell_id"))
    return rounded(filters.subset_features(features, subset, ["cell_id"]), "value")


@query(with_parts(EXPRESSION, EXPRESSION_LONG, select="""
SELECT region_id, cell_id, biomarker, round(value, 6) AS value FROM expression_long
WHERE biomarker IN (SELECT CASE o_orderstatus WHEN 'F' THEN 'tax' WHEN 'O' THEN 'qty' ELSE 'other' END
                    FROM orders)"""))
def channel_select(spark, sf_dir):
    features = to_long(b.expression_by_region(spark, sf_dir), ["region_id", "cell_id"], b.BIOMARKERS)
    wanted = b.table(spark, sf_dir, "orders").select(F.expr(
        "CASE o_orderstatus WHEN 'F' THEN 'tax' WHEN 'O' THEN 'qty' ELSE 'other' END").alias("biomarker"))
    return rounded(filters.select_channels(features, wanted), "value")


@query(with_parts(CELLS, select="""
SELECT DISTINCT study || '_reg' || region_id AS region_id, study FROM (
  SELECT region_id, 's' || (region_id % 3) AS study FROM cells)
WHERE study IN (SELECT 's' || n_regionkey FROM nation WHERE n_regionkey <> 1)"""))
def region_select(spark, sf_dir):
    regions = b.cells(spark, sf_dir).select(
        F.expr("concat('s', region_id % 3, '_reg', region_id)").alias("region_id")).distinct()
    studies = b.table(spark, sf_dir, "nation").where("n_regionkey <> 1").select(
        F.expr("concat('s', n_regionkey)").alias("study"))
    return filters.regions_of_studies(regions, studies)


@query(with_parts(CELLS, select="""
SELECT region_id, cell_id, lower(split_part(cell_type, '-', 2)) AS cell_type FROM cells"""))
def cell_type_rename(spark, sf_dir):
    cells = b.cells(spark, sf_dir).select("region_id", "cell_id", "cell_type")
    renames = b.table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("old_type"),
        F.lower(F.split_part("o_orderpriority", F.lit("-"), F.lit(2))).alias("new_type")).distinct()
    return filters.rename_cell_types(cells, renames)


@query(with_parts(CELLS, EXPRESSION, ENRICHED, select="""
SELECT region_id, cell_id, cell_type, round(x, 6) AS x, round(y, 6) AS y,
       round(size_area, 6) AS size_area, round(qty, 6) AS qty, round(price, 6) AS price,
       round(disc, 6) AS disc, round(tax, 6) AS tax FROM enriched WHERE qty IS NOT NULL"""))
def cells_enriched(spark, sf_dir):
    joined = b.cells(spark, sf_dir).join(b.expression(spark, sf_dir), "cell_id")
    numbers = ["x", "y", "size_area", *b.BIOMARKERS]
    return rounded(joined.select("region_id", "cell_id", "cell_type", *numbers), *numbers)


@query(with_parts(CELLS, select="""
SELECT region_id, cluster, n, round(share, 6) AS share,
       CAST(row_number() OVER (PARTITION BY region_id ORDER BY n DESC, cluster) AS INT) AS position
FROM (SELECT region_id, cluster, count(*) AS n,
             count(*) / sum(count(*)) OVER (PARTITION BY region_id) AS share
      FROM cells GROUP BY region_id, cluster) WHERE share > 0.11"""))
def significant_classes(spark, sf_dir):
    found = filters.significant_classes(b.cells(spark, sf_dir), ["region_id"], "cluster", 0.11)
    return rounded(found, "share")


@query(with_parts(CELLS, select="""
SELECT region_id, cluster, n, round(share, 6) AS share FROM (
  SELECT region_id, cluster, count(*) AS n,
         count(*) / sum(count(*)) OVER (PARTITION BY region_id) AS share
  FROM cells GROUP BY region_id, cluster) WHERE share > 0.01 AND cluster >= 0"""))
def major_clusters(spark, sf_dir):
    return rounded(filters.major_clusters(b.cells(spark, sf_dir)), "share")


@query(with_parts(EXPRESSION, EXPRESSION_LONG, """
bent AS (
  SELECT e.region_id, e.cell_id, e.biomarker, asinh(e.value / (5 * q.base + 1e-5::DOUBLE)) AS value
  FROM expression_long e JOIN (
    SELECT region_id, biomarker, quantile_cont(value, 0.2) AS base
    FROM expression_long GROUP BY ALL) q USING (region_id, biomarker))""", select="""
SELECT region_id, cell_id, biomarker, round(value / stddev_samp(value) OVER
       (PARTITION BY region_id, biomarker), 6) AS value FROM bent"""), name="arcsinh_normalize")
def arcsinh_normalized(spark, sf_dir):
    features = to_long(b.expression_by_region(spark, sf_dir), ["region_id", "cell_id"], b.BIOMARKERS)
    return rounded(arcsinh_normalize(features), "value")


@query("SELECT o_orderkey AS cell_id, o_orderpriority AS cell_type, o_orderstatus AS status FROM orders")
def checkpoint_roundtrip(spark, sf_dir):
    rows = b.table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS cell_id", "o_orderpriority AS cell_type", "o_orderstatus AS status")
    store = tables.StageStore.fresh(spark)
    store.save(rows, "cells")
    return store.load("cells")
