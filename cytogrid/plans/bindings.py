"""Cells, expression, regions of interest and replies derived from the given tables.

Integer arithmetic only, so that another SQL engine derives the same values.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import broadcast_by_measure

CELLS_PER_REGION = 1500
WIDTH = 1239
BIOMARKERS = ["qty", "price", "disc", "tax"]
ROI = ["region_id", "roi_id"]
TILE_SIDE = 8
CORNER = (-64, -64)  # of the window grid that the SQL twins lay over every region


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    broadcast_by_measure(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _hashed(key: str, factor: int, low: int = 2147483648) -> F.Column:
    return F.expr(f"CAST(({key} % {low}) * {factor} % 4294967296 AS DOUBLE) / 4294967296 * {WIDTH}")


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions, types, shape and cluster of every cell, one per order."""
    key = "o_orderkey"
    return table(spark, sf_dir, "orders").select(
        F.expr(f"{key} div {CELLS_PER_REGION}").alias("region_id"),
        F.col(key).alias("cell_id"),
        _hashed(key, 2654435761).alias("x"),
        _hashed(key, 1597334677).alias("y"),
        F.col("o_orderpriority").alias("cell_type"),
        F.expr("50 + o_totalprice % 400").cast("double").alias("size_area"),
        F.expr("CAST(o_custkey % 314 AS DOUBLE) / 100 - 1.57D").alias("orientation"),
        F.expr(f"CAST({key} * 7 % 101 AS DOUBLE) / 103").alias("shape_circularity"),
        F.expr(f"CAST({key} * 13 % 100 AS DOUBLE) / 101").alias("shape_eccentricity"),
        F.expr(f"CAST({key} * 29 % 100 AS DOUBLE) / 107").alias("shape_solidity"),
        F.expr("CAST(o_custkey % 9 - 1 AS INT)").alias("cluster"),
    )


def cells_large(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole table as one region, as dense at every scale: its width grows with the root of the count."""
    orders = table(spark, sf_dir, "orders")
    width = math.floor(32 * math.sqrt(orders.count()))
    return cells(spark, sf_dir).withColumns({
        "region_id": F.lit(0).cast("long"),
        "x": F.col("x") / WIDTH * width,
        "y": F.col("y") / WIDTH * width,
    })


def expression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide expression, one row per cell with line items."""
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("cell_id")).agg(
        F.avg("l_quantity").alias("qty"),
        F.avg("l_extendedprice").alias("price"),
        F.avg("l_discount").alias("disc"),
        F.avg("l_tax").alias("tax"),
    )


def expression_by_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    region = F.expr(f"cell_id div {CELLS_PER_REGION}").alias("region_id")
    return expression(spark, sf_dir).select(region, "cell_id", *BIOMARKERS)


def enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells with their expression; cells without line items have none."""
    return cells(spark, sf_dir).join(expression(spark, sf_dir), "cell_id", "left")


def rois(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nine overlapping rectangles in every region."""
    regions = table(spark, sf_dir, "orders").select(
        F.expr(f"o_orderkey div {CELLS_PER_REGION}").alias("region_id")
    ).distinct()
    corner = F.expr("explode(sequence(0, 8))").alias("roi_id")
    return regions.select("region_id", corner).selectExpr(
        "region_id",
        "roi_id",
        "CAST(413 * (roi_id div 3) - 20 AS DOUBLE) AS x0",
        "CAST(413 * (roi_id div 3) + 433 AS DOUBLE) AS x1",
        "CAST(413 * (roi_id % 3) - 20 AS DOUBLE) AS y0",
        "CAST(413 * (roi_id % 3) + 433 AS DOUBLE) AS y1",
    )


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each embedding as an 8 x 8 tile of one channel (its label)."""
    values = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("tile_id"),
        F.col("label").alias("channel"),
        F.posexplode("embedding").alias("at", "pixel"),
    )
    return values.select(
        "tile_id",
        "channel",
        F.expr(f"at div {TILE_SIDE}").cast("int").alias("row"),
        F.expr(f"at % {TILE_SIDE}").cast("int").alias("col"),
        F.col("pixel").cast("double").alias("value"),
    )


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A numbered reply and an expert label per part."""
    keyword = F.expr(
        """CASE p_partkey % 8 WHEN 0 THEN 'Glomerular tuft' WHEN 1 THEN 'Small blood vessel'
           WHEN 2 THEN 'Distal tubule segment' WHEN 3 THEN 'Proximal tubule segment'
           WHEN 4 THEN 'Interstitial space' WHEN 5 THEN 'Peritubular capillary bed'
           WHEN 6 THEN 'Collecting tubular duct' ELSE 'Unclassified tissue' END"""
    )
    second = F.expr(
        """CASE p_partkey % 5 WHEN 0 THEN 'Proximal tubule wall' WHEN 1 THEN 'Distal tubule wall'
           WHEN 2 THEN 'Glomerular edge' WHEN 3 THEN 'Wide blood vessel'
           ELSE 'Immune infiltrate' END"""
    )
    truth = F.expr(
        """CASE p_partkey % 6 WHEN 0 THEN 'Proximal tubules' WHEN 1 THEN 'Distal tubules'
           WHEN 2 THEN 'Glomeruli' WHEN 3 THEN 'Blood vessel' WHEN 4 THEN 'Interstitium'
           ELSE 'Other' END"""
    )
    reply = F.concat(
        F.lit("1. **"), keyword, F.lit("**:\nSupporting evidence: "), F.col("p_name"),
        F.lit("\n"), F.col("p_type"), F.lit("\n2. **"), second, F.lit("**:\n"), F.col("p_brand"),
        F.lit("\nClosing remarks that run on for longer than fifty characters: "), F.col("p_name"),
    )
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("reply_id"), reply.alias("reply"), truth.alias("truth")
    )
