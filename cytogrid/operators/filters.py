"""Filters and small lookups: rectangles, id subsets, channels, regions, renames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.skew import attach


def cells_in_rectangle(
    cells: DataFrame, x0: float, x1: float, y0: float, y1: float
) -> DataFrame:
    """Cells inside a rectangle, all four edges included."""
    if not (x1 > x0 and y1 > y0):
        raise ValueError("a rectangle needs x1 > x0 and y1 > y0")
    return cells.where(F.col("x").between(x0, x1) & F.col("y").between(y0, y1))


def cells_in_rois(cells: DataFrame, rois: DataFrame, tile: float = 256.0) -> DataFrame:
    """Every (cell, roi) pair of a region where the cell lies in the rectangle.

    ``rois`` holds ``region_id, roi_id, x0, x1, y0, y1``. Rectangles are laid out
    on a grid and matched by tile, an equi-join that needs no broadcast; a cell is
    in one tile only, so a pair can appear only once.
    """

    def tile_of(c):
        return F.floor(F.col(c) / F.lit(tile))

    laid = (
        rois.where((F.col("x1") > F.col("x0")) & (F.col("y1") > F.col("y0")))
        .withColumn("_tx", F.explode(F.sequence(tile_of("x0"), tile_of("x1"))))
        .withColumn("_ty", F.explode(F.sequence(tile_of("y0"), tile_of("y1"))))
    )
    placed = cells.withColumn("_tx", tile_of("x")).withColumn("_ty", tile_of("y"))
    return (
        placed.join(laid, ["region_id", "_tx", "_ty"])
        .where(
            (F.col("x") >= F.col("x0"))
            & (F.col("x") <= F.col("x1"))
            & (F.col("y") >= F.col("y0"))
            & (F.col("y") <= F.col("y1"))
        )
        .drop("_tx", "_ty", "x0", "x1", "y0", "y1")
    )


def subset_features(features: DataFrame, subset: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key occurs in ``subset``."""
    return features.join(subset.select(*keys), list(keys), "left_semi")


def select_channels(features: DataFrame, channels: DataFrame | None = None) -> DataFrame:
    """Long features of the requested channels; ``None`` keeps all of them."""
    if channels is None:
        return features
    names = channels.select("biomarker").distinct()
    return attach(features, names, ["biomarker"], ["cell_id"])


def common_channels(features: DataFrame, channels: DataFrame) -> DataFrame:
    """Requested names that exist, in order."""
    return (
        features.select("biomarker").intersect(channels.select("biomarker")).orderBy("biomarker")
    )


def regions_of_studies(regions: DataFrame, studies: DataFrame) -> DataFrame:
    """Regions whose id starts with one of the study prefixes (text before ``_``)."""
    with_study = regions.withColumn("study", F.split_part("region_id", F.lit("_"), F.lit(1)))
    return attach(with_study, studies.select("study").distinct(), ["study"], ["region_id"])


def rename_cell_types(cells: DataFrame, renames: DataFrame) -> DataFrame:
    """Replace ``cell_type`` by its new name; a type without one stops the job.

    ``renames`` holds ``old_type, new_type`` and, optionally, ``study``.
    """
    keys = ["cell_type"] + (["study"] if "study" in renames.columns else [])
    lookup = renames.withColumnRenamed("old_type", "cell_type")
    joined = attach(cells, lookup, keys, ["cell_id"], "left")
    known = F.when(F.col("new_type").isNotNull(), F.col("new_type")).otherwise(
        F.raise_error(
            F.concat(F.lit("no new name for cell type "), F.coalesce("cell_type", F.lit("NULL")))
        ).cast("string")
    )
    return joined.withColumn("cell_type", known).drop("new_type")


def class_shares(labels: DataFrame, keys: Sequence[str], label: str) -> DataFrame:
    """Count and share of each label inside its group."""
    whole = Window.partitionBy(*keys)  # one row per label, after the aggregation
    return (
        labels.groupBy(*keys, label)
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("share", F.col("n") / F.sum("n").over(whole))
    )


def significant_classes(
    labels: DataFrame, keys: Sequence[str], label: str, threshold: float = 0.02
) -> DataFrame:
    """Labels with a share above the threshold, ranked by frequency (ties by label)."""
    order = Window.partitionBy(*keys).orderBy(F.desc("n"), label)
    return (
        class_shares(labels, keys, label)
        .where(F.col("share") > threshold)
        .withColumn("position", F.row_number().over(order))
    )


def major_clusters(labels: DataFrame, threshold: float = 0.01) -> DataFrame:
    """Assigned clusters (>= 0) with more than ``threshold`` of their region's cells."""
    return class_shares(labels, ["region_id"], "cluster").where(
        (F.col("cluster") >= 0) & (F.col("share") > threshold)
    )
