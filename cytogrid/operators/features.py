"""Averages, normalisation, composition and orientation of groups of cells."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import present
from ..functions.ranking import exact_quantiles
from ..functions.skew import attach
from ..session import cut_lineage

# Averages of the same cells differ in the last bits with the order of summation,
# which flips ranks among ties. Rounding makes ranks independent of partitioning.
RANK_DIGITS = 9
EPSILON = 1e-5


def to_long(wide: DataFrame, ids: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Wide biomarker columns to (biomarker, value) rows, NaN to NULL."""
    quoted = [F.col(f"`{c}`").cast("double").alias(c) for c in columns]
    return wide.select(*ids, *quoted).unpivot(
        list(ids), [f"`{c}`" for c in columns], "biomarker", "value"
    ).withColumn("value", present(F.col("value")))


def group_averages(
    members: DataFrame, keys: Sequence[str], columns: Sequence[str], digits: int | None = RANK_DIGITS
) -> DataFrame:
    """Mean of every column per group as long rows; missing values are skipped."""

    def mean(c: str):
        value = F.avg(present(F.col(f"`{c}`").cast("double")))
        return (value if digits is None else F.round(value, digits)).alias(c)

    return means_to_long(members.groupBy(*keys).agg(*[mean(c) for c in columns]), keys, columns)


def means_to_long(wide: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Wide rows of means to (biomarker, value) rows."""
    return wide.unpivot(list(keys), [f"`{c}`" for c in columns], "biomarker", "value")


def arcsinh_normalize(expression: DataFrame, quantile: float = 0.2) -> DataFrame:
    """Per region and biomarker: asinh of the value over 5 times its 20 % quantile,
    divided by the sample deviation of the result."""
    keys = ["region_id", "biomarker"]
    expression = cut_lineage(expression)  # read for the quantiles and for the result
    base = exact_quantiles(expression, keys, {"_base": quantile})
    bent = attach(expression, base, keys, ["cell_id"]).withColumn(
        "value", F.asinh(F.try_divide(F.col("value"), F.col("_base") * 5 + EPSILON))
    ).drop("_base")
    scale = bent.groupBy(*keys).agg(F.stddev_samp("value").alias("_scale"))
    return attach(bent, scale, keys, ["cell_id"]).withColumn(
        "value", F.try_divide(F.col("value"), F.col("_scale"))
    ).drop("_scale")


def composition(
    members: DataFrame, keys: Sequence[str], label: str = "cell_type"
) -> DataFrame:
    """Share of each cell type; the denominator counts untyped cells too."""
    whole = Window.partitionBy(*keys)  # one row per type, after the aggregation
    return (
        members.groupBy(*keys, label)
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("share", F.col("n") / F.sum("n").over(whole))
        .where(F.col(label).isNotNull())
    )


def enrichment(members: DataFrame, cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Composition of each group and its ratio to the composition of the region's typed cells."""
    typed = cells.where(F.col("cell_type").isNotNull())
    region = composition(typed, ["region_id"]).select(
        "region_id", "cell_type", F.col("share").alias("region_share")
    )
    groups = composition(members, keys)
    return attach(
        groups, region, ["region_id", "cell_type"], [k for k in keys if k != "region_id"]
    ).withColumn("enrichment", F.try_divide(F.col("share"), F.col("region_share") + EPSILON))


def type_levels(cells: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mean level per cell type and biomarker, min-max scaled over the region's types."""
    means = group_averages(
        cells.where(F.col("cell_type").isNotNull()), ["region_id", "cell_type"], columns
    )
    over_types = Window.partitionBy("region_id", "biomarker")  # one row per cell type
    low, high = F.min("value").over(over_types), F.max("value").over(over_types)
    return means.withColumn("level", F.try_divide(F.col("value") - low, high - low)).drop("value")


def signature_biomarkers(
    cells: DataFrame, columns: Sequence[str], threshold: float = 0.8
) -> DataFrame:
    """Biomarkers whose scaled level stands out in a cell type."""
    return type_levels(cells, columns).where(F.col("level") > threshold)


def signature_lists(signatures: DataFrame) -> DataFrame:
    """One sorted biomarker list per (region, cell type)."""
    return signatures.groupBy("region_id", "cell_type").agg(
        F.sort_array(F.collect_list("biomarker")).alias("signature")
    )


def circular_means(angle: Column) -> tuple[Column, Column]:
    """Aggregates for the mean direction and the circular variance; angles are not doubled."""
    value = present(angle)
    sin, cos = F.avg(F.sin(value)), F.avg(F.cos(value))
    return F.atan2(sin, cos), F.lit(1.0) - F.sqrt(sin * sin + cos * cos)


def orientation(members: DataFrame, keys: Sequence[str], angle: str = "orientation") -> DataFrame:
    """Mean direction and circular variance per group."""
    mean_angle, variance = circular_means(F.col(angle))
    return members.groupBy(*keys).agg(
        mean_angle.alias("mean_orientation"), variance.alias("circular_variance")
    )


def type_vector(members: DataFrame, cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Share of every type of the region in each group, absent types as zero.

    The denominator counts matched (typed) cells only.
    """
    typed = members.where(F.col("cell_type").isNotNull())
    counts = typed.groupBy(*keys, "cell_type").agg(F.count(F.lit(1)).alias("n"))
    by_type = counts.groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.struct("cell_type", "n"))).alias("_counts"),
        F.sum("n").alias("_all"),
    )
    types = cells.where(F.col("cell_type").isNotNull()).groupBy("region_id").agg(
        F.sort_array(F.collect_set("cell_type")).alias("types")
    )
    spread = [k for k in keys if k != "region_id"]
    return attach(by_type, types, ["region_id"], spread).select(
        *keys,
        "types",
        F.transform(
            "types",
            lambda t: F.coalesce(F.try_element_at("_counts", t), F.lit(0)) / F.col("_all"),
        ).alias("shares"),
    )
