"""Image tables, one row per pixel: ``<image keys>, row, col, value``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import clip, present
from ..functions.ranking import exact_quantiles
from ..functions.skew import attach

# Histogram edges 0, 8, ..., 248, the last bin closed on both sides.
BIN_WIDTH = 8
BINS = 31
# Default colours of the composite.
COLORS = (
    (1.0, 0.0, 0.0), (0.0, 1.0, 0.0), (0.0, 0.0, 1.0), (1.0, 1.0, 0.0),
    (0.0, 1.0, 1.0), (1.0, 0.0, 1.0), (0.5, 0.5, 0.5),
)


def normalize(
    pixels: DataFrame,
    params: DataFrame,
    spread: Sequence[str],
    keys: Sequence[str] = ("region_id", "channel"),
) -> DataFrame:
    """Scale valid channels to 0..1 between their ``low`` and ``high``; drop the others.

    Every region has limits of its own; ``params`` has one row per ``keys``.
    """
    valid = params.where("valid").select(*keys, "low", "high")
    span = F.col("high") - F.col("low")
    scaled = clip(F.try_divide(F.col("value") - F.col("low"), span), 0.0, 1.0)
    return attach(pixels, valid, list(keys), spread).withColumn("value", scaled).drop("low", "high")


def average(pixels: DataFrame, keys: Sequence[str]) -> DataFrame:
    return pixels.groupBy(*keys).agg(F.avg(present(F.col("value"))).alias("average"))


def median(pixels: DataFrame, keys: Sequence[str]) -> DataFrame:
    known = pixels.withColumn("value", present(F.col("value")))
    return exact_quantiles(known, keys, {"median": 0.5})


def histogram_of(value: Column, is_float: bool) -> Column:
    """Aggregate: share of pixels per bin; values above the last edge are counted only
    in the denominator."""
    level = F.floor(clip(value, 0.0, 1.0) * 255) if is_float else clip(value, 0, 255)
    bin_ = F.when(level <= BINS * BIN_WIDTH, F.least(F.floor(level / BIN_WIDTH), F.lit(BINS - 1)))
    shares = [F.count_if(bin_ == i) / F.count(F.lit(1)) for i in range(BINS)]
    return F.array(*shares)


def histogram(pixels: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The 31 shares of each image as one array, one partial aggregation."""
    kind = pixels.schema["value"].dataType.typeName()
    if kind not in ("double", "integer", "long", "short", "byte"):
        raise TypeError(f"no histogram of {kind} pixels")
    return pixels.groupBy(*keys).agg(
        histogram_of(F.col("value"), kind == "double").alias("histogram")
    )


FEATURIZERS = {"histogram": (histogram, True), "average": (average, False), "median": (median, False)}


def flatten_image(pixels: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Pixels of each (small) image as one array in row-major order."""
    cell = F.struct("row", "col", "value")
    return pixels.groupBy(*keys).agg(
        F.transform(F.sort_array(F.collect_list(cell)), lambda p: p["value"]).alias("raw")
    )


def roi_pixels(pixels: DataFrame, rois: DataFrame, tile: int = 256) -> DataFrame:
    """Pixels of each ROI: whole coordinates, left and lower edge in, the others out.

    An ROI reaching past the image simply finds no pixels there.
    """

    def tile_of(c: Column) -> Column:
        return F.floor(c / F.lit(tile)).cast("long")

    low_x, high_x = F.greatest(F.col("x0"), F.lit(0)).cast("long"), F.col("x1").cast("long")
    low_y, high_y = F.greatest(F.col("y0"), F.lit(0)).cast("long"), F.col("y1").cast("long")
    laid = (
        rois.select("region_id", "roi_id", low_x.alias("_x0"), high_x.alias("_x1"),
                    low_y.alias("_y0"), high_y.alias("_y1"))
        .where("_x1 > _x0 AND _y1 > _y0")
        .withColumn("_tx", F.explode(F.sequence(tile_of(F.col("_x0")), tile_of(F.col("_x1") - 1))))
        .withColumn("_ty", F.explode(F.sequence(tile_of(F.col("_y0")), tile_of(F.col("_y1") - 1))))
    )
    placed = pixels.withColumn("_tx", tile_of(F.col("col"))).withColumn("_ty", tile_of(F.col("row")))
    return placed.join(laid, ["region_id", "_tx", "_ty"]).where(
        "col >= _x0 AND col < _x1 AND row >= _y0 AND row < _y1"
    ).drop("_tx", "_ty", "_x0", "_x1", "_y0", "_y1")


def roi_features(pixels: DataFrame, rois: DataFrame, featurizer: str = "histogram") -> DataFrame:
    """Features of every channel inside each ROI, joined in channel order."""
    compute, is_array = FEATURIZERS[featurizer]
    per_channel = compute(roi_pixels(pixels, rois), ["region_id", "roi_id", "channel"])
    part = F.col(featurizer) if is_array else F.array(featurizer)
    # One row per channel and ROI.
    ordered = F.sort_array(F.collect_list(F.struct("channel", part.alias("f"))))
    return per_channel.groupBy("region_id", "roi_id").agg(
        F.flatten(F.transform(ordered, lambda c: c["f"])).alias("features")
    )


def rgb_composite(
    pixels: DataFrame,
    channels: Sequence[str],
    factors: Sequence[float] | None = None,
    colors: Sequence[Sequence[float]] = COLORS,
) -> DataFrame:
    """Sum of channel times factor times colour per pixel, over the image's 95 % level
    where that is above 1."""
    factors = list(factors) if factors else [1.0] * len(channels)
    if len(factors) != len(channels) or len(channels) > len(colors):
        raise ValueError("need one factor and one colour per channel")

    def part(i: int) -> Column:
        total = F.lit(0.0)
        for name, factor, color in zip(channels, factors, colors):
            weight = float(factor) * float(color[i])
            total = total + F.when(F.col("channel") == name, F.col("value") * weight).otherwise(0.0)
        return F.sum(total)

    spots = pixels.where(F.col("channel").isin(*channels)).groupBy("region_id", "row", "col").agg(
        *[part(i).alias(c) for i, c in enumerate(("red", "green", "blue"))]
    )
    levels = spots.unpivot(["region_id"], ["red", "green", "blue"], "part", "value")
    top = exact_quantiles(levels, ["region_id"], {"_top": 0.95})
    scaled = attach(spots, top, ["region_id"], ["row", "col"])
    divisor = F.when(F.col("_top") > 1, F.col("_top")).otherwise(1.0)
    return scaled.withColumns({c: F.col(c) / divisor for c in ("red", "green", "blue")}).drop("_top")
