"""Shape features of labelled pixels: ``region_id, label, row, col``.

Everything that touches single pixels is an aggregation keyed by position, so an
object of any size is spread over all tasks. Only outlines, runs between pixels of
a row, reach a per-object function, and these grow with an object's height.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import spread_out

OBJECT = ["region_id", "label"]
# Border pixels weigh by the pattern of border neighbours around them,
# coded as 1 + 2 per edge neighbour + 10 per corner neighbour.
STRAIGHT_CODES = (5, 7, 15, 17, 25, 27)
DIAGONAL_CODES = (21, 33)
MIXED_CODES = (13, 23)


def moments(mask: DataFrame) -> DataFrame:
    """Area, centroid, extent and the ellipse with the same second moments."""
    row, col = F.col("row").cast("double"), F.col("col").cast("double")
    height = F.max("row") - F.min("row") + 1
    width = F.max("col") - F.min("col") + 1
    base = mask.groupBy(*OBJECT).agg(
        F.count(F.lit(1)).alias("area"),
        F.avg(row).alias("centroid_x"),  # the first coordinate is the row
        F.avg(col).alias("centroid_y"),
        F.var_pop(row).alias("_rr"),
        F.var_pop(col).alias("_cc"),
        F.covar_pop(row, col).alias("_rc"),
        (F.count(F.lit(1)) / (height * width)).alias("extent"),
    )
    half_gap = F.sqrt(
        F.col("_rc") * F.col("_rc") + (F.col("_rr") - F.col("_cc")) * (F.col("_rr") - F.col("_cc")) / 4
    )
    middle = (F.col("_rr") + F.col("_cc")) / 2
    large = middle + half_gap
    small = F.greatest(middle - half_gap, F.lit(0.0))
    angle = (
        F.when((F.col("_rr") == F.col("_cc")) & (F.col("_rc") > 0), math.pi / 4)
        .when(F.col("_rr") == F.col("_cc"), -math.pi / 4)
        .otherwise(F.atan2(2 * F.col("_rc"), F.col("_rr") - F.col("_cc")) / 2)
    )
    major, minor = 4 * F.sqrt(large), 4 * F.sqrt(small)
    return base.select(
        *OBJECT, "area", "centroid_x", "centroid_y", "extent",
        angle.alias("orientation"),
        major.alias("major_axis"),
        minor.alias("minor_axis"),
        F.when(large > 0, F.sqrt(F.greatest(1 - small / F.when(large > 0, large), F.lit(0.0))))
        .otherwise(0.0).alias("eccentricity"),
        F.when(major > 0, F.try_divide(minor, major)).otherwise(1.0).alias("axis_ratio"),
    )


def _gather(pixels: DataFrame, shifts: dict[tuple[int, int], int]) -> DataFrame:
    """Sum of a weight per neighbour at every pixel that is itself in the table."""
    steps = F.array(
        F.struct(F.lit(0).alias("dr"), F.lit(0).alias("dc"), F.lit(0).alias("w"), F.lit(1).alias("me")),
        *[
            F.struct(F.lit(r).alias("dr"), F.lit(c).alias("dc"), F.lit(w).alias("w"), F.lit(0).alias("me"))
            for (r, c), w in shifts.items()
        ],
    )
    sent = pixels.select(*OBJECT, "row", "col", F.explode(steps).alias("s")).select(
        *OBJECT,
        (F.col("row") + F.col("s.dr")).alias("row"),
        (F.col("col") + F.col("s.dc")).alias("col"),
        F.col("s.w").alias("w"),
        F.col("s.me").alias("me"),
    )
    return (
        sent.groupBy(*OBJECT, "row", "col")
        .agg(F.sum("w").alias("around"), F.max("me").alias("me"))
        .where(F.col("me") == 1)
        .drop("me")
    )


def perimeters(mask: DataFrame) -> DataFrame:
    """Perimeter of the border pixels, weighed by the pattern around each."""
    edges = {(-1, 0): 1, (1, 0): 1, (0, -1): 1, (0, 1): 1}
    border = _gather(mask.select(*OBJECT, "row", "col"), edges).where(F.col("around") < 4)
    pattern = {k: 2 for k in edges} | {(r, c): 10 for r in (-1, 1) for c in (-1, 1)}
    code = F.col("around") + 1
    weight: Column = (
        F.when(code.isin(*STRAIGHT_CODES), 1.0)
        .when(code.isin(*DIAGONAL_CODES), math.sqrt(2))
        .when(code.isin(*MIXED_CODES), (1 + math.sqrt(2)) / 2)
        .otherwise(0.0)
    )
    coded = _gather(border.select(*OBJECT, "row", "col"), pattern)
    return coded.groupBy(*OBJECT).agg(F.sum(weight).alias("perimeter"))


def _hull_pixels(rows: np.ndarray, left: np.ndarray, right: np.ndarray) -> int:
    """Pixel centres inside the hull of all pixel diamonds, edges included.

    Coordinates are doubled, which makes the diamond corners whole numbers.
    """
    r, low, high = 2 * rows.astype(object), 2 * left.astype(object), 2 * right.astype(object)
    corners = set(zip(r, low - 1)) | set(zip(r, high + 1))
    for c in (low, high):
        corners |= set(zip(r - 1, c)) | set(zip(r + 1, c))
    points = sorted(corners)

    def chain(sign: int) -> list:
        kept: list = []
        for p in points:
            while len(kept) > 1 and sign * (
                (kept[-1][0] - kept[-2][0]) * (p[1] - kept[-2][1])
                - (kept[-1][1] - kept[-2][1]) * (p[0] - kept[-2][0])
            ) <= 0:
                kept.pop()
            kept.append(p)
        return kept

    lower, upper = chain(1), chain(-1)

    def at(line: list, row: int, start: int) -> tuple[int, int, int]:
        while start + 1 < len(line) - 1 and line[start + 1][0] < row:
            start += 1
        (r0, c0), (r1, c1) = line[start], line[start + 1]
        return c0 * (r1 - r0) + (c1 - c0) * (row - r0), r1 - r0, start

    total, i, j = 0, 0, 0
    for row in range(int(r[0]), int(r[-1]) + 1, 2):
        low_num, low_den, i = at(lower, row, i)
        high_num, high_den, j = at(upper, row, j)
        first = -((-low_num) // (2 * low_den))  # ceiling of the undoubled column
        last = high_num // (2 * high_den)
        total += max(0, last - first + 1)
    return total


def _hull_of_object(extremes: pd.DataFrame) -> pd.DataFrame:
    ordered = extremes.sort_values("row")
    count = _hull_pixels(
        ordered["row"].to_numpy(), ordered["left"].to_numpy(), ordered["right"].to_numpy()
    )
    head = ordered.iloc[0]
    return pd.DataFrame(
        {"region_id": [head["region_id"]], "label": [head["label"]], "area_convex": [count]}
    )


def convex_areas(mask: DataFrame) -> DataFrame:
    """Pixels of the convex hull image; only the two ends of each pixel row matter."""
    extremes = mask.groupBy(*OBJECT, "row").agg(F.min("col").alias("left"), F.max("col").alias("right"))
    types = dict(mask.dtypes)
    schema = f"region_id {types['region_id']}, label {types['label']}, area_convex bigint"
    return spread_out(extremes, *OBJECT).groupBy(*OBJECT).applyInPandas(_hull_of_object, schema)


def gap_runs(mask: DataFrame) -> DataFrame:
    """Stretches of background between two pixels of an object in the same row."""
    along = Window.partitionBy(*OBJECT, "row").orderBy("col")
    step = mask.select(*OBJECT, "row", "col").withColumn("_next", F.lead("col").over(along))
    return step.where(F.col("_next") > F.col("col") + 1).select(
        *OBJECT, "row", (F.col("col") + 1).alias("start"), (F.col("_next") - 1).alias("end")
    )


def _holes_of_object(runs: pd.DataFrame) -> pd.DataFrame:
    """Hole pixels among the gaps of one object; corners connect the background.

    A gap is open if, in the row above or below, it touches background that is not
    a gap (beyond that row's ends), or a gap that is open.
    """
    starts, ends = runs["start"].to_numpy(), runs["end"].to_numpy()
    rows = runs["row"].to_numpy()
    opened = np.zeros(len(runs), dtype=bool)
    for side in ("above", "below"):
        opened |= runs[f"{side}_left"].to_numpy() > starts - 1
        opened |= runs[f"{side}_right"].to_numpy() < ends + 1
    at_row: dict[int, list[int]] = {}
    for i in np.lexsort((starts, rows)):
        at_row.setdefault(int(rows[i]), []).append(int(i))
    parent = list(range(len(runs)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(len(runs)):
        for k in at_row.get(int(rows[i]) + 1, ()):
            if starts[k] <= ends[i] + 1 and ends[k] >= starts[i] - 1:
                parent[root(k)] = root(i)
    leaking = {root(i) for i in range(len(runs)) if opened[i]}
    holes = sum(int(ends[i] - starts[i] + 1) for i in range(len(runs)) if root(i) not in leaking)
    return pd.DataFrame(
        {"region_id": [runs["region_id"].iat[0]], "label": [runs["label"].iat[0]], "holes": [holes]}
    )


def hole_areas(mask: DataFrame) -> DataFrame:
    """Number of background pixels an object encloses, for objects with gaps."""
    ends = mask.groupBy(*OBJECT, "row").agg(F.min("col").alias("_l"), F.max("col").alias("_r"))
    gaps = gap_runs(mask)
    for name, shift in (("above", 1), ("below", -1)):
        shifted = ends.select(
            *OBJECT, (F.col("row") + shift).alias("row"),
            F.col("_l").alias(f"{name}_left"), F.col("_r").alias(f"{name}_right"),
        )
        gaps = gaps.join(shifted, [*OBJECT, "row"], "left")
    far = 2**31 - 1
    gaps = gaps.fillna({"above_left": far, "below_left": far, "above_right": -far, "below_right": -far})
    types = dict(mask.dtypes)
    schema = f"region_id {types['region_id']}, label {types['label']}, holes bigint"
    return spread_out(gaps, *OBJECT).groupBy(*OBJECT).applyInPandas(_holes_of_object, schema)


def shape_features(mask: DataFrame) -> DataFrame:
    """All shape features of every object; label 0 is background."""
    objects = mask.where(F.col("label") != 0)
    area = F.col("area").cast("double")
    return (
        moments(objects)
        .join(perimeters(objects), OBJECT)
        .join(convex_areas(objects), OBJECT)
        .join(hole_areas(objects), OBJECT, "left")
        .withColumn("area_filled", F.col("area") + F.coalesce("holes", F.lit(0)))
        .withColumn(
            "circularity",
            F.when(F.col("perimeter") > 0,
                   F.try_divide(4 * math.pi * area, F.col("perimeter") * F.col("perimeter")))
            .otherwise(0.0),
        )
        .withColumn("solidity", area / F.col("area_convex"))
        .drop("holes")
    )


# The seven columns kept of a region's shape table.
KEPT = ("orientation", "area", "major_axis", "minor_axis", "circularity", "eccentricity", "solidity")


def cell_morphology(mask: DataFrame) -> DataFrame:
    """The features downstream steps use, one row per cell."""
    return shape_features(mask).select("region_id", F.col("label").alias("cell_id"), *KEPT)
