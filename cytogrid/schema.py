"""Column names and schemas of the tables the operators exchange.

Anything measured per biomarker is long (``biomarker``, ``value``): biomarker
names differ per study and may hold dots or slashes, so they are values here and
never column names that need quoting.
"""

from __future__ import annotations

from pyspark.sql import types as T

REGION = "region_id"
CELL = "cell_id"

CELLS = T.StructType(
    [
        T.StructField("cell_id", T.LongType()),
        T.StructField("x", T.DoubleType()),
        T.StructField("y", T.DoubleType()),
    ]
)
CELL_TYPES = T.StructType(
    [
        T.StructField("cell_id", T.LongType()),
        T.StructField("value", T.LongType()),
        T.StructField("cell_type", T.StringType()),
    ]
)
TILES = T.StructType(
    [
        T.StructField("region_id", T.StringType()),
        T.StructField("channel", T.StringType()),
        T.StructField("y0", T.LongType()),
        T.StructField("x0", T.LongType()),
        T.StructField("height", T.IntegerType()),
        T.StructField("width", T.IntegerType()),
        T.StructField("pixels", T.ArrayType(T.DoubleType())),
        T.StructField("stored", T.BooleanType()),
        T.StructField("error", T.StringType()),
    ]
)

# Key of a sliding window: windows of several sizes may share a corner.
PATCH = ("region_id", "patch_size", "x0", "y0")
