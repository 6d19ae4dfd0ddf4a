"""CSV tables of regions, and stage tables kept as Parquet in the shared folder."""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping, Sequence

import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.features import to_long
from ..schema import CELL_TYPES, CELLS
from ..session import scratch_path
from .chunked_images import file_system

COMMITS = "_commits"
#: Rows of a region that one file is meant to hold.
FILE_ROWS = 500_000

# Two layouts hold the same table: <root>/<region>/<region>.<kind>.csv as measured,
# and <root>/<kind>/region_id=<region>/*.csv as Spark writes it.
_REGION_IN_PATH = r"(?:region_id=([^/]+)/[^/]+|([^/]+)/[^/]+)$"


def _paths(root: str, kind: str, layout: str, regions: Sequence[str] | None = None) -> list[str]:
    """Files of the chosen regions, or of all; no others are listed or read."""
    if layout == "measured":
        return [f"{root}/{r}/*.{kind}.csv" for r in (regions or ["*"])]
    if layout == "partitioned":
        return [f"{root}/{kind}/{f'region_id={r}' if regions else r}/*.csv" for r in (regions or ["*"])]
    raise ValueError(f"unknown layout {layout}")


def _scan(
    spark: SparkSession, root: str, kind: str, schema: T.StructType | None, layout: str,
    regions: Sequence[str] | None = None,
) -> DataFrame:
    """All regions in one scan; the region is read off the file's path."""
    reader = spark.read.option("header", True).option("enforceSchema", False)
    if schema is not None:
        reader = reader.schema(schema)
    path = F.url_decode(F.col("_metadata.file_path"))
    region = F.coalesce(
        F.nullif(F.regexp_extract(path, _REGION_IN_PATH, 1), F.lit("")),
        F.regexp_extract(path, _REGION_IN_PATH, 2),
    )
    rows = reader.csv(_paths(root, kind, layout, regions))
    return rows.select(region.alias("region_id"), "*")


def _header(
    spark: SparkSession, root: str, kind: str, layout: str, regions: Sequence[str] | None = None
) -> list[str]:
    """Column names of one file of the table; the data is not read."""
    return spark.read.option("header", True).csv(_paths(root, kind, layout, regions)).columns


def read_cells(
    spark: SparkSession, root: str, layout: str = "partitioned", regions: Sequence[str] | None = None
) -> DataFrame:
    """Cell positions (``CELL_ID, X, Y``); other columns are ignored. Fails if missing."""
    names = _header(spark, root, "cell_data", layout, regions)
    wanted = {f.name.upper(): f for f in CELLS.fields}
    missing = set(wanted) - {n.upper() for n in names}
    if missing:
        raise ValueError(f"cell table lacks {sorted(missing)}")
    schema = T.StructType(
        [T.StructField(n, wanted[n.upper()].dataType if n.upper() in wanted else T.StringType())
         for n in names]
    )
    rows = _scan(spark, root, "cell_data", schema, layout, regions)
    return rows.select(
        "region_id", F.col("CELL_ID").alias("cell_id"), F.col("X").alias("x"), F.col("Y").alias("y")
    )


def read_cell_types(
    spark: SparkSession, root: str, layout: str = "partitioned", regions: Sequence[str] | None = None
) -> DataFrame:
    """Cell types: exactly three columns, named by position."""
    names = _header(spark, root, "cell_types", layout, regions)
    if len(names) != 3:
        raise ValueError(f"a cell type table has 3 columns, found {len(names)}")
    given = T.StructType(
        [T.StructField(n, f.dataType) for n, f in zip(names, CELL_TYPES.fields)]
    )
    return _scan(spark, root, "cell_types", given, layout, regions).toDF(
        "region_id", "cell_id", "value", "cell_type"
    )


def type_lookup(cell_types: DataFrame) -> DataFrame:
    """Distinct value-to-type pairs."""
    return cell_types.select("value", "cell_type").distinct()


def read_expression(
    spark: SparkSession,
    root: str,
    channels: Sequence[str] = (),
    layout: str = "partitioned",
    regions: Sequence[str] | None = None,
) -> DataFrame:
    """Long expression of the requested channels (all if none); unknown names raise.

    The files of one call share one header: call it once per study, with the study's regions.
    """
    names = _header(spark, root, "expression", layout, regions)
    available = [n for n in names if n.upper() != "CELL_ID"]
    unknown = set(channels) - set(available)
    if unknown:
        raise ValueError(f"no such channels: {sorted(unknown)}")
    schema = T.StructType(
        [T.StructField(n, T.LongType() if n.upper() == "CELL_ID" else T.DoubleType()) for n in names]
    )
    rows = _scan(spark, root, "expression", schema, layout, regions).withColumnRenamed("CELL_ID", "cell_id")
    return to_long(rows, ["region_id", "cell_id"], list(channels) or available)


def export_native(df: DataFrame, kind: str, root: str | None = None) -> str:
    """Write one CSV table partitioned by region; returns the root folder."""
    root = root or scratch_path(df.sparkSession, "tables")
    native = df.withColumnRenamed("cell_id", "CELL_ID")
    for c in ("x", "y"):
        if c in native.columns:
            native = native.withColumnRenamed(c, c.upper())
    # Several files per region where it is large, one where it is not: files cost time to list and open.
    sizes = native.groupBy("region_id").agg(F.ceil(F.count(F.lit(1)) / FILE_ROWS).alias("_files"))
    dealt = native.join(sizes.withColumnRenamed("region_id", "_region"), F.col("region_id").eqNullSafe(F.col("_region")))
    part = F.pmod(F.xxhash64("CELL_ID"), F.col("_files"))
    dealt.repartition("region_id", part).drop("_files", "_region").write.partitionBy("region_id").option(
        "header", True
    ).csv(f"{root}/{kind}")
    return root


class StageStore:
    """Stage results as Parquet tables below one folder, added by commits.

    Every save writes to a folder of its own; a small manifest, written last, makes all tables of
    the save visible at once. What a run that broke off has written without one is never read.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    @classmethod
    def fresh(cls, spark: SparkSession) -> StageStore:
        return cls(spark, scratch_path(spark, "stages"))

    def path(self, stage: str) -> str:
        return f"{self.folder}/{stage}"

    def save(self, df: DataFrame, stage: str, mode: str = "overwrite") -> None:
        self.commit({stage: df}, mode)

    def commit(self, tables: Mapping[str, DataFrame], mode: str = "overwrite") -> None:
        """Save several tables, all of them or none; ``append`` adds to what the stages hold."""
        name = uuid.uuid4().hex
        for stage, df in tables.items():
            df.write.parquet(f"{self.path(stage)}/{name}")
        self._publish(name, {
            "append": mode == "append", "tables": {stage: df.schema.json() for stage, df in tables.items()}})

    def _publish(self, name: str, manifest: dict) -> None:
        files, folder = file_system(f"{self.folder}/{COMMITS}")
        files.create_dir(folder)
        number = len(self._commits()) + 1
        with files.open_output_stream(f"{folder}/{name}.draft") as stream:
            stream.write(json.dumps(manifest).encode("utf-8"))
        files.move(f"{folder}/{name}.draft", f"{folder}/{number:08d}-{name}.json")

    def _commits(self) -> list[tuple[str, dict]]:
        """Names and manifests of all commits in order; one driver writes to a store at a time."""
        files, folder = file_system(f"{self.folder}/{COMMITS}")
        listed = files.get_file_info(pyarrow.fs.FileSelector(folder, allow_not_found=True))
        found = []
        for info in sorted((f for f in listed if f.base_name.endswith(".json")), key=lambda f: f.base_name):
            with files.open_input_stream(info.path) as stream:
                found.append((info.base_name[9:-5], json.loads(stream.read())))
        return found

    def load(self, stage: str) -> DataFrame | None:
        """The stage's rows, or ``None`` if it was never saved."""
        paths: list[str] = []
        schema = None
        for name, manifest in self._commits():
            if stage in manifest["tables"]:
                schema = T.StructType.fromJson(json.loads(manifest["tables"][stage]))
                paths = [*(paths if manifest["append"] else []), f"{self.path(stage)}/{name}"]
        return None if schema is None else self.spark.read.schema(schema).parquet(*paths)
