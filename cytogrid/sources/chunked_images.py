"""Chunked 2-D arrays, one folder per channel, as a data source with partitions of its own.

A folder ``<root>/<region>/<channel>`` holds ``.zarray`` and a file per chunk, ``y.x`` or ``y/x``. Planning lists
folders and reads the headers of the chosen arrays; a task reads a run of chunks. Each chunk is a row, so no task
ever holds a whole image. Chunks without a file have the array's fill value.

Regions and channels are chosen by options, or by filters on these columns where Spark pushes filters to Python
sources; folders of other arrays are not opened.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from ..schema import TILES
from . import blosc

MASK = "seg_mask"
NOT_CHANNELS = (MASK, "he_img")
HEADER = ".zarray"
FORMAT = "chunked_image"
#: Pixels a task reads at least, where the array has them, and headers read at a time while planning.
RUN_PIXELS, READERS = 1 << 22, 16
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
PROBLEMS = (OSError, ValueError, KeyError, TypeError, ArithmeticError, zlib.error, pa.ArrowException)


def _decompress(content: bytes, compressor: dict | None) -> bytes:
    kind = compressor and compressor.get("id")
    if not kind:
        return content
    if kind in ("zlib", "gzip"):
        return zlib.decompress(content, 47)
    if kind == "blosc":
        return blosc.unpack(content)
    if kind == "zstd":
        import zstandard

        return zstandard.ZstdDecompressor().decompressobj().decompress(content)
    raise ValueError(f"compressor {kind} is not supported")


def _unfilter(values: np.ndarray, filters: Sequence[dict] | None, dtype: np.dtype) -> np.ndarray:
    """Undoes an array's filters, the last one first."""
    for step in reversed(filters or ()):
        if step["id"] == "delta":
            values = np.cumsum(values.view(np.dtype(step.get("astype", step["dtype"]))), dtype=np.dtype(step["dtype"]))
        elif step["id"] == "fixedscaleoffset":
            stored = values.view(np.dtype(step.get("astype", step["dtype"])))
            values = (stored / step["scale"] + step["offset"]).astype(np.dtype(step["dtype"]))
        else:
            raise ValueError(f"filter {step['id']} is not supported")
    return values.view(dtype)


def _chunk(content: bytes | None, meta: dict, y: int, x: int) -> np.ndarray:
    """The part of a chunk that lies inside the array."""
    rows, cols = meta["chunks"]
    dtype = np.dtype(meta["dtype"])
    if content is None:
        fill = meta.get("fill_value")
        chunk = np.full((rows, cols), 0 if fill is None else float(fill))
    else:
        raw = np.frombuffer(_decompress(content, meta.get("compressor")), np.uint8)
        chunk = _unfilter(raw, meta.get("filters"), dtype).reshape((rows, cols), order=meta.get("order", "C"))
    return chunk[: meta["shape"][0] - y * rows, : meta["shape"][1] - x * cols]


def file_system(root: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", root))


def _folders(files: pyarrow.fs.FileSystem, path: str) -> list[str]:
    found = files.get_file_info(pyarrow.fs.FileSelector(path))
    return sorted(f.base_name for f in found if f.type == pyarrow.fs.FileType.Directory)


def _content(files: pyarrow.fs.FileSystem, path: str) -> bytes | None:
    """A file's bytes, None where there is none."""
    if files.get_file_info(path).type == pyarrow.fs.FileType.NotFound:
        return None
    with files.open_input_stream(path) as stream:
        return stream.read()


@dataclass
class ChunkRun(InputPartition):
    """Chunks ``start`` to ``stop``, row by row, of one array."""

    region: str
    channel: str
    header: str
    error: str | None
    start: int
    stop: int


class ImageReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root = options["root"].rstrip("/")
        self.chosen = {
            "region_id": json.loads(options["regions"]) if "regions" in options else None,
            "channel": json.loads(options["channels"]) if "channels" in options else None,
        }

    def choose(self, column: str, names: Sequence[str]) -> None:
        before = self.chosen[column]
        self.chosen[column] = sorted(set(names) if before is None else set(names) & set(before))

    def read_header(self, region: str, channel: str) -> tuple[str, str | None]:
        files, root = file_system(self.root)
        try:
            header = _content(files, f"{root}/{region}/{channel}/{HEADER}")
            if header is None:
                return "", "FileNotFoundError: no array header"
            meta = json.loads(header)
            if len(meta["shape"]) != 2:
                raise ValueError(f"expected a 2-D array, found shape {meta['shape']}")
            return header.decode("utf-8"), None
        except PROBLEMS as problem:
            return "", f"{type(problem).__name__}: {problem}"

    def partitions(self) -> list[InputPartition]:
        files, root = file_system(self.root)
        arrays = []
        regions = _folders(files, root)
        for region in regions if self.chosen["region_id"] is None else sorted({*regions} & {*self.chosen["region_id"]}):
            channels = _folders(files, f"{root}/{region}")
            if self.chosen["channel"] is not None:
                channels = sorted({*channels} & {*self.chosen["channel"]})
            arrays += [(region, c) for c in channels]
        with ThreadPoolExecutor(READERS) as pool:
            headers = list(pool.map(lambda a: self.read_header(*a), arrays))
        runs: list[InputPartition] = []
        for (region, channel), (header, error) in zip(arrays, headers, strict=True):
            if error:
                runs.append(ChunkRun(region, channel, header, error, 0, 1))
                continue
            meta = json.loads(header)
            down, along = (-(-s // c) for s, c in zip(meta["shape"], meta["chunks"], strict=True))
            step = max(1, RUN_PIXELS // (meta["chunks"][0] * meta["chunks"][1]))
            runs += [
                ChunkRun(region, channel, header, None, low, min(low + step, down * along))
                for low in range(0, down * along, step)
            ]
        return runs or [ChunkRun("", "", "", None, 0, 0)]

    def read(self, partition: ChunkRun) -> Iterator[pa.RecordBatch]:
        if partition.error:
            yield tile(partition.region, partition.channel, error=partition.error)
            return
        if partition.stop == partition.start:
            return
        files, root = file_system(self.root)
        meta = json.loads(partition.header)
        along = -(-meta["shape"][1] // meta["chunks"][1])
        for i in range(partition.start, partition.stop):
            y, x = divmod(i, along)
            name = f"{y}{meta.get('dimension_separator', '.')}{x}"
            try:
                content = _content(files, f"{root}/{partition.region}/{partition.channel}/{name}")
                pixels = _chunk(content, meta, y, x)
                corner = y * meta["chunks"][0], x * meta["chunks"][1]
                yield tile(partition.region, partition.channel, corner, pixels, content is not None)
            except PROBLEMS as problem:
                yield tile(partition.region, partition.channel, error=f"{type(problem).__name__}: {problem}")


class PushingReader(ImageReader):
    """Takes filters on region and channel; Spark asks for it only where its setting allows."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            column = f.attribute[0] if isinstance(f, EqualTo | In) else None
            if column in self.chosen:
                self.choose(column, [f.value] if isinstance(f, EqualTo) else list(f.value))
            else:
                yield f


class ChunkedImages(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self):
        return TILES

    def reader(self, schema) -> DataSourceReader:
        return (PushingReader if self.options.get("pushdown") == "true" else ImageReader)(dict(self.options))


def tile(
    region: str, channel: str, corner: tuple[int, int] | None = None, pixels: np.ndarray | None = None,
    stored: bool | None = None, error: str | None = None,
) -> pa.RecordBatch:
    """One row of the source."""
    flat = None if pixels is None else pa.array(np.ascontiguousarray(pixels, dtype=float).ravel())
    return pa.record_batch({
        "region_id": pa.array([region]),
        "channel": pa.array([channel]),
        "y0": pa.array([corner and corner[0]], pa.int64()),
        "x0": pa.array([corner and corner[1]], pa.int64()),
        "height": pa.array([None if pixels is None else pixels.shape[0]], pa.int32()),
        "width": pa.array([None if pixels is None else pixels.shape[1]], pa.int32()),
        "pixels": pa.nulls(1, pa.list_(pa.float64())) if flat is None else pa.ListArray.from_arrays([0, len(flat)], flat),
        "stored": pa.array([stored], pa.bool_()),
        "error": pa.array([error], pa.string()),
    })


def read_tiles(
    spark: SparkSession, root: str, regions: Sequence[str] | None = None, channels: Sequence[str] | None = None
) -> DataFrame:
    """The chunks of the chosen regions and channels, all if none are named; unreadable ones carry an error."""
    spark.dataSource.register(ChunkedImages)
    source = spark.read.format(FORMAT).option("root", root).option("pushdown", spark.conf.get(PUSHDOWN))
    for name, chosen in (("regions", regions), ("channels", channels)):
        if chosen is not None:
            source = source.option(name, json.dumps(list(chosen)))
    return source.load()


def channel_tiles(tiles: DataFrame, channels: list[str] | None = None) -> DataFrame:
    """Readable tiles of complete channels: requested names that exist, never the mask.

    A channel has a file for its first chunk. One with an unreadable chunk is left out as a whole, see
    :func:`unreadable`.
    """
    wanted = tiles.where(~F.col("channel").isin(*NOT_CHANNELS))
    if channels:
        wanted = wanted.where(F.col("channel").isin(*channels))
    key = ["region_id", "channel"]
    whole = wanted.groupBy(*key).agg(
        F.max(F.expr("y0 = 0 AND x0 = 0 AND stored")).alias("_first"), F.count("error").alias("_errors")
    )
    good = whole.where("_first AND _errors = 0").select(*key)
    return wanted.join(good, key, "left_semi").drop("stored", "error")


def unreadable(tiles: DataFrame) -> DataFrame:
    return tiles.where(F.col("error").isNotNull()).select("region_id", "channel", "error")


def to_pixels(tiles: DataFrame) -> DataFrame:
    """One row per pixel."""
    spread = tiles.select("region_id", "channel", "y0", "x0", "width", F.posexplode("pixels").alias("_at", "value"))
    return spread.select(
        "region_id",
        "channel",
        (F.col("y0") + F.floor(F.col("_at") / F.col("width"))).alias("row"),
        (F.col("x0") + F.col("_at") % F.col("width")).alias("col"),
        "value",
    )


def mask_pixels(tiles: DataFrame) -> DataFrame:
    """Labelled pixels of the segmentation masks; unreadable masks stop the job."""
    mask = tiles.where(F.col("channel") == MASK)
    checked = mask.withColumn(
        "pixels",
        F.when(F.col("error").isNull(), F.col("pixels")).otherwise(
            F.raise_error(F.concat(F.lit("unreadable mask: "), F.col("error"))).cast("array<double>")
        ),
    )
    return to_pixels(checked).where(F.col("value") != 0).select(
        "region_id", F.col("value").cast("long").alias("label"), "row", "col"
    )


def write_image(
    pixels: DataFrame, root: str, chunk: tuple[int, int] = (512, 512), dtype: str = "<f8", fill: float = 0.0,
    separator: str = ".",
) -> None:
    """Pixels (``region_id, channel, row, col, value``) as arrays in shuffled blosc frames.

    Pixels not given have the fill value. Chunks of nothing else get no file, but for the first one, by which a
    channel is known. Files depend on their pixels alone, so a task run twice writes the same ones.
    """
    key = ["region_id", "channel"]
    rows, cols = chunk
    kind = np.dtype(dtype)

    def save(path: str, content: bytes) -> None:
        files, at = file_system(path)
        files.create_dir(at.rsplit("/", 1)[0])
        with files.open_output_stream(at) as stream:
            stream.write(content)

    def write_chunk(table: pa.Table) -> pa.Table:
        region, channel, y, x = (table[c][0].as_py() for c in (*key, "_y", "_x"))
        values = np.full(chunk, fill, kind)
        given = table.filter(pc.is_valid(table["value"]))
        values[np.asarray(given["row"]) - y * rows, np.asarray(given["col"]) - x * cols] = np.asarray(given["value"])
        if (values != fill).any() or (y, x) == (0, 0):
            save(f"{root}/{region}/{channel}/{y}{separator}{x}", blosc.pack(values.tobytes(), kind.itemsize))
        return table.select(key).slice(0, 1)

    def write_header(table: pa.Table) -> pa.Table:
        region, channel, height, width = (table[c][0].as_py() for c in (*key, "height", "width"))
        meta = {
            "zarr_format": 2, "shape": [height, width], "chunks": list(chunk), "dtype": kind.str, "order": "C",
            "fill_value": fill, "filters": None, "dimension_separator": separator,
            "compressor": {"id": "blosc", "cname": "lz4", "clevel": 5, "shuffle": 1, "blocksize": 0},
        }
        save(f"{root}/{region}/{channel}/{HEADER}", json.dumps(meta).encode("utf-8"))
        return table.select(key)

    sizes = pixels.groupBy(*key).agg((F.max("row") + 1).alias("height"), (F.max("col") + 1).alias("width"))
    first = sizes.select(*key, F.lit(0).alias("row"), F.lit(0).alias("col"), F.lit(None).cast("double").alias("value"))
    placed = pixels.select(*key, "row", "col", "value").unionByName(first).withColumns(
        {"_y": F.expr(f"row div {rows}"), "_x": F.expr(f"col div {cols}")}
    )
    written = "region_id string, channel string"
    placed.groupBy(*key, "_y", "_x").applyInArrow(write_chunk, written).count()
    sizes.groupBy(*key).applyInArrow(write_header, written).count()
