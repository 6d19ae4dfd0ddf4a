"""Shared pieces of the text operators: words, batches, folds, written tables, components."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cytogrid.session import cut_lineage

#: Rows of one Arrow batch of whole texts; bounds what a Python worker holds at a time.
BATCH_ROWS = 256
#: Entries of a worker's cache of words before it starts afresh.
CACHE_WORDS = 800_000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def binary_text(column: str = "text") -> Column:
    """The text as UTF-8 bytes, null as empty; ``bytes.split`` then cuts at [\\x20\\x09-\\x0D] alone."""
    return F.coalesce(F.col(column), F.lit("")).cast("binary")


def map_batches(
    df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, rows: int = BATCH_ROWS
) -> DataFrame:
    """``mapInArrow`` over small batches: long texts must not pile up in one of them."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    return df.mapInArrow(work, schema)


def slices(
    work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], rows: int = BATCH_ROWS
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``work`` over pieces of the batches that arrive, whatever the session's batch size is."""

    def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return work(b.slice(at, rows) for b in batches for at in range(0, b.num_rows, rows))

    return sliced


def fold(column: str, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; a null id counts as fold 0."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % parts, F.lit(0))


def forget(cache: dict, limit: int = CACHE_WORDS) -> None:
    if len(cache) > limit:
        cache.clear()


def new_words(texts: Iterable[list[bytes]], cache: dict) -> list[bytes]:
    """Distinct words of the texts that the cache lacks."""
    return list(set().union(*texts).difference(cache))


def text_key(column: str = "text") -> Column:
    """16 bytes that stand for a text in joins."""
    return F.unhex(F.md5(F.coalesce(F.col(column), F.lit("")).cast("binary")))


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each node of ``edges`` (a, b) reaches.

    Labels go to neighbours and then to the label's own label, so rounds grow with the
    logarithm of the longest path. Minima are combined before each shuffle, and every
    round is written to the shared folder.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    links = cut_lineage(both.where(F.col("a") != F.col("b")).distinct())
    labels = cut_lineage(links.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("root")))
    while True:
        near = (
            links.join(labels.withColumnRenamed("node", "b"), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("root").alias("near"))
        )
        step = labels.join(near, "node", "left").select(
            "node", F.col("root").alias("old"), F.least("root", F.coalesce("near", "root")).alias("root")
        )
        up = labels.select(F.col("node").alias("root"), F.col("root").alias("up"))
        jumped = cut_lineage(
            step.join(up, "root", "left").select("node", "old", F.least("root", F.coalesce("up", "root")).alias("root"))
        )
        labels = jumped.select("node", "root")
        if jumped.where(F.col("old") != F.col("root")).isEmpty():
            return labels
