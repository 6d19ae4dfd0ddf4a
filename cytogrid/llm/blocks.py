"""Comparisons inside groups, in blocks of bounded size, without emitting the pairs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cytogrid.llm.common import map_batches

#: Rows of a block, on average; a task holds two blocks at a time.
BLOCK = 512


def groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """The runs of rows that are equal in the first ``keys`` columns."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        values = list(zip(*(batch.column(i).to_pylist() for i in range(keys)), strict=True))
        start = 0
        for i, value in enumerate(values):
            if value != last:
                if i > start:
                    held.append(batch.slice(start, i - start))
                if held:
                    yield pa.Table.from_batches(held)
                held, start, last = [], i, value
        if len(values) > start:
            held.append(batch.slice(start))
    if held:
        yield pa.Table.from_batches(held)


def pairs_in_groups(
    rows: DataFrame,
    group: str,
    member: str,
    work: Callable[[pa.Table], pa.RecordBatch | None],
    schema: str,
    block: int = BLOCK,
    batch: int = 4096,
) -> DataFrame:
    """Calls ``work`` for every pair of blocks of every group with at least two rows.

    A group of m rows is dealt into about m / ``block`` blocks by a hash of the member; a row
    is copied once per block of its group, so a hot group is spread over many tasks and no
    task holds more than two blocks. ``work`` gets the columns (group, first, second, own, then
    those of ``rows``), ``own`` being the row's block: where ``first`` is ``second`` all pairs of rows are
    meant, else those between the two.
    """
    counted = rows.groupBy(F.col(group).alias("group")).agg(F.count("*").alias("size")).where("size > 1")
    dealt = (
        rows.withColumn("group", F.col(group))
        .join(counted, "group")
        .withColumn("blocks", F.ceil(F.col("size") / block))
        .withColumn("own", F.pmod(F.xxhash64(F.col(member)), F.col("blocks")))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("group", F.least("own", "other").alias("first"), F.greatest("own", "other").alias("second"), "own", *rows.columns)
    )
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = dealt.repartition(parts, "group", "first", "second").sortWithinPartitions("group", "first", "second")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, 3):
            found = work(table)
            if found is not None and found.num_rows:
                yield found

    return map_batches(placed, each, schema, rows=batch)
