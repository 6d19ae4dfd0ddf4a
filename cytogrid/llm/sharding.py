"""Contiguous shards of near equal bytes, by global prefix sums of document sizes.

Documents are put into one global order, in which equal texts stand side by side (or by id alone). Every range
partition of that order adds up its bytes and rows; running totals over these few numbers give each partition its
start, and running totals inside a partition give each document its place in the whole. The line of all bytes is
then cut at equal targets.

A cut goes to the edge of the document under its target that is nearer. Where the equal texts around a target take
no more bytes than the longest document, it goes to an edge of that group, so small groups are never divided. Either
way a cut is at most half the longest document away from its target, and a shard at most that document away from its
equal share. Larger groups of copies, which may be more than a shard, are divided.

Rows with no text count one byte, as empty texts do, and belong to their group; rows with no id stand before others of
their group. Repeated rows are all placed; which of them has which slot does not show. A table with fewer documents
than shards leaves shards empty, an empty table gives no rows. Long texts are only hashed and measured, and further
columns stay out of the way unless they are asked for by ``carry``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cytogrid.llm.common import text_key
from cytogrid.session import cut_lineage

SHARDS = 8


def global_order(docs: DataFrame, key: str, text: str, by: str, carry: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """The stored rows, and their places in the global order: partition ``part`` and ``at`` inside it.

    Sizes and digests are stored first, so that ranges are drawn from them without a second look at the texts, and
    every later step, also after the loss of an executor, sees the same order.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    group = text_key(text) if by == "text" else F.lit(None).cast("binary")
    stored = cut_lineage(
        docs.select(
            F.col(key).alias("_id"),
            (F.octet_length(whole) + 1).cast("long").alias("_size"),
            F.crc32(whole.cast("binary")).alias("_crc"),
            group.alias("_group"),
            F.monotonically_increasing_id().alias("_row"),
            *[F.col(c).alias(f"_carried_{c}") for c in carry],
        )
    )
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = (
        stored.select("_id", "_size", "_crc", "_group", "_row")
        .repartitionByRange(parts, "_group", "_id")
        .sortWithinPartitions("_group", "_id")
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_at", F.monotonically_increasing_id())
    )
    return stored, cut_lineage(ordered)


def prefix_sums(ordered: DataFrame) -> DataFrame:
    """Adds each row's bytes before it (``_start``), with it (``_end``), and number of rows before it (``_place``)."""
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
    totals = ordered.groupBy("_part").agg(F.sum("_size").alias("_bytes"), F.count("*").alias("_rows"))
    starts = totals.select(
        "_part",
        F.coalesce(F.sum("_bytes").over(before), F.lit(0)).alias("_bytes_before"),
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_rows_before"),
    )
    inside = Window.partitionBy("_part").orderBy("_at")
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        ordered.withColumn("_upto", F.sum("_size").over(upto))
        .withColumn("_number", F.row_number().over(inside))
        .join(F.broadcast(starts), "_part")  # as many rows as shuffle partitions
        .select(
            "_id", "_size", "_crc", "_group", "_row",
            (F.col("_bytes_before") + F.col("_upto") - F.col("_size")).alias("_start"),
            (F.col("_bytes_before") + F.col("_upto")).alias("_end"),
            (F.col("_rows_before") + F.col("_number") - 1).alias("_place"),
        )
    )


def cuts(placed: DataFrame, shards: int) -> list[int]:
    """The bytes before each shard but the first; at most one row for each cut reaches the driver."""
    total, longest = placed.agg(F.max("_end"), F.max("_size")).first()
    if total is None:
        return []
    share = lambda c: F.expr(f"{c} * {shards} div {total}")
    under = placed.select("_group", "_start", "_end", share("_start").alias("first"), share("_end").alias("last"))
    under = under.where((F.col("first") < F.col("last")) & (F.col("first") < shards - 1))
    edges = (
        placed.join(F.broadcast(under.select("_group").distinct()), "_group", "left_semi")  # no more rows than cuts
        .groupBy("_group")
        .agg(F.min("_start").alias("group_start"), F.max("_end").alias("group_end"))
    )
    found = {}
    for row in under.join(edges, "_group", "left").collect():
        low, high = row["_start"], row["_end"]
        if row["group_start"] is not None and row["group_end"] - row["group_start"] <= longest:
            low, high = row["group_start"], row["group_end"]
        for shard in range(row["first"] + 1, min(row["last"], shards - 1) + 1):
            before = 2 * total * shard <= (low + high) * shards  # the target lies in the lower half
            found[shard] = low if before else high
    return [found[shard] for shard in sorted(found)]


def shard_documents(
    docs: DataFrame, shards: int = SHARDS, key: str = "doc_id", text: str = "text", by: str = "text",
    carry: Sequence[str] = (),
) -> DataFrame:
    """One row per document: id, ``size``, ``text_crc32``, ``law``, ``shard``, ``slot`` and ``grown_shard``.

    ``by="text"`` puts equal texts side by side, ``by="id"`` follows the id. Columns named in ``carry``, such as the
    text, are added at the end by one join on the row's number.
    """
    stored, ordered = global_order(docs, key, text, by, carry)
    placed = cut_lineage(prefix_sums(ordered))
    limits = cuts(placed, shards)
    shard = F.lit(0)
    if limits:
        ends = F.array(*[F.lit(c).cast("long") for c in limits])
        shard = F.size(F.filter(ends, lambda c: c <= F.col("_start")))
    sharded = placed.withColumn("_shard", shard.cast("int"))
    firsts = sharded.groupBy("_shard").agg(F.min("_place").alias("_first"))
    result = sharded.join(F.broadcast(firsts), "_shard")  # a row for each shard
    if carry:
        result = result.join(stored.select("_row", *[f"_carried_{c}" for c in carry]), "_row")
    return result.select(
        F.col("_id").alias(key),
        F.col("_size").alias("size"),
        F.col("_crc").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        F.col("_shard").alias("shard"),
        (F.col("_place") - F.col("_first")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        *[F.col(f"_carried_{c}").alias(c) for c in carry],
    )


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, key: str = "doc_id", text: str = "text") -> None:
    """Writes one folder of Parquet per shard, ``shard=0`` and so on, documents in the order of their slots.

    A shard is written by several tasks, each with a run of slots, so that its size does not matter.
    """
    found = shard_documents(docs, shards, key, text, carry=[text])
    found.repartitionByRange(F.col("shard"), F.col("slot")).sortWithinPartitions("shard", "slot").write.partitionBy(
        "shard"
    ).parquet(path)
