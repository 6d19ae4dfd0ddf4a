"""Session helpers: a tuned local session and the shared folder for cut lineage."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Packed bytes of a table up to which a plan may broadcast it unmeasured.
BROADCAST_BYTES = 1 << 18

_own_folders: dict[str, str] = {}  # of local sessions, by application


def local_session(cores: int = 8, app: str = "cytogrid") -> SparkSession:
    """A session for tests and the benchmark; clusters bring their own settings."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.python.filterPushdown.enabled", "true")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it.

    Only a local master, where driver and executors are one machine, may fall
    back to a temporary folder.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or _own_folders.get(context.applicationId)
    if folder is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = _own_folders[context.applicationId] = tempfile.mkdtemp(prefix="cytogrid-")
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def broadcast_by_measure(spark: SparkSession) -> None:
    """Leave broadcasts to sizes that were measured, but for tables of up to ``BROADCAST_BYTES`` on disk.

    A plan takes the bytes of packed files for the size of a table. Ids and labels take a hundred times as much
    in a hash table, and copies that a join makes of its rows are not counted at all, so tables of a million rows were
    sent through the driver. Adaptive execution goes on to broadcast what it has measured to be below the former threshold.
    """
    planned, measured = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
    former = spark.conf.get(planned)
    number, unit = re.fullmatch(r"(-?\d+)\s*([kmgtp]?)i?b?", former.strip().lower()).groups()
    if int(number) << 10 * " kmgtp".index(unit or " ") > BROADCAST_BYTES:
        if spark.conf.get(measured, None) is None:
            spark.conf.set(measured, former)
        spark.conf.set(planned, str(BROADCAST_BYTES))


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the rows below the shared folder and go on from there.

    Loops stay flat this way: a later step depends on the written table alone, also
    after executors were lost, and the optimizer starts over with a plain scan. A
    checkpoint keeps the constraints of the plan it cuts, and deriving new ones from
    them takes longer with every turn of a loop. The tables are packed by zstd, as ids and texts take much less room so.
    """
    path = scratch_path(df.sparkSession, "cut")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread_out(df: DataFrame, *keys: str) -> DataFrame:
    """Partition by key for a function in Python.

    Adaptive execution merges small partitions by their bytes and would put many
    groups, cheap to move but dear to compute, into one task. A given number of
    partitions is left alone.
    """
    count = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(count, *keys)
