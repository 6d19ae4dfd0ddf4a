"""Sliding windows over the cells of a region, and reference patches drawn from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import draw_order, draw_uniform, present
from ..functions.skew import attach
from ..schema import PATCH
from ..session import cut_lineage
from .features import RANK_DIGITS


def window_origins(
    cells: DataFrame,
    size: int = 128,
    stride_ratio: float = 0.5,
    repeats: int = 2,
    seed: int = 123,
) -> DataFrame:
    """Random lower-left corners per region: ``min - stride`` plus up to ``size - 1``."""
    stride = int(size * stride_ratio)
    corners = cells.groupBy("region_id").agg(F.min("x").alias("_x"), F.min("y").alias("_y"))
    rounds = corners.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))

    def start(corner: str) -> Column:
        shift = draw_uniform(seed, F.lit(corner), F.lit(size), F.col("region_id"), F.col("repeat"))
        low = F.col(corner) - stride + F.floor(shift * size)
        return F.when(low < 0, F.ceil(low)).otherwise(F.floor(low)).cast("long")

    return rounds.select(
        "region_id", "repeat", start("_x").alias("x_start"), start("_y").alias("y_start")
    )


def region_origins(cells: DataFrame, size: int = 128, stride_ratio: float = 0.5) -> DataFrame:
    """One lower-left corner per region, a stride below its own minimum."""
    stride = int(size * stride_ratio)
    return cells.groupBy("region_id").agg(
        *[(F.floor(F.min(c)) - stride).cast("long").alias(f"{c}_start") for c in ("x", "y")]
    )


def _covering(position: Column, start: Column, size: int, stride: int, bounded: bool) -> Column:
    """One row per window along one axis that holds the position, edges included.

    ``bounded``: no window lies below the start; else windows go on on either side of it.
    """
    first = F.ceil((position - start - size) / F.lit(float(stride))).cast("long")
    if bounded:
        first = F.greatest(first, F.lit(0).cast("long"))
    last = F.floor((position - start) / F.lit(float(stride))).cast("long")
    return F.explode(F.when(last >= first, F.sequence(first, last)))


def window_members(
    cells: DataFrame,
    size: int = 128,
    stride_ratio: float = 0.5,
    origin: tuple[int, int] | DataFrame | None = None,
    keep: Sequence[str] = (),
) -> DataFrame:
    """One row per (window, cell), without limits on the window's cell count.

    The windows a cell falls in follow from its coordinates, so no join against
    the windows is needed and empty windows cost nothing. ``origin`` is a table of
    corners per region (:func:`region_origins`, which is also the default, or
    :func:`window_origins`), or one corner for all regions; the grid of such a corner goes
    on below it, so cells anywhere have windows.
    """
    if origin is None:
        origin = region_origins(cells, size, stride_ratio)
    stride = int(size * stride_ratio)
    base = cells.where(F.col("x").isNotNull() & F.col("y").isNotNull())
    if isinstance(origin, DataFrame):
        starts = origin.groupBy("region_id").agg(
            F.collect_set(F.struct("x_start", "y_start")).alias("_starts")  # one per repeat
        )
        base = attach(base, starts, ["region_id"], ["cell_id"]).withColumn(
            "_start", F.explode("_starts")
        )
        x_start, y_start = F.col("_start.x_start"), F.col("_start.y_start")
    else:
        x_start, y_start = (F.lit(o).cast("long") for o in origin)
    bounded = isinstance(origin, DataFrame)
    members = (
        base.withColumn("_ix", _covering(F.col("x"), x_start, size, stride, bounded))
        .withColumn("_iy", _covering(F.col("y"), y_start, size, stride, bounded))
        .withColumn("x0", x_start + F.col("_ix") * stride)
        .withColumn("y0", y_start + F.col("_iy") * stride)
        .withColumn("patch_size", F.lit(size))
        .select(*PATCH, "cell_id", *[F.col(f"`{c}`") for c in keep])
    )
    # Grids of two repeats may share windows.
    return members.dropDuplicates([*PATCH, "cell_id"]) if bounded else members


def cap_members(
    members: DataFrame, n_min: int = 5, n_max: int = 50, seed: int = 123
) -> DataFrame:
    """Drop windows below ``n_min`` cells, draw ``n_max`` cells from those above it.

    The limit on the row number is applied before the shuffle as well, so even a
    window over a third of all cells reaches its task as a few draws per input
    split. ``n_cells`` counts the cells kept.
    """
    draw = Window.partitionBy(*PATCH).orderBy(
        draw_order(seed, F.col("x0"), F.col("y0"), F.col("cell_id")), "cell_id"
    )
    kept = members.withColumn("_draw", F.row_number().over(draw)).where(F.col("_draw") <= n_max)
    return (
        kept.withColumn("n_cells", F.count(F.lit(1)).over(Window.partitionBy(*PATCH)))
        .where(F.col("n_cells") >= n_min)
        .drop("_draw")
    )


def sliding_windows(
    cells: DataFrame,
    sizes: Sequence[int] = (128,),
    stride_ratio: float = 0.5,
    origin: tuple[int, int] | DataFrame | None = None,
    repeats: int = 0,
    seed: int = 123,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Membership of all windows of the given sizes, not yet limited in cell count.

    Without an ``origin`` every region starts at its own minimum, or at ``repeats`` random
    corners per size near it. Pass the result to :func:`window_averages` for statistics or :func:`cap_members` for ids.
    """
    parts = []
    for size in sizes:
        corner = (
            window_origins(cells, size, stride_ratio, repeats, seed)
            if origin is None and repeats
            else origin
        )
        parts.append(window_members(cells, size, stride_ratio, corner, keep))
    members = parts[0]
    for part in parts[1:]:
        members = members.unionByName(part)
    return members


def window_averages(
    members: DataFrame,
    columns: Sequence[str],
    n_min: int = 5,
    n_max: int | None = None,
    seed: int = 123,
) -> DataFrame:
    """Number of cells and mean of every column per window, one wide row each.

    All cells of a window count, unless ``n_max`` asks for a draw. Then windows up to ``n_max`` cells, nearly all of them, are plain aggregates with
    partial sums before the shuffle. They are written once; the members are read
    again only if there are crowded windows, to draw from these.
    """

    def averages(rows: DataFrame) -> DataFrame:
        means = [F.round(F.avg(present(F.col(f"`{c}`").cast("double"))), RANK_DIGITS).alias(c)
                 for c in columns]
        return rows.groupBy(*PATCH).agg(F.count(F.lit(1)).alias("n_cells"), *means)

    if n_max is None:
        return averages(members).where(F.col("n_cells") >= n_min)
    every = cut_lineage(averages(members))
    plain = every.where(F.col("n_cells").between(n_min, n_max))
    crowded = every.where(F.col("n_cells") > n_max).select(*PATCH)
    if crowded.isEmpty():
        return plain
    drawn = cap_members(attach(members, crowded, PATCH, ["cell_id"]), n_min, n_max, seed)
    return plain.unionByName(averages(drawn.drop("n_cells")))


def describe_windows(members: DataFrame, n_min: int = 5, n_max: int | None = None) -> DataFrame:
    """One row per window: rectangle, centre, name and number of cells (those drawn, if capped)."""
    x1, y1 = F.col("x0") + F.col("patch_size"), F.col("y0") + F.col("patch_size")
    return (
        members.groupBy(*PATCH)
        .agg(F.count(F.lit(1)).alias("n_cells"))
        .where(F.col("n_cells") >= n_min)
        .withColumn("n_cells", F.least("n_cells", F.lit(n_max).cast("long")))
        .withColumn("x1", x1)
        .withColumn("y1", y1)
        .withColumn("center_x", (F.col("x0") + F.col("x1")) / F.lit(2.0))
        .withColumn("center_y", (F.col("y0") + F.col("y1")) / F.lit(2.0))
        .withColumn("patch_name", F.concat_ws("-", "x0", "x1", "y0", "y1"))
    )


def reference_patches(members: DataFrame, count: int | None = None, seed: int = 123) -> DataFrame:
    """Membership of the reference windows, optionally ``count`` draws per region.

    Windows are distinct, so there is nothing to gain from repeating them; with
    fewer than ``count`` windows in a region all of them are used.
    """
    if count is None:
        return members
    # One row per window before drawing; the draw is a top-n, limited before its shuffle.
    draw = Window.partitionBy("region_id").orderBy(
        draw_order(seed, F.col("patch_size"), F.col("x0"), F.col("y0")), "patch_size", "x0", "y0"
    )
    drawn = (
        members.groupBy(*PATCH)
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_draw", F.row_number().over(draw))
        .where(F.col("_draw") <= count)
        .select(*PATCH)
    )
    return members.join(drawn, list(PATCH), "left_semi")
