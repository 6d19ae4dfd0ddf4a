"""Representative windows: scaled feature blocks, grouped k-means, picks per cluster."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import draw_order, draw_uniform, squared_distance
from ..functions.ranking import (
    exact_quantiles,
    largest_group,
    running_counts,
)
from ..functions.skew import attach
from ..session import cut_lineage, spread_out

BLOCK_ROWS = 1024
HISTOGRAM_BINS = 4096
# Points of a group whose centres one task settles; larger groups go on together, turn by turn.
GROUP_ROWS = 16_384
# Weights of the feature blocks.
WEIGHTS = {"image": 1.0, "biomarkers": 1.0, "types": 1.0, "shape": 0.2}


def scale_columns(df: DataFrame, columns: Sequence[str], group: str = "region_id") -> DataFrame:
    """Every column over its sample deviation within the group."""
    sds = df.groupBy(group).agg(*[F.stddev_samp(c).alias(f"_sd_{c}") for c in columns])
    spread = [c for c in df.columns if c != group]
    scaled = attach(df, sds, [group], spread)
    return scaled.withColumns({c: F.try_divide(c, f"_sd_{c}") for c in columns}).drop(
        *[f"_sd_{c}" for c in columns]
    )


def _block_pairs(
    points: DataFrame, group: str, key: Sequence[str], vector: str, keep: Sequence[str] = ()
) -> DataFrame:
    """Rows copied to every pair of blocks they take part in.

    Blocks hold about ``BLOCK_ROWS`` rows, so whatever the size of a group, a task
    sees two blocks at a time.
    """
    sizes = points.groupBy(group).agg(
        F.greatest(F.ceil(F.count(F.lit(1)) / F.lit(float(BLOCK_ROWS))), F.lit(1)).alias("_blocks")
    )
    placed = attach(points, sizes, [group], list(key)).withColumn(
        "_mine", F.pmod(F.xxhash64(*key), F.col("_blocks"))
    )
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1))
    return placed.withColumn("_other", other).select(
        group,
        F.least("_mine", "_other").alias("_i"),
        F.greatest("_mine", "_other").alias("_j"),
        (F.col("_mine") > F.col("_other")).alias("_right"),
        F.col(vector).alias("_v"),
        *keep,
    )


def _distances(block: pd.DataFrame) -> np.ndarray:
    """Distances of all pairs between the two blocks, or within one block."""
    vectors = np.array(block["_v"].tolist(), dtype=float)
    if block["_i"].iat[0] == block["_j"].iat[0]:
        left = right = vectors
    else:
        side = block["_right"].to_numpy()
        left, right = vectors[~side], vectors[side]
    squares = np.zeros((len(left), len(right)))
    for d in range(vectors.shape[1]):
        squares += np.square(left[:, d, None] - right[None, :, d])
    distances = np.sqrt(squares)
    if left is right:
        return distances[np.triu_indices(len(left), 1)]
    return distances.ravel()


def pair_summary(points: DataFrame, group: str, key: Sequence[str], vector: str) -> DataFrame:
    """Number, mean and maximum of the distances between all points of a group.

    Only three numbers per pair of blocks leave a task.
    """
    kind = dict(points.dtypes)[group]

    def summarize(block: pd.DataFrame) -> pd.DataFrame:
        d = _distances(block)
        return pd.DataFrame({
            group: [block[group].iat[0]], "_n": [len(d)], "_sum": [float(d.sum())],
            "_max": [float(d.max()) if len(d) else np.nan],
        })

    blocks = spread_out(_block_pairs(points, group, key, vector), group, "_i", "_j")
    parts = blocks.groupBy(group, "_i", "_j").applyInPandas(
        summarize, f"{group} {kind}, _n bigint, _sum double, _max double"
    )
    return parts.groupBy(group).agg(
        F.sum("_n").alias("n_pairs"),
        F.try_divide(F.sum("_sum"), F.sum("_n")).alias("mean_distance"),
        F.max(F.when(~F.isnan("_max"), F.col("_max"))).alias("max_distance"),
    )


def pair_quantile(
    points: DataFrame, group: str, key: Sequence[str], vector: str, quantile: float = 0.95
) -> DataFrame:
    """Quantile over the full n x n table of distances with zeros below the diagonal.

    Groups of at most one block, by their counted size, are a single task's work.
    Otherwise pairs of blocks are, and distances are never written out. A first pass counts them per fine bin
    between zero and the diagonal of the group's bounding box. A second pass emits
    only those in the bins around the wanted ranks, and the exact values are picked
    from these, equal ones counted. Rows without a vector, or with a NULL or NaN in it, are left out.
    """
    kind = dict(points.dtypes)[group]
    points = points.where(
        F.col(vector).isNotNull() & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")))
    )
    if largest_group(points, [group]) <= BLOCK_ROWS:

        def whole(block: pd.DataFrame) -> pd.DataFrame:
            n = len(block)
            d = _distances(block.assign(_v=block[vector], _i=0, _j=0))
            table = np.concatenate([np.zeros(n * n - len(d)), d])
            return pd.DataFrame({group: [block[group].iat[0]], "scale": [float(np.quantile(table, quantile))]})

        return spread_out(points.select(group, vector), group).groupBy(group).applyInPandas(
            whole, f"{group} {kind}, scale double"
        )
    first = points.select(F.size(vector)).first()
    dims = first[0] if first else 0
    box = points.groupBy(group).agg(
        F.count(F.lit(1)).alias("_n"),
        F.sqrt(sum(
            (F.power(F.max(F.get(vector, F.lit(i))) - F.min(F.get(vector, F.lit(i))), F.lit(2))
             for i in range(dims)), F.lit(0.0))).alias("_far"),
    )
    box = cut_lineage(box)
    limits = box.select(group, (F.col("_far") * 1.0000001 + 1e-12).alias("_far"))
    bounded = attach(points, limits, [group], list(key))
    pairs = spread_out(_block_pairs(bounded, group, key, vector, ["_far"]), group, "_i", "_j")

    def count_bins(block: pd.DataFrame) -> pd.DataFrame:
        far = float(block["_far"].iat[0])
        bins = np.floor(_distances(block) / far * HISTOGRAM_BINS).astype(np.int64)
        found, counts = np.unique(bins, return_counts=True)
        return pd.DataFrame({group: block[group].iat[0], "_bin": found, "_count": counts})

    binned = pairs.groupBy(group, "_i", "_j").applyInPandas(
        count_bins, f"{group} {kind}, _bin bigint, _count bigint"
    ).groupBy(group, "_bin").agg(F.sum("_count").alias("_count"))
    upto = Window.partitionBy(group).orderBy("_bin").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)  # HISTOGRAM_BINS rows at most
    size = F.col("_n").cast("double")
    rank = (size * size - 1) * F.lit(float(quantile))
    # Ranks among the pairs: the zeros of the lower triangle and the diagonal come first.
    zeros = size * (size + 1) / 2
    wanted = box.select(group, F.floor(rank - zeros).alias("_low"), F.ceil(rank - zeros).alias("_high"),
                        (rank - F.floor(rank)).alias("_share"))
    ranked = binned.withColumn("_upto", F.sum("_count").over(upto)).join(wanted, group)
    around = cut_lineage(ranked.where(
        (F.col("_upto") > F.col("_low")) & (F.col("_upto") - F.col("_count") <= F.col("_high"))
    ).groupBy(group).agg(
        F.min("_bin").alias("_first"), F.max("_bin").alias("_last"),
        F.min(F.col("_upto") - F.col("_count")).alias("_before"),
    ))

    def emit(block: pd.DataFrame) -> pd.DataFrame:
        d = _distances(block)
        bins = np.floor(d / float(block["_far"].iat[0]) * HISTOGRAM_BINS)
        d = d[(bins >= block["_first"].iat[0]) & (bins <= block["_last"].iat[0])]
        values, counts = np.unique(d, return_counts=True)
        return pd.DataFrame({group: block[group].iat[0], "value": values, "_count": counts})

    sought = _block_pairs(
        attach(bounded, around.drop("_before"), [group], list(key)),
        group, key, vector, ["_far", "_first", "_last"],
    )
    near = cut_lineage(
        spread_out(sought, group, "_i", "_j").groupBy(group, "_i", "_j").applyInPandas(
            emit, f"{group} {kind}, value double, _count bigint"
        )
    )
    counted = running_counts(near, [group], weight="_count")
    counted = counted.join(wanted, group).join(around, group)
    end = F.col("_before") + F.col("n_below") + F.col("n_at")
    picked = counted.groupBy(group).agg(
        F.min(F.when(end > F.col("_low"), F.col("value"))).alias("_a"),
        F.min(F.when(end > F.col("_high"), F.col("value"))).alias("_b"),
    )
    share = F.col("_share")
    low = F.when(F.col("_low") < 0, 0.0).otherwise(F.col("_a"))
    high = F.when(F.col("_high") < 0, 0.0).otherwise(F.col("_b"))
    return wanted.join(picked, group, "left").select(
        group, F.coalesce(low + (high - low) * share, F.lit(0.0)).alias("scale")
    )


def combine_blocks(
    blocks: dict[str, DataFrame], key: Sequence[str], weights: dict[str, float] | None = None
) -> DataFrame:
    """One feature vector per window: blocks scaled by weight over their distance level.

    Each block holds the key (with ``region_id``) and an array column ``block``.
    """
    weights = WEIGHTS if weights is None else weights
    spread = [k for k in key if k != "region_id"]
    combined, names = None, sorted(blocks)
    for name in names:
        block = cut_lineage(blocks[name].select(*key, "block"))
        level = pair_quantile(block, "region_id", list(key), "block")
        factor = F.coalesce(F.try_divide(F.lit(float(weights.get(name, 1.0))), F.col("scale")), F.lit(0.0))
        scaled = attach(block, level, ["region_id"], spread).select(
            *key, F.transform("block", lambda v: v * factor).alias(name)
        )
        combined = scaled if combined is None else combined.join(scaled, list(key))
    return combined.select(*key, F.concat(*names).alias("features"))


def _center_distances(point: Sequence[Column], centers: Column) -> Column:
    return F.transform(
        centers,
        lambda c: F.struct(
            squared_distance(point, [F.get(c["center"], F.lit(i)) for i in range(len(point))]).alias("d"),
            c["_label"].alias("label"),
        ),
    )


def settled_centers(block: pd.DataFrame, groups: Sequence[str], k: int, iterations: int) -> pd.DataFrame:
    """The centres of a group as one row, by the turns of ``grouped_kmeans``; ``_moved`` if they did not settle."""
    at = np.array(block["_at"].tolist(), dtype=float)
    labels = np.arange(min(k, len(at)))
    centers = at[np.argsort(block["_turn"].to_numpy())[: len(labels)]]
    moved = True
    for _ in range(iterations - 1):  # the last turn only finds that all have settled
        squares = np.zeros((len(at), len(centers)))
        for d in range(at.shape[1]):
            squares += np.square(at[:, d, None] - centers[None, :, d])
        near = squares.argmin(1)
        counts = np.bincount(near, minlength=len(centers))
        there = np.flatnonzero(counts)
        sums = [np.bincount(near, at[:, d], len(centers))[there] for d in range(at.shape[1])]
        fresh = np.round(np.stack(sums, 1) / counts[there, None], 9)
        moved = len(there) < len(centers) or bool((fresh != centers).any())
        labels, centers = labels[there], fresh
        if not moved:
            break
    packed = [{"_label": int(i), "center": c.tolist()} for i, c in zip(labels, centers)]
    return pd.DataFrame({**{c: block[c].iloc[:1] for c in groups}, "_centers": [packed], "_moved": [moved]})


def grouped_kmeans(
    points: DataFrame,
    groups: Sequence[str],
    key: Sequence[str],
    vector: str,
    k: int,
    iterations: int = 500,
    seed: int = 123,
    name: str = "cluster",
) -> DataFrame:
    """k-means inside every group, all groups in step; centres start at drawn points.

    Groups of up to ``GROUP_ROWS`` points are settled inside tasks, a group by one task. The others, and
    those with missing numbers, take turns together: a group's ``k`` centres travel as one row; points are spread over tasks, and new
    centres are partial sums. Groups with fewer than ``k`` points get fewer clusters.
    It goes on until no centre moves; a group that has settled is left alone from then on.
    More than ``iterations`` turns raise.
    """
    head = points.select(F.size(vector)).first()
    dims = head[0] if head else 0
    groups, key = list(groups), list(key)
    draw = Window.partitionBy(*groups).orderBy(
        draw_order(seed, *[F.col(c) for c in [*groups, *key]]), *key
    )
    odd = F.col(vector).isNull() | (F.size(vector) != dims) | F.exists(
        vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x) == float("inf")))
    sizes = cut_lineage(points.groupBy(*groups).agg(
        ((F.count(F.lit(1)) > GROUP_ROWS) | F.max(odd)).alias("_crowded")))
    alone, rest = points, points.where("false")
    if not sizes.where("_crowded").isEmpty():
        known = attach(points, sizes, groups, [k for k in key if k not in groups])
        alone, rest = known.where("NOT _crowded").drop("_crowded"), known.where("_crowded").drop("_crowded")
    start = (
        rest.withColumn("_turn", F.row_number().over(draw)).where(F.col("_turn") <= k)
        .select(*groups, (F.col("_turn") - 1).alias("_label"), F.col(vector).alias("center"))
    )

    def packed(centers: DataFrame) -> DataFrame:
        return centers.groupBy(*groups).agg(
            F.sort_array(F.collect_list(F.struct("_label", "center"))).alias("_centers")  # k at most
        )

    coordinates = [F.get(vector, F.lit(i)) for i in range(dims)]

    def assign(centers: DataFrame) -> DataFrame:
        near = F.array_min(_center_distances(coordinates, F.col("_centers")))
        return attach(points, centers, groups, [k for k in key if k not in groups]).withColumn(
            name, near["label"]
        )

    turned = spread_out(alone, *groups).withColumn("_turn", F.row_number().over(draw))
    turned = turned.where(" AND ".join(f"`{c}` IS NOT NULL" for c in groups)).select(
        *groups, F.col(vector).cast("array<double>").alias("_at"), "_turn")
    kinds = ", ".join(f"`{c}` {t}" for c, t in turned.dtypes if c in groups)
    settled = turned.groupBy(*groups).applyInPandas(
        lambda block: settled_centers(block, groups, k, iterations),
        f"{kinds}, _centers array<struct<_label: int, center: array<double>>>, _moved boolean")
    state = cut_lineage(settled.unionByName(packed(start).withColumn("_moved", F.lit(True))))
    if not state.where("_moved").join(sizes.where("NOT _crowded"), groups).isEmpty():
        raise RuntimeError(f"k-means did not settle in {iterations} turns")
    for _ in range(iterations):
        moving = state.where("_moved").drop("_moved")
        if moving.isEmpty():
            return assign(state.drop("_moved")).drop("_centers")
        means = assign(moving).groupBy(*groups, name).agg(
            *[F.round(F.avg(c), 9).alias(f"_c{i}") for i, c in enumerate(coordinates)]
        )
        fresh = means.select(
            *groups, F.col(name).alias("_label"),
            F.array(*[f"_c{i}" for i in range(dims)]).alias("center"),
        )
        moved = packed(fresh).join(moving.withColumnRenamed("_centers", "_old"), groups)
        moved = moved.withColumn("_moved", F.col("_centers") != F.col("_old")).drop("_old")
        state = cut_lineage(state.where("NOT _moved").unionByName(moved))
    raise RuntimeError(f"k-means did not settle in {iterations} turns")


def cluster_medians(points: DataFrame, groups: Sequence[str], vector: str = "features") -> DataFrame:
    """Element-wise median of every group's vectors, as long rows."""
    long = points.select(*groups, F.posexplode(vector).alias("dim", "value"))
    return exact_quantiles(long, [*groups, "dim"], {"median": 0.5})


def _median_distances(points: DataFrame, groups: Sequence[str], key: Sequence[str]) -> DataFrame:
    """Distance of every point to its group's median, groups of sufficient size known by ``_n``."""
    entry = F.sort_array(F.collect_list(F.struct("dim", "median")))
    medians = cluster_medians(points, groups).groupBy(*groups).agg(
        F.transform(entry, lambda e: e["median"]).alias("_median")
    )
    sizes = points.groupBy(*groups).agg(F.count(F.lit(1)).alias("_n"))
    squares = F.zip_with("features", "_median", lambda a, b: (a - b) * (a - b))
    spread = [k for k in key if k not in groups]
    return attach(points, medians.join(sizes, list(groups)), list(groups), spread).withColumn(
        "distance", F.round(F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, v: s + v)), 9)
    ).drop("_median")


def pick_representatives(
    points: DataFrame,
    groups: Sequence[str],
    key: Sequence[str],
    n_samples: int = 1,
    method: str = "center",
    temp: float = 1.0,
    seed: int = 123,
) -> DataFrame:
    """Members that stand for each cluster; clusters below ``max(4, 2 n)`` are skipped.

    ``center`` takes the members nearest to the median. ``sample`` draws without
    replacement, by weights that rise towards the median and are zero for the far
    half: the largest of ``log(u) / w`` win, with ``u`` a hash of the member.
    """
    far = cut_lineage(_median_distances(points, groups, key).where(
        F.col("_n") >= max(4, 2 * n_samples)
    ))
    groups, key = list(groups), list(key)
    rank = Window.partitionBy(*groups).orderBy("distance", *key)
    if method == "center":
        chosen = far.withColumn("_turn", F.row_number().over(rank)).where(F.col("_turn") <= n_samples)
    elif method == "sample":
        near = far.withColumn("_near", 1.0 / (F.col("distance") + 1e-5))
        middle = exact_quantiles(near, groups, {"_middle": 0.5}, value="_near")
        weighed = attach(near, middle, groups, [k for k in key if k not in groups]).withColumn(
            "_w", F.power(F.greatest(F.col("_near") - F.col("_middle"), F.lit(0.0)), F.lit(2.0 / temp))
        )
        ticket = F.log(draw_uniform(seed, *[F.col(c) for c in [*groups, *key]])) / F.col("_w")
        best = Window.partitionBy(*groups).orderBy(F.desc("_ticket"), *key)
        chosen = (
            weighed.where(F.col("_w") > 0).withColumn("_ticket", ticket)
            .withColumn("_turn", F.row_number().over(best)).where(F.col("_turn") <= n_samples)
            .drop("_near", "_middle", "_w", "_ticket")
        )
    else:
        raise ValueError(f"unknown method {method}")
    return chosen.drop("_turn", "_n").withColumn("position", F.row_number().over(rank))


def mosaic(
    blocks: dict[str, DataFrame],
    centers: DataFrame,
    key: Sequence[str],
    n_clusters: int = 10,
    n_subclusters: int = 2,
    n_samples: int = 2,
    method: str = "sample",
    temp: float = 1.0,
    seed: int = 123,
    weights: dict[str, float] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Clusters of a region's windows by features, then by place, and representatives.

    ``centers`` holds the key with ``center_x, center_y``.
    """
    features = cut_lineage(combine_blocks(blocks, key, weights))
    clustered = grouped_kmeans(features, ["region_id"], key, "features", n_clusters, seed=seed)
    place = F.array("center_x", "center_y").alias("place")
    placed = cut_lineage(clustered.join(centers.select(*key, place), list(key)))
    final = cut_lineage(grouped_kmeans(
        placed, ["region_id", "cluster"], key, "place", n_subclusters, seed=seed, name="subcluster"
    ).drop("place"))
    groups = ["region_id", "cluster", "subcluster"]
    return final, pick_representatives(final, groups, key, n_samples, method, temp, seed)


def retrieve_similar(
    points: DataFrame, pivots: DataFrame, key: Sequence[str], low: float = 0.1, high: float = 0.8
) -> DataFrame:
    """Members of the pivots' clusters by distance to the nearest other pivot.

    Members beyond the ``high`` quantile are dropped; the score falls from 1 to 0
    between the two quantiles.
    """
    key = list(key)
    names = [F.col(k).alias(f"_p_{k}") for k in key]
    sought = pivots.select(*names, F.col("features").alias("_p"), "region_id", "cluster")
    squares = F.zip_with("features", "_p", lambda a, b: (a - b) * (a - b))
    same = F.lit(True)
    for k in key:
        same = same & (F.col(k) == F.col(f"_p_{k}"))
    nearest = (
        points.join(sought, ["region_id", "cluster"]).where(~same)
        .withColumn("distance", F.round(F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, v: s + v)), 9))
        .groupBy("region_id", "cluster", *[k for k in key if k not in ("region_id", "cluster")])
        .agg(F.min("distance").alias("distance"))
    )
    cuts = exact_quantiles(nearest, ["region_id"], {"_low": low, "_high": high}, value="distance")
    spread = [k for k in key if k != "region_id"]
    kept = attach(nearest, cuts, ["region_id"], spread).where(F.col("distance") < F.col("_high"))
    part = F.try_divide(F.col("distance") - F.col("_low"), F.col("_high") - F.col("_low"))
    score = 1.0 - F.least(F.greatest(part, F.lit(0.0)), F.lit(1.0))
    return kept.withColumn("score", score).drop("_low", "_high")
