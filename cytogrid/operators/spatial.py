"""Densities by an equi-join over a grid, edges between nearest neighbours, and neighbourhoods."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import squared_distance
from .nearest import nearest_neighbors


def _tile(c: Column, side: Column) -> Column:
    return F.floor(c / side).cast("long")


def _around(c: Column, side: Column) -> Column:
    """The tile of a coordinate and its two neighbours."""
    at = _tile(c, side)
    return F.explode(F.sequence(at - 1, at + 1))


def radius_counts(cells: DataFrame, radius: float = 70.0) -> DataFrame:
    """Number of other cells of the region within ``radius``, the rim included.

    The searched side holds one row per distinct position with its cell count, so
    copies at one spot cost one row; pairs are added up as they are matched and
    are never written out.
    """
    side = F.lit(float(radius))
    places = (
        cells.groupBy("region_id", F.col("x").alias("_px"), F.col("y").alias("_py"))
        .agg(F.count(F.lit(1)).alias("_cells"))
        .withColumn("_tx", _around(F.col("_px"), side))
        .withColumn("_ty", _around(F.col("_py"), side))
    )
    probes = (
        cells.select("region_id", "cell_id", "x", "y")
        .withColumn("_tx", _tile(F.col("x"), side))
        .withColumn("_ty", _tile(F.col("y"), side))
    )
    near = squared_distance([F.col("x"), F.col("y")], [F.col("_px"), F.col("_py")]) <= F.lit(
        float(radius) * float(radius)
    )
    return (
        probes.join(places, ["region_id", "_tx", "_ty"])
        .where(near)
        .groupBy("region_id", "cell_id")
        .agg((F.sum("_cells") - 1).alias("local_density"))
    )


def mean_neighbor_distance(cells: DataFrame, k: int = 3) -> DataFrame:
    """Mean distance to the ``k`` nearest cells; NULL where a region has fewer others."""
    near = nearest_neighbors(cells, ["x", "y"], k)
    means = near.groupBy("region_id", "cell_id").agg(
        F.when(F.count(F.lit(1)) >= k, F.avg("distance")).alias("mean_k_neighbor_distance")
    )
    return cells.select("region_id", "cell_id").join(means, ["region_id", "cell_id"], "left")


def cell_densities(cells: DataFrame, k: int = 3, radius: float = 70.0) -> DataFrame:
    """Both density measures of every cell, over the whole region."""
    return mean_neighbor_distance(cells, k).join(
        radius_counts(cells, radius), ["region_id", "cell_id"], "left"
    )


def undirected(neighbors: DataFrame, kind: str) -> DataFrame:
    """Neighbour rows as an edge table with both directions."""
    forth = neighbors.select("region_id", F.col("cell_id").alias("src"), F.col("neighbor").alias("dst"))
    back = forth.select("region_id", F.col("dst").alias("src"), F.col("src").alias("dst"))
    return forth.unionByName(back).distinct().withColumn("kind", F.lit(kind))


def spatial_edges(cells: DataFrame, k: int = 6, max_distance: float | None = 70.0) -> DataFrame:
    """Edges to the ``k`` nearest cells, no longer than ``max_distance``."""
    near = nearest_neighbors(cells, ["x", "y"], k)
    if max_distance is not None:
        near = near.where(F.col("distance") <= max_distance)
    return undirected(near, "spatial")


def feature_edges(features: DataFrame, columns: Sequence[str], k: int = 4) -> DataFrame:
    """Edges to the ``k`` cells of the region with the most similar features."""
    return undirected(nearest_neighbors(features, columns, k), "feature")


def _ends(seeds: DataFrame, edges: DataFrame, hops: int) -> DataFrame:
    """(region, seed, ``_ends``): nodes at the end of paths of up to ``hops`` edges, once each, as one list per seed.

    Lists of neighbours travel, not a row per path; each turn goes on from the last one's ends only.
    """
    key = ["region_id", "seed"]
    lists = edges.groupBy("region_id", F.col("src").alias("node")).agg(F.collect_set("dst").alias("_to"))
    found = last = seeds.join(lists.withColumnRenamed("node", "seed"), key).withColumnRenamed("_to", "_ends")
    for _ in range(hops - 1):
        steps = last.select(*key, F.explode("_ends").alias("node")).join(lists, ["region_id", "node"])
        last = steps.groupBy(*key).agg(F.array_distinct(F.flatten(F.collect_list("_to"))).alias("_ends"))
        both = found.join(last.withColumnRenamed("_ends", "_further"), key, "left")
        found = both.select(*key, F.array_union("_ends", F.coalesce("_further", F.slice("_ends", 1, 0))).alias("_ends"))
    return found


def local_neighborhoods(
    seeds: DataFrame, edges: DataFrame, n_spatial: int = 1, n_feature: int = 0
) -> DataFrame:
    """Cells within ``n_spatial`` hops on spatial or ``n_feature`` on feature edges.

    ``seeds`` holds ``region_id, cell_id``; the seed belongs to its neighbourhood, which is put together as one list.
    """
    key = ["region_id", "seed"]
    found = seeds.select("region_id", F.col("cell_id").alias("seed")).distinct()
    start, lists = found, [F.array("seed")]
    for kind, hops in (("spatial", n_spatial), ("feature", n_feature)):
        if hops:
            ends = _ends(start, edges.where(F.col("kind") == kind), hops).withColumnRenamed("_ends", f"_{kind}")
            found = found.join(ends, key, "left")
            lists.append(F.coalesce(f"_{kind}", F.array().cast(dict(ends.dtypes)[f"_{kind}"])))
    return found.select(*key, F.explode(F.array_distinct(F.concat(*lists))).alias("node"))
