"""Group statistics to categories, flags and text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import fixed, present
from ..functions.ranking import score_against
from .features import (
    RANK_DIGITS,
    circular_means,
    enrichment,
    group_averages,
    means_to_long,
    signature_biomarkers,
    signature_lists,
)

DENSITY_FEATURES = ("mean_k_neighbor_distance", "local_density", "size_area")
SHAPE_FEATURES = ("shape_circularity", "shape_eccentricity", "shape_solidity")


def biomarker_summary(
    targets: DataFrame, references: DataFrame, keys: Sequence[str], columns: Sequence[str]
) -> DataFrame:
    """z-score and percentile of each target's biomarker means among the reference
    groups of its region. Biomarkers without spread are left out.

    ``targets`` holds cells, ``references`` one wide row of means per patch.
    """
    return score_against(
        means_to_long(references, ["region_id"], columns),
        group_averages(targets, keys, columns),
        ["region_id", "biomarker"],
    ).where(F.col("z").isNotNull())


def biomarker_categories(
    summary: DataFrame,
    keys: Sequence[str],
    z_threshold: float = 1.5,
    percentile_threshold: float = 95.0,
    top_k: int = 2,
) -> DataFrame:
    """Add the position by z and one of ``high``, ``low``, ``moderate``."""
    by_z = Window.partitionBy(*keys).orderBy(F.desc("z"), "biomarker")  # one row per biomarker
    high = (
        (F.col("z") > z_threshold)
        | (F.col("percentile") > percentile_threshold)
        | (F.col("position") <= top_k)
    )
    low = (F.col("z") < -z_threshold) | (F.col("percentile") < 100 - percentile_threshold)
    return summary.withColumn("position", F.row_number().over(by_z)).withColumn(
        "category", F.when(high, "high").when(low, "low").otherwise("moderate")
    )


def biomarker_text(
    categories: DataFrame,
    keys: Sequence[str],
    include_high: bool = True,
    include_low: bool = True,
    include_others: bool = True,
) -> DataFrame:
    """One paragraph per group; a group holds one row per biomarker at most."""
    entry = F.struct("position", "category", "biomarker", "z", "percentile")
    grouped = categories.groupBy(*keys).agg(F.sort_array(F.collect_list(entry)).alias("_rows"))

    def rows_of(category: str) -> Column:
        return F.filter("_rows", lambda r: r["category"] == category)

    def line(r: Column) -> Column:
        return F.concat(
            F.lit("- **"), r["biomarker"], F.lit("**: z "), fixed(r["z"], 1),
            F.lit(", percentile "), fixed(r["percentile"], 0),
        )

    def section(rows: Column, head: str, body: Column) -> Column:
        return F.when(F.size(rows) > 0, F.concat(F.lit(head), body))

    high, low, other = rows_of("high"), F.reverse(rows_of("low")), rows_of("moderate")
    parts = []
    if include_high:
        parts.append(section(high, "**High biomarkers** (above most reference patches):\n",
                             F.array_join(F.transform(high, line), "\n")))
    if include_low:
        parts.append(section(low, "**Low biomarkers** (below most reference patches):\n",
                             F.array_join(F.transform(low, line), "\n")))
    if include_others:
        names = F.transform(other, lambda r: F.concat(F.lit("**"), r["biomarker"], F.lit("**")))
        parts.append(section(other, "**Moderate biomarkers** (no clear trend):\n",
                             F.array_join(names, ", ")))
    text = F.concat_ws("\n\n", *parts) if parts else F.lit("")
    return grouped.select(*keys, text.alias("bm_text"))


def cell_type_summary(
    targets: DataFrame, cells: DataFrame, keys: Sequence[str], columns: Sequence[str]
) -> DataFrame:
    """Percent, enrichment and signature biomarkers of each type present in a target."""
    shares = enrichment(targets, cells, keys)
    signatures = signature_lists(signature_biomarkers(cells, columns))
    return shares.join(signatures, ["region_id", "cell_type"], "left").select(
        *keys,
        "cell_type",
        (F.col("share") * 100).alias("percent"),
        "enrichment",
        F.coalesce("signature", F.array().cast("array<string>")).alias("signature"),
    )


def key_cell_types(
    summary: DataFrame, keys: Sequence[str], n_key: int = 3, digits: int = 9
) -> DataFrame:
    """The most frequent types, then the most enriched ones not among them.

    The 0.05 is in percent: it keeps types with more than 0.05 % of the cells.
    """
    percent, enriched = F.round("percent", digits), F.round("enrichment", digits)
    by_share = Window.partitionBy(*keys).orderBy(F.desc(percent), "cell_type")
    by_enrichment = Window.partitionBy(*keys).orderBy(F.desc(enriched), "cell_type")
    ranked = (
        summary.withColumn("_share_rank", F.row_number().over(by_share))
        .withColumn("_enrichment_rank", F.row_number().over(by_enrichment))
        .where(F.col("percent") > 0.05)
    )
    frequent = F.col("_share_rank") <= n_key
    chosen = ranked.where(
        frequent | ((F.col("_enrichment_rank") <= n_key) & (F.col("enrichment") > 1.5))
    )
    order = Window.partitionBy(*keys).orderBy(
        F.when(frequent, F.col("_share_rank")).otherwise(n_key + F.col("_enrichment_rank"))
    )
    return chosen.withColumn("position", F.row_number().over(order)).drop(
        "_share_rank", "_enrichment_rank"
    )


def cell_type_text(key_types: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One numbered list of key cell types per group."""
    entry = F.struct("position", "cell_type", "percent", "enrichment", "signature")
    grouped = key_types.groupBy(*keys).agg(F.sort_array(F.collect_list(entry)).alias("_rows"))

    def line(r: Column) -> Column:
        marks = F.when(
            F.size(r["signature"]) > 0,
            F.concat(F.lit(" Marked by "), F.array_join(r["signature"], ", "), F.lit(".")),
        ).otherwise(F.lit(""))
        return F.concat(
            r["position"].cast("string"), F.lit(". **"), r["cell_type"], F.lit("**: "),
            fixed(r["percent"], 0), F.lit("% of the cells, "), fixed(r["enrichment"], 1),
            F.lit(" times the region's share."), marks,
        )

    lines = F.array_join(F.transform("_rows", line), "\n")
    return grouped.select(*keys, F.concat(F.lit("**Main cell types**:\n"), lines).alias("ct_text"))


def segmentation_summary(
    targets: DataFrame,
    references: DataFrame,
    keys: Sequence[str],
    strict: bool = True,
) -> DataFrame:
    """Wide row per target: value, z and percentile of density, spacing and area,
    plain means of the shape features, circular statistics of the orientation.

    ``targets`` holds cells with the features as columns, ``references`` one wide
    row of means per patch. With ``strict=False`` shape and
    orientation columns may be missing and are left out of the result.
    """
    features = list(DENSITY_FEATURES)
    shapes = [c for c in SHAPE_FEATURES if strict or c in targets.columns]
    angles = strict or "orientation" in targets.columns
    means = [F.round(F.avg(present(F.col(c).cast("double"))), RANK_DIGITS).alias(c) for c in features]
    means += [F.avg(present(F.col(c).cast("double"))).alias(c) for c in shapes]
    if angles:
        mean_angle, variance = circular_means(F.col("orientation"))
        means += [mean_angle.alias("mean_orientation"), variance.alias("circular_variance")]
    base = targets.groupBy(*keys).agg(*means)
    scored = score_against(
        means_to_long(references, ["region_id"], features),
        means_to_long(base, keys, features),
        ["region_id", "biomarker"],
    ).where(F.col("z").isNotNull())
    wide = scored.groupBy(*keys).agg(
        *[
            F.max(F.when(F.col("biomarker") == f, F.col(c))).alias(f"{f}_{name}")
            for f in features
            for c, name in (("value", "val"), ("z", "z"), ("percentile", "pct"))
        ]
    )
    return base.drop(*features).join(wide, list(keys), "left")


def segmentation_flags(summary: DataFrame) -> DataFrame:
    """Categorical notes on a segmentation summary, NULL where the value is missing."""

    def side(c: str, low: str, high: str) -> Column:
        z = F.col(f"{c}_z")
        return F.when(z <= -1, low).when(z >= 1, high).when(z.isNotNull(), "typical")

    flags = {
        "size_note": side("size_area", "smaller", "larger"),
        "spacing_note": side("mean_k_neighbor_distance", "shorter", "longer"),
        "density_note": side("local_density", "sparser", "denser"),
    }
    columns = summary.columns
    if "shape_circularity" in columns:
        c = F.col("shape_circularity")
        flags["circularity_note"] = F.when(c < 0.5, "elongated or irregular").when(
            c.isNotNull(), "none")
    if "shape_eccentricity" in columns:
        c = F.col("shape_eccentricity")
        flags["eccentricity_note"] = F.when(c > 0.7, "highly elongated").when(
            c > 0.5, "elongated").when(c.isNotNull(), "none")
    if "shape_solidity" in columns:
        c = F.col("shape_solidity")
        flags["solidity_note"] = F.when(c < 0.75, "irregular or concave").when(
            c.isNotNull(), "none")
    if "circular_variance" in columns:
        c = F.col("circular_variance")
        flags["orientation_note"] = F.when(c < 0.3, "aligned").when(c > 0.7, "random").when(
            c.isNotNull(), "none")
    return summary.withColumns(flags)


def segmentation_text(
    flags: DataFrame, keys: Sequence[str], um_per_pixel: float = 0.3775, k: int = 3
) -> DataFrame:
    """Sentences on size, spacing, density, shape and orientation."""

    def scored(c: str, lead: Column, note: str, meaning: dict[str, str]) -> Column:
        tail = F.lit("")
        for flag, words in meaning.items():
            tail = F.when(F.col(note) == flag, F.lit(f" These cells are {words}.")).otherwise(tail)
        return F.when(
            F.col(f"{c}_z").isNotNull(),
            F.concat(lead, F.lit("percentile "), fixed(F.col(f"{c}_pct"), 0), F.lit(", z "),
                     fixed(F.col(f"{c}_z"), 1), F.lit("."), tail),
        )

    def plain(c: str, label: str, note: str) -> Column:
        tail = F.when(F.col(note) != "none", F.concat(F.lit(", "), F.col(note))).otherwise(F.lit(""))
        return F.when(
            F.col(c).isNotNull(),
            F.concat(F.lit(f"{label} **"), fixed(F.col(c), 2), F.lit("**"), tail, F.lit(".")),
        )

    area = F.col("size_area_val") * (um_per_pixel * um_per_pixel)
    spacing = F.col("mean_k_neighbor_distance_val") * um_per_pixel
    lines = [
        F.lit("**Cell arrangement**:"),
        scored("size_area", F.concat(F.lit("Mean cell area **"), fixed(area, 0), F.lit(" µm²**, ")),
               "size_note", {"smaller": "smaller than most", "larger": "larger than most"}),
        scored("mean_k_neighbor_distance",
               F.concat(F.lit(f"Mean distance to the {k} nearest cells **"), fixed(spacing, 0),
                        F.lit(" µm**, ")),
               "spacing_note", {"shorter": "closer together than most",
                                "longer": "further apart than most"}),
        scored("local_density", F.lit("Local density: "), "density_note",
               {"sparser": "more sparsely spread than most",
                "denser": "more densely packed than most"}),
        F.lit("**Cell shape**:"),
    ]
    columns = flags.columns
    for c, label, note in (
        ("shape_circularity", "Circularity", "circularity_note"),
        ("shape_eccentricity", "Eccentricity", "eccentricity_note"),
        ("shape_solidity", "Solidity", "solidity_note"),
        ("circular_variance", "Circular variance of the orientation", "orientation_note"),
    ):
        if c in columns:
            lines.append(plain(c, label, note))
    return flags.select(*keys, F.concat_ws("\n", *lines).alias("seg_text"))
