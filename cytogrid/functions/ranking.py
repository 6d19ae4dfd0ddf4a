"""Exact ranks and quantiles of groups of any size, by one plan whatever the sizes.

No task holds a whole group. A quantile sketch per group proposes cuts, as many as the
group's size asks for; counts between the cuts then make ranks exact wherever the cuts
fall. A value that fills a share of its group is a cut, and needs no sorting.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .skew import attach

#: Rows of a group that one bin is meant to hold, and the most bins a group is cut into.
PER_BIN = 50_000
BINS = 256
#: Parts over which rows that need no order are spread.
SPREAD = 1024
#: Relative rank error of the sketches that bracket quantiles, and how many errors wide a bracket is.
SKETCH, MARGIN = 10_000, 4


def largest_group(rows: DataFrame, keys: Sequence[str]) -> int:
    """Row count of the largest group; one aggregated number reaches the driver."""
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return sizes.agg(F.max("_n")).first()[0] or 0


def _bin_of(value: Column, cuts: Column, bins: int) -> Column:
    """Number of cuts below the value, by bisection over the sorted cut array."""
    steps, step = [], bins // 2
    while step:
        steps.append(F.lit(step))
        step //= 2
    found = F.aggregate(
        F.array(*steps),
        F.lit(0),
        lambda at, width: F.when(F.get(cuts, at + width - 1) < value, at + width).otherwise(at),
    )
    return F.when(F.size(cuts) > 0, found).otherwise(F.lit(0))


def _cuts(value: Column, rows: Column, per_bin: int, bins: int) -> Column:
    """Aggregate: distinct rising cuts of about ``per_bin`` rows each, none for groups of one bin."""
    wanted = F.ceil(rows / F.lit(float(per_bin)))
    every = F.percentile_approx(value, [i / bins for i in range(1, bins)], 4 * bins)
    step = lambda i: F.floor(i * wanted / F.lit(float(bins)))
    chosen = F.array_distinct(F.filter(every, lambda _, i: step(i + 1) > step(i)))
    return F.coalesce(chosen, F.slice(every, 1, 0), F.expr("array()").cast("array<double>"))


def running_counts(
    values: DataFrame,
    keys: Sequence[str],
    value: str = "value",
    weight: str | None = None,
    per_bin: int = PER_BIN,
    bins: int = BINS,
    group_stats: DataFrame | None = None,
) -> DataFrame:
    """Per distinct value of a group: rows at it, below it, and in the group.

    Adds ``n_at``, ``n_below``, ``n_total`` (sums of ``weight``) and, where given,
    the columns of ``group_stats`` (one row per key). ``bins`` is a power of two.
    """
    keys = list(keys)
    unit = F.col(weight) if weight else F.lit(1).cast("long")
    counted = values.groupBy(*keys, value).agg(F.sum(unit).alias("n_at"))
    cuts = counted.groupBy(*keys).agg(
        F.sum("n_at").alias("n_total"), _cuts(F.col(value), F.count(F.lit(1)), per_bin, bins).alias("_cuts")
    )
    if group_stats is not None:
        cuts = cuts.join(group_stats, keys, "left")
    binned = (
        attach(counted, cuts, keys, [value])
        .withColumn("_bin", _bin_of(F.col(value), F.col("_cuts"), bins))
        .drop("_cuts")
    )
    inside = (
        Window.partitionBy(*keys, "_bin")
        .orderBy(value)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    before = (
        Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    )
    starts = (
        binned.groupBy(*keys, "_bin")
        .agg(F.sum("n_at").alias("_size"))
        .select(*keys, "_bin", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))
    )
    local = binned.withColumn("_upto", F.sum("n_at").over(inside))
    # Both sides are already partitioned by (keys, bin), and bins are bounded.
    return (
        local.join(starts, [*keys, "_bin"])
        .withColumn("n_below", F.col("_start") + F.col("_upto") - F.col("n_at"))
        .drop("_bin", "_start", "_upto")
    )


def percentile_rank(below: Column, at: Column, total: Column) -> Column:
    """Percentile of a score, "rank" kind: ties take the mean of their ranks."""
    seen = F.when(at > 0, F.lit(1)).otherwise(F.lit(0))
    return F.try_divide((F.lit(2) * below + at + seen) * F.lit(50.0), total)


def score_against(
    reference: DataFrame,
    query: DataFrame | None,
    keys: Sequence[str],
    value: str = "value",
    per_bin: int = PER_BIN,
    bins: int = BINS,
) -> DataFrame:
    """Add ``z`` and ``percentile`` of each query value among its group's reference.

    ``query=None`` scores the reference rows themselves. z uses the population
    deviation. Groups without spread have a NULL z, queries without a value stay
    NULL in both. Reference and query are written to the shared folder once. Then
    each row is shuffled once, by group and bin: what lies below its bin is known from
    counts, its place inside the bin from a window. Rows equal to a cut have a bin
    of their own and are spread, as the counts alone tell their rank.
    """
    keys = list(keys)
    one, zero = F.lit(1).cast("long"), F.lit(0).cast("long")
    if query is None:
        columns = reference.columns
        tagged = reference.withColumn("_ref", one).withColumn("_ask", F.lit(True))
    else:
        columns = query.columns
        asked = query.withColumn("_ref", zero).withColumn("_ask", F.lit(True))
        given = reference.select(*keys, value, one.alias("_ref"), F.lit(False).alias("_ask"))
        tagged = asked.unionByName(given, allowMissingColumns=True)
    tagged = cut_lineage(
        tagged.withColumn("_ref", F.when(F.col(value).isNotNull(), F.col("_ref")).otherwise(zero))
    )
    spread = [c for c in columns if c not in keys]
    limits = _limits(tagged, keys, value, spread, per_bin, bins)
    placed = attach(tagged, limits, keys, spread).withColumn("_bin", _place(F.col(value), bins))
    alone = F.col("_bin").isNull() | (F.col("_bin") % 2 == 1)
    placed = placed.withColumns({
        "_part": F.when(alone, F.pmod(F.xxhash64(*spread), F.lit(SPREAD))).otherwise(zero),
        "_start": F.coalesce(F.get("_bins", "_bin")["_start"], zero),
        "_size": F.get("_bins", "_bin")["_size"],
    }).drop("_bins", "_cuts")
    inside = Window.partitionBy(*keys, "_bin", "_part")
    upto = inside.orderBy(value).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    ties = Window.partitionBy(*keys, "_bin", "_part", value)
    ranked = placed.withColumn("_upto", F.sum("_ref").over(upto)).withColumn("_ties", F.sum("_ref").over(ties))
    at = F.when(alone, F.col("_size")).otherwise(F.col("_ties"))
    below = F.col("_start") + F.when(alone, zero).otherwise(F.col("_upto") - F.col("_ties"))
    return ranked.where("_ask").select(
        *columns,
        F.try_divide(F.col(value) - F.col("_mean"), F.col("_sd")).alias("z"),
        F.when(F.col(value).isNotNull(), percentile_rank(below, at, F.col("_n"))).alias("percentile"),
    )


def _place(value: Column, bins: int) -> Column:
    """Bin of a value: twice the number of cuts below it, and one more where it is a cut; NULL without a value."""
    below = _bin_of(value, F.col("_cuts"), bins)
    at_cut = F.coalesce(F.get("_cuts", below) == value, F.lit(False))
    return F.when(value.isNotNull(), below * 2 + at_cut.cast("int"))


def _limits(
    tagged: DataFrame, keys: list[str], value: str, spread: list[str], per_bin: int, bins: int
) -> DataFrame:
    """One row per group: mean, deviation, number, cuts, and per bin the references in it and before it.

    Only groups with cuts are read a second time, to count their bins.
    """
    known = F.when(F.col("_ref") > 0, F.col(value))
    limits = tagged.groupBy(*keys).agg(
        F.avg(known).alias("_mean"),
        F.stddev_pop(known).alias("_sd"),
        F.sum("_ref").alias("_n"),
        _cuts(F.col(value), F.count(value), per_bin, bins).alias("_cuts"),
    )
    cut = limits.where(F.size("_cuts") > 0).select(*keys, "_cuts")
    sizes = (
        attach(tagged.select(*keys, value, "_ref", *[c for c in spread if c != value]), cut, keys, spread)
        .select(*keys, _place(F.col(value), bins).alias("_bin"), "_ref")
        .where(F.col("_bin").isNotNull())
        .groupBy(*keys, "_bin")
        .agg(F.sum("_ref").alias("_size"))
    )
    every = cut.select(*keys, F.explode(F.sequence(F.lit(0), F.size("_cuts") * 2)).alias("_bin"))
    before = Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        every.join(sizes, [*keys, "_bin"], "left")
        .withColumn("_size", F.coalesce("_size", F.lit(0).cast("long")))
        .withColumn("_start", F.coalesce(F.sum("_size").over(before), F.lit(0).cast("long")))
        .groupBy(*keys)
        .agg(F.sort_array(F.collect_list(F.struct("_bin", "_start", "_size"))).alias("_bins"))
    )
    return limits.join(starts, keys, "left")


def exact_quantiles(
    values: DataFrame,
    keys: Sequence[str],
    quantiles: dict[str, float],
    value: str = "value",
    weight: str | None = None,
) -> DataFrame:
    """Exact quantiles (name -> fraction), linearly interpolated, one row per key.

    A first pass brackets each wanted rank by two values of a sketch. A second one
    counts what lies below the bracket and each value within it, so neither pass
    moves more than partial counts; groups without values get NULL. Rows with a ``weight``
    (counted values) are ranked in bins. The values are written once between the passes: worked out
    again, averages differ in the last bits with the order of summation, and ties would leave their bracket.
    """
    keys = list(keys)
    if weight is not None:
        ranked = running_counts(values.where(F.col(value).isNotNull()), keys, value, weight)
        return ranked.groupBy(*keys).agg(*_picks(F.col(value), quantiles))
    names, off = list(quantiles), MARGIN / SKETCH
    rows = cut_lineage(values.select(*keys, F.col(value).cast("double").alias("_v")))
    edges = [min(max(quantiles[n] + side, 0.0), 1.0) for n in names for side in (-off, off)]
    brackets = rows.groupBy(*keys).agg(
        F.count("_v").alias("_n"), F.percentile_approx("_v", edges, SKETCH).alias("_edges")
    )
    brackets = brackets.select(*keys, "_n", F.posexplode(F.array(*[
        F.struct(F.lit(q).cast("double").alias("q"), F.get("_edges", F.lit(2 * i)).alias("low"),
                 F.get("_edges", F.lit(2 * i + 1)).alias("high"))
        for i, q in enumerate(quantiles.values())])).alias("_i", "_b"))
    lookup = brackets.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_i", "_n", "_b"))).alias("_all"))
    side = F.when(F.col("_v") < F.col("_one._b.low"), -1).when(F.col("_v") > F.col("_one._b.high"), 1).otherwise(0)
    counted = (
        attach(rows, lookup, keys, ["_v"])
        .select(*keys, "_v", F.explode("_all").alias("_one"))
        .select(*keys, "_v", "_one", F.when(F.col("_v").isNotNull(), side).alias("_side"))
        .groupBy(*keys, F.col("_one._i").alias("_i"), F.col("_one._n").alias("_n"), F.col("_one._b.q").alias("_q"),
                 "_side", F.when(F.col("_side") == 0, F.col("_v")).alias("_in"))
        .agg(F.count("_v").alias("n_at"), F.min("_v").alias("_min"), F.max("_v").alias("_max"))
    )
    upto = Window.partitionBy(*keys, "_i").orderBy("_side", "_in").rowsBetween(Window.unboundedPreceding, 0)
    placed = counted.withColumn("_upto", F.sum("n_at").over(upto))
    at = (F.col("_n") - 1) * F.col("_q")

    def ranked(rank: Column) -> Column:
        """The value of a rank, from its row; beside the bracket only the next value is known."""
        first = F.col("_upto") - F.col("n_at")
        here = (rank >= first) & (rank < F.col("_upto"))
        known = (
            F.when(F.col("_side") == 0, F.col("_in"))
            .when((F.col("_side") < 0) & (rank == F.col("_upto") - 1), F.col("_max"))
            .when((F.col("_side") > 0) & (rank == first), F.col("_min"))
            .otherwise(F.raise_error(F.lit("a quantile lies outside its bracket")).cast("double"))
        )
        return F.min(F.when(here, known))

    picked = placed.groupBy(*keys, "_i").agg(
        ranked(F.floor(at)).alias("low"), ranked(F.ceil(at)).alias("high"), F.max(at - F.floor(at)).alias("share")
    )
    found = F.col("low") + (F.col("high") - F.col("low")) * F.col("share")
    return picked.groupBy(*keys).agg(
        *[F.max(F.when(F.col("_i") == i, found)).alias(n) for i, n in enumerate(names)]
    )


def _picks(value: Column, quantiles: dict[str, float]) -> list[Column]:
    last = F.col("n_total") - 1
    upto = F.col("n_below") + F.col("n_at")
    picks = []
    for name, q in quantiles.items():
        at = last * F.lit(float(q))
        low = F.min(F.when(upto > F.floor(at), value))
        high = F.min(F.when(upto > F.ceil(at), value))
        share = F.max(at - F.floor(at))
        picks.append((low + (high - low) * share).alias(name))
    return picks
