"""Scores of replies against expert labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.replies import CLASSES, parse_guess, parse_response, predicted_labels


def with_predictions(replies: DataFrame, reply: str = "reply") -> DataFrame:
    return replies.withColumn("predicted", predicted_labels(F.col(reply)))


def accuracy_at_k(predictions: DataFrame, ks: Sequence[int] = (1, 2, 3)) -> DataFrame:
    """Share of replies whose true label is among the first ``k``; none counts as wrong."""
    position = F.array_position("predicted", F.col("truth"))
    counts = predictions.select(position.alias("_at")).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if((F.col("_at") > 0) & (F.col("_at") <= k)).alias(f"k{k}") for k in ks],
    )
    long = counts.unpivot(["n"], [f"k{k}" for k in ks], "k", "correct")
    return long.select(
        F.substring("k", 2, 9).cast("int").alias("k"),
        "n",
        "correct",
        F.try_divide("correct", "n").alias("accuracy"),
    )


def confusion_matrix(predictions: DataFrame) -> DataFrame:
    """Counts and row shares of the first prediction, one row per class, also without replies.

    True labels outside the five classes are left out, not added to another class.
    """
    classes = predictions.sparkSession.createDataFrame([(c,) for c in CLASSES], "truth string")
    top = predictions.where(F.col("truth").isin(*CLASSES) & (F.size("predicted") > 0)).select(
        "truth", F.get("predicted", F.lit(0)).alias("_top")
    )
    names = [c.lower().replace(" ", "_") for c in CLASSES]
    counts = top.groupBy("truth").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(F.col("_top") == c).alias(f"n_{n}") for c, n in zip(CLASSES, names)],
    )
    numbers = ["n", *[f"n_{n}" for n in names]]
    every = classes.join(counts, "truth", "left").fillna(0, numbers)
    return every.withColumns({f"share_{n}": F.try_divide(f"n_{n}", "n") for n in names})


def entries_by_truth(replies: DataFrame, reply: str = "reply") -> DataFrame:
    """Items of every first guess next to the true label."""
    first = F.get(parse_response(F.col(reply)), F.lit(0))
    return replies.select("reply_id", "truth", F.explode(parse_guess(first)).alias("entry"))
