"""Rule baselines that a trained model has to beat."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TARGET = "target_category_idx"


def majority_category(samples: DataFrame) -> DataFrame:
    """The most frequent target with its accuracy; the smallest index wins ties."""
    per_label = samples.groupBy(TARGET, "target_category").agg(F.count(F.lit(1)).alias("n"))
    best = F.max_by(F.struct(TARGET, "target_category", "n"), F.struct("n", -F.col(TARGET)))
    return per_label.agg(best.alias("best"), F.sum("n").alias("total")).select(
        F.col("best")[TARGET].alias("majority_idx"),
        F.col("best.target_category").alias("majority_category"),
        F.try_divide(F.col("best.n"), F.col("total")).alias("accuracy"),
    )


def user_majority_in_sample(samples: DataFrame) -> DataFrame:
    """Accuracy of each user's own most frequent target, fitted on the scored rows."""
    per_label = samples.groupBy("user_id", TARGET).agg(F.count(F.lit(1)).alias("n"))
    per_user = per_label.groupBy("user_id").agg(
        F.max("n").alias("correct"), F.sum("n").alias("total")
    )
    return per_user.agg(
        F.sum("correct").alias("n_correct"),
        F.sum("total").alias("n_samples"),
        F.try_divide(F.sum("correct"), F.sum("total")).alias("accuracy"),
    )


def _share_correct(samples: DataFrame, guess: Column) -> DataFrame:
    correct = F.count_if(guess == F.col(TARGET))
    return samples.agg(
        correct.alias("n_correct"),
        F.count(F.lit(1)).alias("n_samples"),
        F.try_divide(correct, F.count(F.lit(1))).alias("accuracy"),
    )


def last_category(samples: DataFrame) -> DataFrame:
    """Accuracy of guessing the current category again."""
    return _share_correct(samples, F.col("last_category_idx"))


def prefix_favourite(samples: DataFrame) -> DataFrame:
    """Accuracy of guessing the most frequent category so far."""
    return _share_correct(samples, F.col("prefix_most_freq_category_idx"))


def validation_baselines(samples: DataFrame) -> DataFrame:
    """Majority label of the train rows and the three rules' accuracy on validation rows.

    A rule whose column is missing has a null accuracy. One aggregate by (split, target)
    carries all of it; its size is splits x categories.
    """
    rules = {"last": "last_category_idx", "favourite": "prefix_most_freq_category_idx"}

    def hits(column: str) -> Column:
        known = F.col(column) == F.col(TARGET) if column in samples.columns else F.lit(None)
        return F.sum(known.cast("long"))

    cells = samples.groupBy("split", TARGET).agg(
        F.count(F.lit(1)).alias("n"),
        *[hits(column).alias(f"{name}_hits") for name, column in rules.items()],
    )
    target, n = F.col(TARGET), F.col("n")
    in_val = F.col("split") == "val"
    train_order = F.when(F.col("split") == "train", F.struct(n, -target))
    folded = cells.agg(
        F.max_by(target, train_order).alias("majority_idx"),
        F.collect_list(F.when(in_val, F.struct(target.alias("idx"), n.alias("n")))).alias("val"),
        *[F.sum(F.when(in_val, F.col(c))).alias(c) for c in ("n", "last_hits", "favourite_hits")],
    )
    majority = F.filter("val", lambda cell: cell["idx"] == F.col("majority_idx"))
    majority_hits = F.coalesce(F.get(majority, F.lit(0))["n"], F.lit(0))
    return folded.select(
        "majority_idx",
        F.try_divide(majority_hits, n).alias("majority_accuracy"),
        F.try_divide("last_hits", "n").alias("last_accuracy"),
        F.try_divide("favourite_hits", "n").alias("favourite_accuracy"),
    )
