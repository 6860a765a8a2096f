"""User scoring: totals, entropy, importance and the top-user selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketline.config import (
    ENTROPY_EPSILON,
    EXACT_RANK_ROWS,
    IMPORTANCE_PERCENTILE,
    MIN_DISTINCT_CATEGORIES,
    MIN_TOTAL_PURCHASES,
)
from basketline.functions import entropy
from basketline.operators.order_stats import quantile
from basketline.sources.categories import as_columns
from basketline.staging import stage


def user_category_cells(counts: DataFrame) -> DataFrame:
    """One row per (user, category) with purchases; null users or categories drop out.

    Counts hold one row per user, category and source, so even the busiest user has few.
    Placing them by user first lets all per-user aggregates that follow skip a shuffle.
    """
    return (
        counts.where(F.col("user_id").isNotNull() & F.col("category").isNotNull())
        .select("user_id", "category", "num_purchases")
        .repartition("user_id")
        .groupBy("user_id", "category")
        .agg(F.sum("num_purchases").alias("n"))
    )


def _category_sums(categories: list[str]) -> list[Column]:
    as_columns(categories)
    return [
        F.sum(F.when(F.col("category") == name, F.col("n")).otherwise(0)).alias(name)
        for name in categories
    ]


def user_pivot(counts: DataFrame, categories: list[str]) -> DataFrame:
    """User by category matrix of purchases, 0 where a user bought nothing."""
    return (
        user_category_cells(counts)
        .groupBy("user_id")
        .pivot("category", categories)
        .agg(F.sum("n"))
        .na.fill(0)
    )


def user_totals(counts: DataFrame) -> DataFrame:
    """Purchases and number of categories per user."""
    return user_category_cells(counts).groupBy("user_id").agg(*_totals())


def _totals() -> list[Column]:
    return [
        F.sum("n").alias("total_purchases"),
        F.count_if(F.col("n") > 0).alias("distinct_categories"),
    ]


def user_entropy(counts: DataFrame) -> DataFrame:
    """Exact Shannon entropy of each user's purchases, 0 without purchases."""
    sums = user_category_cells(counts).groupBy("user_id").agg(
        F.sum("n").alias("total"), F.sum(entropy.x_log_x(F.col("n"))).alias("n_log_n")
    )
    exact = entropy.entropy_from_sums(F.col("total"), F.col("n_log_n"))
    return sums.select("user_id", exact.alias("entropy"))


def user_scores(
    counts: DataFrame, categories: list[str], with_category_columns: bool = False
) -> DataFrame:
    """Totals, smoothed entropy and importance per user, without a dense matrix."""
    k, n = len(categories), F.col("n")
    smoothed = F.when(n > 0, entropy.x_log_x(n + F.lit(ENTROPY_EPSILON))).otherwise(F.lit(0.0))
    sums = user_category_cells(counts).groupBy("user_id").agg(
        *(_category_sums(categories) if with_category_columns else []),
        *_totals(),
        F.sum(smoothed).alias("_smoothed"),
    )
    total, distinct = F.col("total_purchases"), F.col("distinct_categories")
    scored = sums.withColumn(
        "entropy", entropy.smoothed_entropy(total, distinct, F.col("_smoothed"), k)
    )
    scored = scored.withColumn("norm_entropy", entropy.normalised(F.col("entropy"), k))
    return scored.withColumn("importance", total * (1 + F.col("norm_entropy"))).drop("_smoothed")


def importance_threshold(
    scores: DataFrame,
    percentile: float = IMPORTANCE_PERCENTILE,
    exact_rows: int = EXACT_RANK_ROWS,
) -> float | None:
    """Exact interpolated quantile of importance. ``scores`` is read several times."""
    return quantile(scores, "importance", percentile, exact_rows)


def top_users(
    scores: DataFrame,
    percentile: float = IMPORTANCE_PERCENTILE,
    min_purchases: int = MIN_TOTAL_PURCHASES,
    min_categories: int = MIN_DISTINCT_CATEGORIES,
    exact_rows: int = EXACT_RANK_ROWS,
) -> DataFrame:
    """Users whose importance, purchases and categories all reach their thresholds.

    Scores are staged: the threshold and the filter read them more than once. Both
    sides of the threshold test are rounded, since equal users may differ in the last
    bit when their cells were summed in another order.
    """
    stored = stage(scores, "user-scores")
    threshold = importance_threshold(stored, percentile, exact_rows)
    if threshold is None:
        return stored
    return stored.where(
        (F.round("importance", 9) >= F.round(F.lit(threshold), 9))
        & (F.col("total_purchases") >= min_purchases)
        & (F.col("distinct_categories") >= min_categories)
    )
