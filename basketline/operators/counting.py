"""Per-category counts, statistics and histograms.

All of these are ``groupBy`` aggregates with map-side partials, so a category or
user that holds much of the data only sends one partial row per task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basketline.config import HELPFUL_CLIP_RAW, PURCHASES_CLIP
from basketline.functions.coerce import clip_high


def user_counts(reviews: DataFrame) -> DataFrame:
    """Purchases per (category, user)."""
    return (
        reviews.where(F.col("user_id").isNotNull())
        .groupBy("category", "user_id")
        .agg(F.count(F.lit(1)).alias("num_purchases"))
    )


def review_stats(reviews: DataFrame) -> DataFrame:
    """Reviews, users and verified reviews per category.

    Users are counted as rows of the (category, user) aggregate: one more small
    aggregation in place of a distinct count.
    """
    per_user = (
        reviews.where(F.col("user_id").isNotNull())
        .groupBy("category", "user_id")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if(F.col("verified_purchase")).alias("verified"),
        )
    )
    return per_user.groupBy("category").agg(
        F.sum("n").alias("n_reviews"),
        F.count(F.lit(1)).alias("n_users"),
        F.sum("verified").alias("n_verified"),
    )


def _histogram(df: DataFrame, keys: list[str], bucket, name: str) -> DataFrame:
    return (
        df.select(*keys, bucket.alias(name))
        .where(F.col(name).isNotNull())
        .groupBy(*keys, name)
        .agg(F.count(F.lit(1)).alias("n"))
    )


def rating_histogram(reviews: DataFrame) -> DataFrame:
    """Reviews per (category, rating); unreadable ratings are left out."""
    return _histogram(reviews, ["category"], F.col("rating"), "rating")


def helpful_histogram(reviews: DataFrame, clip: int = HELPFUL_CLIP_RAW) -> DataFrame:
    """Reviews per (category, helpful votes), votes clipped from above."""
    return _histogram(reviews, ["category"], clip_high(F.col("helpful_votes"), clip), "helpful")


def item_stats(items: DataFrame) -> DataFrame:
    """Items and price statistics per category; null mean when nothing has a price."""
    price = F.col("price")
    return items.groupBy("category").agg(
        F.count(F.lit(1)).alias("n_items"),
        F.count(price).alias("price_count"),
        F.avg(price).alias("price_mean"),
        F.stddev_pop(price).alias("price_stddev"),
    )


def rating_number_histogram(items: DataFrame) -> DataFrame:
    """Items per (category, number of ratings)."""
    return _histogram(items, ["category"], F.col("rating_number"), "rating_number")


def purchases_histogram(counts: DataFrame, clip: int = PURCHASES_CLIP) -> DataFrame:
    """Users per (category, purchases in it), purchases clipped from above."""
    bucket = F.least("num_purchases", F.lit(clip)).cast("int")
    return _histogram(counts, ["category"], bucket, "purchases")


def equal_width_bins(hist: DataFrame, bucket: str, bins: int = 50) -> DataFrame:
    """Regroup a histogram into ``bins`` equal bins between its extremes, per category.

    The last bin includes its upper edge. A single-valued histogram spans half a
    unit to each side.
    """
    whole = Window.partitionBy("category")
    low = F.min(bucket).over(whole).cast("double")
    high = F.max(bucket).over(whole).cast("double")
    half = F.when(low == high, 0.5).otherwise(0.0)
    position = F.floor((F.col(bucket) - low + half) / (high - low + 2 * half) * bins)
    placed = hist.withColumn("bin", F.least(position, F.lit(bins - 1)).cast("int"))
    return placed.groupBy("category", "bin").agg(F.sum("n").alias("n"))


def user_totals_histogram(totals: DataFrame, clip: int = PURCHASES_CLIP) -> DataFrame:
    """Users per clipped purchase total and per number of categories, as one long table."""
    measures = F.explode(
        F.array(
            F.struct(
                F.lit("total_purchases").alias("measure"),
                F.least("total_purchases", F.lit(clip)).cast("int").alias("bucket"),
            ),
            F.struct(
                F.lit("distinct_categories").alias("measure"),
                F.col("distinct_categories").cast("int").alias("bucket"),
            ),
        )
    )
    return (
        totals.select(measures.alias("m"))
        .groupBy("m.measure", "m.bucket")
        .agg(F.count(F.lit(1)).alias("n"))
    )

