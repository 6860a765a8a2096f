"""Review, user and item feature tables for the selected users.

Joins carry no broadcast hints: top users and item tables grow with the data, so
Spark broadcasts them only when their measured size is small, and otherwise
shuffles with adaptive splitting of skewed keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketline.config import HELPFUL_CLIP_TOP_USERS, HOT_KEY_ROWS
from basketline.functions.coerce import clip_high
from basketline.operators import counting
from basketline.operators.skew import known_hot_keys, split_hot


def latest_items(items: DataFrame, order: str = "line_order") -> DataFrame:
    """Item attributes per (category, product), the last line winning."""
    keyed = items.where(F.col("product_id").isNotNull())
    attributes = F.struct("item_avg_rating", "item_categories")
    last = keyed.groupBy("category", "product_id").agg(F.max_by(attributes, order).alias("last"))
    return last.select("category", "product_id", "last.item_avg_rating", "last.item_categories")


def reviews_of(
    reviews: DataFrame, top_users: DataFrame, hot_user_rows: int = HOT_KEY_ROWS
) -> DataFrame:
    """Reviews whose user is among ``top_users``.

    When that table is too large to broadcast, rows are shuffled by user. Users whose
    total says that they alone would fill a task stay out of that shuffle: there are
    few of them, so they are matched where their rows lie.
    """
    hot = None
    if "total_purchases" in top_users.columns:
        hot = known_hot_keys(top_users, "user_id", "total_purchases", hot_user_rows)
    ordinary, heavy = split_hot(reviews, "user_id", hot)
    kept = ordinary.join(top_users.select("user_id"), "user_id", "left_semi")
    return kept if heavy is None else kept.unionByName(heavy)


def top_user_reviews(
    reviews: DataFrame, top_users: DataFrame, items: DataFrame, hot_user_rows: int = HOT_KEY_ROWS
) -> DataFrame:
    """Reviews of the selected users with item attributes.

    ``items`` has one row per (category, product), see ``latest_items``.
    """
    kept = reviews_of(reviews, top_users, hot_user_rows)
    described = kept.join(items, ["category", "product_id"], "left")
    return described.select(
        "category",
        "user_id",
        "product_id",
        "unixReviewTime",
        "rating",
        "helpful_votes",
        clip_high(F.col("helpful_votes"), HELPFUL_CLIP_TOP_USERS).alias("helpful_votes_clipped"),
        "verified_purchase",
        "item_avg_rating",
        "item_categories",
    )


def top_user_stats(top_reviews: DataFrame) -> DataFrame:
    """Kept reviews and distinct users per category."""
    per_user = top_reviews.groupBy("category", "user_id").agg(F.count(F.lit(1)).alias("n"))
    return per_user.groupBy("category").agg(
        F.sum("n").alias("n_reviews"), F.count(F.lit(1)).alias("n_users")
    )


def top_user_histograms(top_reviews: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rating and clipped helpful-vote histograms of the kept reviews."""
    return (
        counting.rating_histogram(top_reviews),
        counting.helpful_histogram(top_reviews, HELPFUL_CLIP_TOP_USERS),
    )


def user_features(top_reviews: DataFrame, top_users: DataFrame) -> DataFrame:
    """Behaviour per (category, user), joined with the user's global scores."""
    behaviour = top_reviews.groupBy("category", "user_id").agg(
        F.count("product_id").alias("num_purchases_in_category"),
        F.avg("rating").alias("avg_rating_in_category"),
        F.avg("helpful_votes").alias("avg_helpful_vote_in_category"),
        F.avg("item_avg_rating").alias("avg_item_avg_rating"),
        F.min("unixReviewTime").alias("first_review_time"),
        F.max("unixReviewTime").alias("last_review_time"),
    )
    return behaviour.join(top_users, "user_id", "left")


def item_features(top_reviews: DataFrame, items: DataFrame) -> DataFrame:
    """Audience per (category, product), joined with the item's attributes.

    Distinct users come from a (product, user) aggregate first: a product that
    holds much of the data is reduced to one row per user before it meets in a task.
    """
    rating, helpful = F.col("rating"), F.col("helpful_votes")
    per_user = (
        top_reviews.where(F.col("product_id").isNotNull())
        .groupBy("category", "product_id", "user_id")
        .agg(
            F.count("user_id").alias("n"),
            F.sum(rating).alias("rating_sum"),
            F.count(rating).alias("rating_n"),
            F.sum(helpful).alias("helpful_sum"),
            F.count(helpful).alias("helpful_n"),
            F.min("unixReviewTime").alias("first"),
            F.max("unixReviewTime").alias("last"),
        )
    )
    audience = per_user.groupBy("category", "product_id").agg(
        F.sum("n").alias("num_topuser_reviews"),
        F.count("user_id").alias("num_unique_topusers"),
        F.try_divide(F.sum("rating_sum"), F.sum("rating_n")).alias("avg_rating_topusers"),
        F.try_divide(F.sum("helpful_sum"), F.sum("helpful_n")).alias("avg_helpful_votes_topusers"),
        F.min("first").alias("first_review_time"),
        F.max("last").alias("last_review_time"),
    )
    described = items.select(
        "category",
        "product_id",
        F.col("item_avg_rating").alias("item_avg_rating_meta"),
        F.col("item_categories").alias("item_categories_meta"),
    )
    return audience.join(described, ["category", "product_id"], "left")


def static_user_features(features: DataFrame, order: str = "category_idx") -> DataFrame:
    """One row of features per user: that of the user's lowest category index."""
    others = [c for c in features.columns if c not in ("user_id", order, "category")]
    first = features.groupBy("user_id").agg(F.min_by(F.struct(*others), order).alias("f"))
    return first.select("user_id", *[F.col("f")[c].alias(c) for c in others])


def static_as_of(reviews: DataFrame, as_of: int) -> DataFrame:
    """Behaviour per user up to ``as_of``, in the reviews' time unit, and nothing later.

    Together with ``sequence_samples(as_of=...)``, which keeps the prefixes that reach past
    that time, no feature sees what it is used to predict.
    """
    past = reviews.where((F.col("unixReviewTime") <= as_of) & F.col("user_id").isNotNull())
    per_category = past.groupBy("user_id", "category").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col("rating").cast("double")).alias("rating_sum"),
        F.count("rating").alias("rating_n"),
        F.max("unixReviewTime").alias("last"),
    )
    return per_category.groupBy("user_id").agg(
        F.sum("n").alias("past_purchases"),
        F.count(F.lit(1)).alias("past_categories"),
        F.try_divide(F.sum("rating_sum"), F.sum("rating_n")).alias("past_avg_rating"),
        F.max("last").alias("past_last_review_time"),
    )
