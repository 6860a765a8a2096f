"""Feature tables of the selected users, over the order lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketline import schemas
from basketline.operators import features
from basketline.plans import driver_tables as tables
from basketline.plans.queries.scoring import SCORES_SQL, order_top_users
from basketline.plans.registry import query, rounded
from basketline.sources import tables as stage_tables
from basketline.sources.categories import missing_categories as find_missing
from basketline.staging import stage

ITEMS = tables.ITEMS_SQL

TOP_REVIEWS_SQL = f"""
{SCORES_SQL}, {ITEMS},
tr AS (
  SELECT li.*, least(li.helpful_votes, 50) AS helpful_votes_clipped, items.item_avg_rating,
    [items.p_type, items.p_brand] AS item_categories
  FROM li SEMI JOIN top ON li.user_id = top.user_id
  LEFT JOIN items ON items.category = li.category AND items.product_id = li.product_id
)"""


def order_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.latest_items(tables.part_items(spark, sf_dir))


def order_top_reviews(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The top users and their reviews."""
    top = order_top_users(spark, sf_dir)
    reviews = tables.order_reviews(spark, sf_dir)
    return top, features.top_user_reviews(reviews, top, order_items(spark, sf_dir))


def _joined(column: str):
    return F.array_join(column, "|").alias(column)


@query(
    "top_user_reviews",
    f"""WITH {TOP_REVIEWS_SQL} SELECT category, user_id, product_id, t AS "unixReviewTime",
    rating, helpful_votes, helpful_votes_clipped, verified AS verified_purchase,
    item_avg_rating, array_to_string(item_categories, '|') AS item_categories FROM tr""",
)
def top_user_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, reviews = order_top_reviews(spark, sf_dir)
    return reviews.withColumn("item_categories", _joined("item_categories"))


@query(
    "top_user_stats",
    f"""WITH {TOP_REVIEWS_SQL},
    s AS (SELECT category, count(*) AS n_reviews, count(DISTINCT user_id) AS n_users
          FROM tr GROUP BY category),
    r AS (SELECT category, string_agg(rating || '=' || n, ',' ORDER BY rating) AS ratings
          FROM (SELECT category, CAST(rating AS INTEGER) AS rating, count(*) AS n
                FROM tr GROUP BY ALL) GROUP BY category),
    hist AS (SELECT category, string_agg(hv || '=' || n, ',' ORDER BY hv) AS helpful
          FROM (SELECT category, helpful_votes_clipped AS hv, count(*) AS n
                FROM tr GROUP BY ALL) GROUP BY category)
    SELECT s.category, n_reviews, n_users, ratings, helpful
    FROM s JOIN r ON s.category = r.category JOIN hist ON s.category = hist.category""",
)
def top_user_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, reviews = order_top_reviews(spark, sf_dir)
    stored = stage(reviews, "top-user-reviews")
    ratings, helpful = features.top_user_histograms(stored)

    def folded(hist: DataFrame, bucket: str, name: str) -> DataFrame:
        pairs = F.transform(
            F.sort_array(F.collect_list(F.struct(F.col(bucket).cast("int").alias("b"), "n"))),
            lambda e: F.concat_ws("=", e["b"].cast("string"), e["n"].cast("string")),
        )
        return hist.groupBy("category").agg(F.array_join(pairs, ",").alias(name))

    return (
        features.top_user_stats(stored)
        .join(folded(ratings, "rating", "ratings"), "category")
        .join(folded(helpful, "helpful", "helpful"), "category")
    )


@query(
    "user_features",
    f"""WITH {TOP_REVIEWS_SQL}, f AS (
      SELECT category, user_id, count(product_id) AS num_purchases_in_category,
        round(avg(rating), 9) AS avg_rating_in_category,
        round(avg(helpful_votes), 9) AS avg_helpful_vote_in_category,
        round(avg(item_avg_rating), 9) AS avg_item_avg_rating,
        min(t) AS first_review_time, max(t) AS last_review_time
      FROM tr GROUP BY category, user_id)
    SELECT f.*, total_purchases, distinct_categories, round(entropy, 9) AS entropy,
      round(norm_entropy, 9) AS norm_entropy, round(importance, 9) AS importance
    FROM f LEFT JOIN top ON f.user_id = top.user_id""",
)
def user_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    top, reviews = order_top_reviews(spark, sf_dir)
    return rounded(features.user_features(reviews, top))


@query(
    "item_features",
    f"""WITH {TOP_REVIEWS_SQL}, f AS (
      SELECT category, product_id, count(user_id) AS num_topuser_reviews,
        count(DISTINCT user_id) AS num_unique_topusers,
        round(avg(rating), 9) AS avg_rating_topusers,
        round(avg(helpful_votes), 9) AS avg_helpful_votes_topusers,
        min(t) AS first_review_time, max(t) AS last_review_time
      FROM tr WHERE product_id IS NOT NULL GROUP BY category, product_id)
    SELECT f.*, item_avg_rating AS item_avg_rating_meta,
      p_type || '|' || p_brand AS item_categories_meta
    FROM f LEFT JOIN items ON f.category = items.category AND f.product_id = items.product_id""",
)
def item_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, reviews = order_top_reviews(spark, sf_dir)
    table = features.item_features(reviews, order_items(spark, sf_dir))
    return rounded(table.withColumn("item_categories_meta", _joined("item_categories_meta")))


@query(
    "item_meta_last_wins",
    """SELECT p_brand AS category, p_type || '-' || CAST(p_size AS VARCHAR) AS product_id,
      arg_max(p_retailprice, p_partkey) AS item_avg_rating,
      arg_max(p_name, p_partkey) AS item_name
    FROM part GROUP BY ALL""",
)
def item_meta_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts keyed coarsely, so that keys repeat and the last row must win."""
    c = F.col
    items = tables.load(spark, sf_dir, "part").select(
        c("p_brand").alias("category"),
        F.concat_ws("-", "p_type", c("p_size").cast("string")).alias("product_id"),
        c("p_retailprice").alias("item_avg_rating"),
        F.array("p_name").alias("item_categories"),
        c("p_partkey").alias("line_order"),
    )
    latest = features.latest_items(items)
    return latest.select(
        "category", "product_id", "item_avg_rating", c("item_categories")[0].alias("item_name")
    )


@query(
    "missing_categories",
    f"""WITH {TOP_REVIEWS_SQL}, expected AS (
      SELECT p_brand AS category FROM part UNION SELECT event_type FROM events)
    SELECT category FROM expected WHERE category NOT IN (SELECT category FROM tr)""",
)
def missing_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands and event types are expected; only brands have feature tables."""
    top, reviews = order_top_reviews(spark, sf_dir)
    stored = stage(reviews, "top-user-reviews")
    expected = stage_tables.union_tables(
        tables.part_items(spark, sf_dir).select("category"),
        tables.event_reviews(spark, sf_dir).select("category"),
    )
    return find_missing(
        expected,
        stored,
        features.user_features(stored, top),
        features.item_features(stored, order_items(spark, sf_dir)),
    )


@query(
    "empty_features",
    f"""WITH {TOP_REVIEWS_SQL}
    SELECT category, user_id, product_id, t AS "unixReviewTime", rating, helpful_votes,
      helpful_votes_clipped, verified AS verified_purchase, item_avg_rating,
      array_to_string(item_categories, '|') AS item_categories
    FROM tr WHERE user_id IN (SELECT event_type FROM events)""",
)
def empty_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No reviewer is named like an event type: an empty table with all its columns."""
    nobody = tables.load(spark, sf_dir, "events").select(F.col("event_type").alias("user_id"))
    reviews = tables.order_reviews(spark, sf_dir)
    kept = features.top_user_reviews(reviews, nobody.distinct(), order_items(spark, sf_dir))
    typed = stage_tables.union_tables(
        stage_tables.empty_like(spark, schemas.TOP_USER_REVIEWS), kept
    )
    return typed.withColumn("item_categories", _joined("item_categories"))
