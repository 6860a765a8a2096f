"""Counts, statistics and histograms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketline.config import HELPFUL_CLIP_RAW
from basketline.operators import counting, scoring
from basketline.plans import driver_tables as tables
from basketline.plans.registry import query, rounded
from basketline.sources import tables as stage_tables

EV, LI, ITEMS = tables.EVENT_REVIEWS_SQL, tables.ORDER_REVIEWS_SQL, tables.ITEMS_SQL


@query(
    "user_counts",
    f"WITH {LI} SELECT category, user_id, count(*) AS num_purchases FROM li GROUP BY ALL",
)
def user_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counting.user_counts(tables.order_reviews(spark, sf_dir))


@query(
    "review_stats",
    f"""WITH {LI} SELECT category, count(*) AS n_reviews,
    count(DISTINCT user_id) AS n_users, count(*) FILTER (verified) AS n_verified
    FROM li GROUP BY category""",
)
def review_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counting.review_stats(tables.order_reviews(spark, sf_dir))


@query(
    "rating_hist",
    f"WITH {EV} SELECT category, rating, count(*) AS n FROM ev GROUP BY ALL ORDER BY ALL",
)
def rating_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counting.rating_histogram(tables.event_reviews(spark, sf_dir)).orderBy(
        "category", "rating"
    )


@query(
    "helpful_hist",
    f"""WITH {EV} SELECT category, least(helpful_votes, 10) AS helpful, count(*) AS n
    FROM ev GROUP BY ALL ORDER BY ALL""",
)
def helpful_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    hist = counting.helpful_histogram(tables.event_reviews(spark, sf_dir), HELPFUL_CLIP_RAW)
    return hist.orderBy("category", "helpful")


@query(
    "meta_stats",
    f"""WITH {ITEMS} SELECT category, count(*) AS n_items, count(price) AS price_count,
    round(avg(price), 9) AS price_mean, round(stddev_pop(price), 6) AS price_stddev
    FROM items GROUP BY category""",
)
def meta_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = counting.item_stats(tables.part_items(spark, sf_dir))
    return rounded(stats.withColumn("price_stddev", F.round("price_stddev", 6)))


@query(
    "rating_number_hist",
    f"WITH {ITEMS} SELECT category, rating_number, count(*) AS n FROM items GROUP BY ALL",
)
def rating_number_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counting.rating_number_histogram(tables.part_items(spark, sf_dir))


@query(
    "purchases_hist",
    f"""WITH {LI}, c AS (SELECT category, user_id, count(*) AS k FROM li GROUP BY ALL)
    SELECT category, CAST(least(k, 50) AS INTEGER) AS purchases, count(*) AS n
    FROM c GROUP BY ALL""",
)
def purchases_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counting.purchases_histogram(user_counts(spark, sf_dir))


@query(
    "purchases_bins",
    f"""WITH {EV}, c AS (SELECT category, user_id, count(*) AS k FROM ev GROUP BY ALL),
    v AS (SELECT category, CAST(least(k, 50) AS DOUBLE) AS x FROM c),
    b AS (SELECT category, min(x) AS lo, max(x) AS hi FROM v GROUP BY category),
    e AS (SELECT category, CASE WHEN lo = hi THEN lo - 0.5 ELSE lo END AS lo,
            CASE WHEN lo = hi THEN hi + 0.5 ELSE hi END AS hi FROM b)
    SELECT v.category, CAST(least(floor((x - lo) / (hi - lo) * 50), 49) AS INTEGER) AS bin,
      count(*) AS n
    FROM v JOIN e ON v.category = e.category GROUP BY ALL""",
)
def purchases_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = counting.user_counts(tables.event_reviews(spark, sf_dir))
    return counting.equal_width_bins(counting.purchases_histogram(counts), "purchases")


@query(
    "user_totals_hist",
    f"""WITH {LI}, u AS (SELECT user_id, count(*) AS n_all, count(DISTINCT category) AS n_cat
                        FROM li GROUP BY user_id)
    SELECT 'total_purchases' AS measure, CAST(least(n_all, 50) AS INTEGER) AS bucket,
      count(*) AS n FROM u GROUP BY ALL
    UNION ALL
    SELECT 'distinct_categories', CAST(n_cat AS INTEGER), count(*) FROM u GROUP BY ALL""",
)
def user_totals_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = scoring.user_totals(user_counts(spark, sf_dir))
    return counting.user_totals_histogram(totals)


@query(
    "stats_json",
    f"""WITH {EV},
    s AS (SELECT category, count(*) AS n_reviews, count(DISTINCT user_id) AS n_users,
            count(*) FILTER (verified) AS n_verified FROM ev GROUP BY category),
    r AS (SELECT category, rating, count(*) AS n FROM ev GROUP BY ALL),
    rh AS (SELECT category, string_agg('"' || CAST(rating AS VARCHAR) || '":' || n, ','
             ORDER BY rating) AS j FROM r GROUP BY category),
    h AS (SELECT category, least(helpful_votes, 10) AS hv, count(*) AS n FROM ev GROUP BY ALL),
    hh AS (SELECT category, string_agg('"' || hv || '":' || n, ',' ORDER BY hv) AS j
           FROM h GROUP BY category)
    SELECT s.category, '{{"category":"' || s.category || '","n_reviews":' || n_reviews
      || ',"n_users":' || n_users || ',"n_verified":' || n_verified
      || ',"rating_hist":{{' || rh.j || '}},"helpful_hist":{{' || hh.j || '}}}}' AS stats
    FROM s JOIN rh ON s.category = rh.category JOIN hh ON s.category = hh.category""",
)
def stats_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    reviews = tables.event_reviews(spark, sf_dir)
    ratings = counting.rating_histogram(reviews)
    helpful = counting.helpful_histogram(reviews)
    maps = {
        "rating_hist": stage_tables.histogram_map(ratings, "rating", name="rating_hist"),
        "helpful_hist": stage_tables.histogram_map(helpful, "helpful", name="helpful_hist"),
    }
    return stage_tables.stats_as_json(counting.review_stats(reviews), maps)
