"""Derived features of ``events`` samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketline.operators import derived
from basketline.plans import driver_tables as tables
from basketline.plans.queries.sequences import (
    SAMPLES_SQL,
    STATIC_SQL,
    event_samples,
    event_totals,
)
from basketline.plans.registry import query, rounded

KEY = ["user_id", "prefix_length"]
UNIT = tables.EVENT_TIME_UNIT
DAYS = "(prefix_timespan / 86400000000.0)"


def _linear(spark: SparkSession, sf_dir: str, *names: str, **options) -> DataFrame:
    samples = event_samples(spark, sf_dir, **options)
    return rounded(derived.linear_features(samples, UNIT).select(*KEY, *names))


def _without_counts(spark: SparkSession, sf_dir: str, *names: str) -> DataFrame:
    """The category spread without a column per category."""
    samples = event_samples(spark, sf_dir, category_counts=False, category_spread=True)
    return rounded(derived.linear_features(samples, UNIT, n_categories=6).select(*KEY, *names))


def _boosting(spark: SparkSession, sf_dir: str, *names: str) -> DataFrame:
    samples = event_samples(spark, sf_dir, static=event_totals(spark, sf_dir))
    return rounded(derived.boosting_features(samples, UNIT).select(*KEY, *names))


@query(
    "derived_rate",
    f"""WITH {SAMPLES_SQL} SELECT user_id, prefix_length, round(CASE WHEN prefix_timespan <> 0
    THEN prefix_length / {DAYS} END, 9) AS prefix_reviews_per_day FROM s""",
)
def derived_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _linear(spark, sf_dir, "prefix_reviews_per_day")


@query(
    "derived_deltas",
    f"""WITH {SAMPLES_SQL} SELECT user_id, prefix_length,
    round(last_rating - prefix_avg_rating, 9) + 0.0 AS last_minus_prefix_avg_rating,
    round(last_item_avg_rating - prefix_avg_item_avg_rating, 9) + 0.0
      AS last_item_avg_minus_prefix_item_avg FROM s""",
)
def derived_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["last_minus_prefix_avg_rating", "last_item_avg_minus_prefix_item_avg"]
    return _linear(spark, sf_dir, *names, described=True)


DOM_SQL = f"""WITH {SAMPLES_SQL} SELECT user_id, prefix_length,
    round(greatest(n0, n1, n2, n3, n4, n5) / prefix_length, 9) AS prefix_cat_dom_ratio FROM s"""
ENTROPY_SQL = f"""WITH {SAMPLES_SQL},
    cells AS (SELECT user_id, prefix_length, unnest([n0, n1, n2, n3, n4, n5]) AS n FROM s),
    h AS (SELECT user_id, prefix_length, sum(CASE WHEN n > 0 THEN
            -(n / prefix_length) * ln(n / prefix_length) ELSE 0 END) AS h
          FROM cells GROUP BY ALL)
    SELECT user_id, prefix_length, round(h, 9) + 0.0 AS prefix_cat_entropy_dynamic,
      round(h / ln(6), 9) + 0.0 AS prefix_cat_norm_entropy_dynamic FROM h"""


@query("derived_dom_ratio", DOM_SQL)
def derived_dom_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _linear(spark, sf_dir, "prefix_cat_dom_ratio", category_counts=True)


@query("derived_entropy", ENTROPY_SQL)
def derived_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["prefix_cat_entropy_dynamic", "prefix_cat_norm_entropy_dynamic"]
    return _linear(spark, sf_dir, *names, category_counts=True)


@query("derived_dom_long", DOM_SQL)
def derived_dom_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _without_counts(spark, sf_dir, "prefix_cat_dom_ratio")


@query("derived_entropy_long", ENTROPY_SQL)
def derived_entropy_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["prefix_cat_entropy_dynamic", "prefix_cat_norm_entropy_dynamic"]
    return _without_counts(spark, sf_dir, *names)


@query(
    "derived_logs",
    f"""WITH {SAMPLES_SQL}, {STATIC_SQL} SELECT s.user_id, prefix_length,
    round(ln(1 + total_purchases), 9) AS log_total_purchases,
    round(ln(1 + prefix_length), 9) AS log_prefix_length
    FROM s LEFT JOIN totals ON s.user_id = totals.user_id""",
)
def derived_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _boosting(spark, sf_dir, "log_total_purchases", "log_prefix_length")


@query(
    "derived_frac_total",
    f"""WITH {SAMPLES_SQL}, {STATIC_SQL} SELECT s.user_id, prefix_length,
    round(prefix_length / total_purchases, 9) AS prefix_length_frac_total
    FROM s LEFT JOIN totals ON s.user_id = totals.user_id""",
)
def derived_frac_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _boosting(spark, sf_dir, "prefix_length_frac_total")


@query(
    "derived_tempo",
    f"""WITH {SAMPLES_SQL} SELECT user_id, prefix_length,
    round({DAYS}, 4) AS prefix_timespan_days,
    round(CASE WHEN prefix_timespan = 0 THEN prefix_length ELSE prefix_length / {DAYS} END, 9)
      AS prefix_purchases_per_day FROM s""",
)
def derived_tempo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days are compared to four digits: microseconds over a day's length often end in an
    exact half at the ninth, which engines round either way."""
    tempo = _boosting(spark, sf_dir, "prefix_timespan_days", "prefix_purchases_per_day")
    return tempo.withColumn("prefix_timespan_days", F.round("prefix_timespan_days", 4))
