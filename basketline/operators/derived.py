"""Features computed from the columns of a sample; no shuffle, all in one projection.

A function adds only what its input columns allow, so it also works on samples
without static features or category counts.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketline.functions.coerce import TICKS_PER_SECOND, clip_low
from basketline.functions.entropy import entropy_from_sums

COUNT_PREFIX = "prefix_cat_count_"


def _days(time_unit: str) -> Column:
    return F.col("prefix_timespan") / F.lit(86_400.0 * TICKS_PER_SECOND[time_unit])


def _has(df: DataFrame, *names: str) -> bool:
    return set(names) <= set(df.columns)


def linear_features(df: DataFrame, time_unit: str = "s", n_categories: int | None = None) -> DataFrame:
    """Features for the linear models: pace, deviations from the prefix, category spread.

    The spread comes from the category counts or, without these, from the two columns of
    ``category_spread``; the number of categories, which scales the entropy, is then needed.
    """
    c, new = F.col, {}
    if _has(df, "prefix_length", "prefix_timespan"):
        new["prefix_reviews_per_day"] = F.try_divide(
            c("prefix_length").cast("double"), _days(time_unit)
        )
    if _has(df, "last_rating", "prefix_avg_rating"):
        new["last_minus_prefix_avg_rating"] = c("last_rating") - c("prefix_avg_rating")
    if _has(df, "last_item_avg_rating", "prefix_avg_item_avg_rating"):
        new["last_item_avg_minus_prefix_item_avg"] = c("last_item_avg_rating") - c(
            "prefix_avg_item_avg_rating"
        )
    return df.withColumns(new | _category_spread(df, n_categories))


def _norm(entropy: Column, n_categories: int | None) -> Column:
    if n_categories is None or n_categories <= 1:
        return F.lit(None).cast("double")
    return entropy / math.log(n_categories)


def _category_spread(df: DataFrame, n_categories: int | None) -> dict[str, Column]:
    counts = [F.col(f"`{n}`") for n in df.columns if n.startswith(COUNT_PREFIX)]
    if not counts and _has(df, "prefix_length", "prefix_cat_max", "prefix_cat_n_log_n"):
        total = F.col("prefix_length").cast("double")
        entropy = entropy_from_sums(total, F.col("prefix_cat_n_log_n"))
        return {
            "prefix_cat_dom_ratio": F.try_divide(F.col("prefix_cat_max"), total),
            "prefix_cat_entropy_dynamic": entropy,
            "prefix_cat_norm_entropy_dynamic": _norm(entropy, n_categories),
        }
    if not counts:
        return {}
    total = reduce(add, counts)
    largest = F.greatest(*counts) if len(counts) > 1 else counts[0]

    def part(count: Column) -> Column:
        share = count / total
        return F.when(count > 0, -share * F.ln(share)).otherwise(F.lit(0.0))

    entropy = reduce(add, [part(count) for count in counts])
    return {
        "prefix_cat_dom_ratio": F.try_divide(largest, total),
        "prefix_cat_entropy_dynamic": entropy,
        "prefix_cat_norm_entropy_dynamic": _norm(entropy, len(counts)),
    }


def boosting_features(df: DataFrame, time_unit: str = "s") -> DataFrame:
    """Features for boosted trees: log sizes, progress through the history, pace."""
    c, new = F.col, {}
    if _has(df, "total_purchases"):
        new["log_total_purchases"] = F.log1p(clip_low(c("total_purchases")))
    if _has(df, "prefix_length"):
        new["log_prefix_length"] = F.log1p(clip_low(c("prefix_length")))
    if _has(df, "prefix_length", "total_purchases"):
        share = F.try_divide(c("prefix_length"), c("total_purchases"))
        new["prefix_length_frac_total"] = F.coalesce(share, F.lit(0.0))
    if _has(df, "prefix_timespan"):
        new["prefix_timespan_days"] = _days(time_unit)
        if _has(df, "prefix_length"):
            pace = F.try_divide(c("prefix_length").cast("double"), _days(time_unit))
            new["prefix_purchases_per_day"] = F.coalesce(pace, c("prefix_length").cast("double"))
    return df.withColumns(new)
