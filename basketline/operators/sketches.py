"""Distinct users as stored, mergeable sketches.

A sketch per category or product is made once; the users of any subset of them, or of old and
new reviews together, then come from merging a few small values instead of the reviews.
The relative standard error is about 0.8 / sqrt(2 ** lg_k), and small sets are exact. The
partial sketches of a hot key meet in its one merge; none is larger than 2 ** lg_k bytes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sketches of up to 16 KiB with a standard error of 0.65 %.
LG_K = 14


def user_sketches(reviews: DataFrame, keys: list[str], lg_k: int = LG_K) -> DataFrame:
    """One row per key: number of reviews and the sketch of their users.

    Null users count as reviews, not as users; a null key is a key of its own. With no
    keys the whole table is one row, also when it is empty.
    """
    return reviews.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_reviews"),
        F.hll_sketch_agg("user_id", F.lit(lg_k)).alias("users"),
    )


def merged(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """Sketches over coarser keys, or of several tables put together by ``unionByName``.

    Tables of different ``lg_k`` may be merged; the coarser one decides the error.
    """
    return sketches.groupBy(*keys).agg(
        F.coalesce(F.sum("n_reviews"), F.lit(0)).alias("n_reviews"),
        F.hll_union_agg("users", F.lit(True)).alias("users"),
    )


def n_users(sketch: str = "users") -> Column:
    """The estimated number of distinct users; 0 without a sketch."""
    return F.coalesce(F.hll_sketch_estimate(sketch), F.lit(0)).cast("long")
