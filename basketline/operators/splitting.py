"""User-disjoint splits and row caps.

Splits are made of user buckets, so no user is in two of them. Everything about
buckets is a table of at most a few hundred rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from basketline.config import (
    EXACT_RANK_ROWS,
    RANDOM_SEED,
    TRAIN_SPLIT,
    USER_BUCKETS,
    VAL_SPLIT,
)
from basketline.functions.hashing import seeded_rank_hash, user_bucket
from basketline.operators.order_stats import seeded_subset

SAMPLE_KEY = ["user_id", "prefix_length"]


def with_user_bucket(df: DataFrame, buckets: int = USER_BUCKETS) -> DataFrame:
    return df.withColumn("user_bucket", user_bucket(F.col("user_id"), buckets))


def bucket_splits(
    spark: SparkSession,
    buckets: int = USER_BUCKETS,
    train: float = TRAIN_SPLIT,
    val: float = VAL_SPLIT,
    seed: int = RANDOM_SEED,
) -> DataFrame:
    """Split of each bucket: a seeded shuffle, then int(train n), int(val n) and the rest."""
    n_train, n_val = int(train * buckets), int(val * buckets)
    hashed = spark.range(buckets).select(
        F.col("id").cast("int").alias("user_bucket"),
        seeded_rank_hash(F.col("id"), seed=seed).alias("_h"),
    )
    place = F.row_number().over(Window.orderBy("_h", "user_bucket"))
    split = (
        F.when(place <= n_train, "train").when(place <= n_train + n_val, "val").otherwise("test")
    )
    return hashed.select("user_bucket", split.alias("split"))


def with_split(
    df: DataFrame,
    buckets: int = USER_BUCKETS,
    train: float = TRAIN_SPLIT,
    val: float = VAL_SPLIT,
    seed: int = RANDOM_SEED,
) -> DataFrame:
    """Add ``user_bucket`` and ``split``. The bucket table's size is a parameter, not data."""
    splits = bucket_splits(df.sparkSession, buckets, train, val, seed)
    return with_user_bucket(df, buckets).join(F.broadcast(splits), "user_bucket")


def cap_rows(
    df: DataFrame,
    max_rows: int,
    keys: list[str] = SAMPLE_KEY,
    seed: int = RANDOM_SEED,
    exact_rows: int = EXACT_RANK_ROWS,
) -> DataFrame:
    """At most ``max_rows`` rows, spread evenly over all buckets."""
    return seeded_subset(df, max_rows, keys, seed, exact_rows)


def cap_rows_by_bucket(
    df: DataFrame,
    max_rows: int,
    keys: list[str] = SAMPLE_KEY,
    seed: int = RANDOM_SEED,
    exact_rows: int = EXACT_RANK_ROWS,
) -> DataFrame:
    """At most ``max_rows`` rows: whole buckets in order, the last one subsampled.

    Needs ``user_bucket``. The bucket where the cap falls is cut by a seeded hash.
    """
    sizes = df.groupBy("user_bucket").agg(F.count(F.lit(1)).alias("n"))
    whole, edge, taken = [], None, 0
    for row in sizes.orderBy("user_bucket").collect():
        if taken + row["n"] > max_rows:
            edge = row["user_bucket"]
            break
        whole.append(row["user_bucket"])
        taken += row["n"]
    full = df.where(F.col("user_bucket").isin(whole))
    if edge is None or taken == max_rows:
        return full
    rest = df.where(F.col("user_bucket") == edge)
    return full.unionByName(seeded_subset(rest, max_rows - taken, keys, seed, exact_rows))
