"""User buckets, splits, row caps and subsets of ``events`` samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketline.operators import splitting
from basketline.operators.order_stats import seeded_subset
from basketline.plans import driver_tables as tables
from basketline.plans.queries.sequences import SAMPLES_SQL, event_samples
from basketline.plans.registry import query
from basketline.plans.training import TUNING_SEED
from basketline.staging import stage

#: ``sp``: samples ``s`` with their bucket and split. 204 + 25 + 27 of 256 buckets.
SPLIT_SQL = """
buckets AS (
  SELECT CAST(range AS INTEGER) AS user_bucket, row_number() OVER (ORDER BY
    CAST('0x' || substr(md5('42|' || CAST(range AS VARCHAR)), 1, 13) AS BIGINT), range) AS place
  FROM range(256)),
splits AS (
  SELECT user_bucket, CASE WHEN place <= 204 THEN 'train' WHEN place <= 229 THEN 'val'
    ELSE 'test' END AS split FROM buckets),
sp AS (
  SELECT s.*, splits.user_bucket, split FROM s JOIN splits ON splits.user_bucket =
    CAST('0x' || substr(md5(s.user_id), 1, 8) AS BIGINT) % 256)"""

ROW_HASH_SQL = """CAST('0x' || substr(md5('42|' || user_id || '|' ||
  CAST(prefix_length AS VARCHAR)), 1, 13) AS BIGINT)"""


@query(
    "user_bucket",
    f"""WITH {tables.ORDER_REVIEWS_SQL} SELECT DISTINCT user_id,
    CAST(CAST('0x' || substr(md5(user_id), 1, 8) AS BIGINT) % 256 AS INTEGER) AS user_bucket
    FROM li""",
)
def user_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = tables.order_reviews(spark, sf_dir).select("user_id").distinct()
    return splitting.with_user_bucket(users)


@query(
    "user_split",
    f"""WITH {SAMPLES_SQL}, {SPLIT_SQL}
    SELECT user_id, prefix_length, user_bucket, split FROM sp""",
)
def user_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.with_split(event_samples(spark, sf_dir)).select(
        "user_id", "prefix_length", "user_bucket", "split"
    )


CAP = 5_000


def _stored_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = event_samples(spark, sf_dir).select("user_id", "prefix_length", "target_category_idx")
    return stage(splitting.with_split(samples), "samples")


@query(
    "split_cap",
    f"""WITH {SAMPLES_SQL}, {SPLIT_SQL}
    SELECT user_id, prefix_length, split FROM sp WHERE split = 'train'
    QUALIFY row_number() OVER (ORDER BY {ROW_HASH_SQL}, user_id, prefix_length) <= {CAP}""",
)
def split_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The row cap of a training split, spread over all buckets."""
    train = _stored_samples(spark, sf_dir).where(F.col("split") == "train")
    capped = splitting.cap_rows(train, CAP, exact_rows=1_000)
    return capped.select("user_id", "prefix_length", "split")


@query(
    "split_cap_by_bucket",
    f"""WITH {SAMPLES_SQL}, {SPLIT_SQL},
    sized AS (SELECT user_bucket, count(*) AS n FROM sp WHERE split = 'train' GROUP BY ALL),
    run AS (SELECT user_bucket, n, sum(n) OVER (ORDER BY user_bucket) AS upto FROM sized),
    ranked AS (
      SELECT user_id, prefix_length, sp.user_bucket, row_number() OVER (
          PARTITION BY sp.user_bucket ORDER BY {ROW_HASH_SQL}, user_id, prefix_length) AS place,
        {CAP} - (upto - n) AS room
      FROM sp JOIN run ON sp.user_bucket = run.user_bucket WHERE split = 'train')
    SELECT user_id, prefix_length, user_bucket FROM ranked WHERE place <= room""",
)
def split_cap_by_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The row cap that takes whole buckets in order."""
    train = _stored_samples(spark, sf_dir).where(F.col("split") == "train")
    capped = splitting.cap_rows_by_bucket(train, CAP, exact_rows=50)
    return capped.select("user_id", "prefix_length", "user_bucket")


@query(
    "tuning_subset",
    f"""WITH {SAMPLES_SQL}
    SELECT user_id, prefix_length, target_category_idx FROM s
    QUALIFY row_number() OVER (ORDER BY
      CAST('0x' || substr(md5('11|' || user_id || '|' || CAST(prefix_length AS VARCHAR)), 1, 13)
        AS BIGINT), user_id, prefix_length) <= 2000""",
)
def tuning_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The seeded subset on which hyperparameters are tried."""
    samples = _stored_samples(spark, sf_dir)
    subset = seeded_subset(samples, 2000, splitting.SAMPLE_KEY, seed=TUNING_SEED, exact_rows=1_000)
    return subset.select("user_id", "prefix_length", "target_category_idx")
