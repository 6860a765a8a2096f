"""Sequence samples over ``events``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketline.operators import counting, features, scoring
from basketline.operators.sequences import sequence_samples
from basketline.plans import driver_tables as tables
from basketline.plans.registry import query, rounded
from basketline.sources.categories import categories_in, with_category_index
from basketline.sources.tables import write_bucketed
from basketline.staging import scratch_path
from basketline.streaming.growing_sequences import SequenceStore

SAMPLES_SQL = f"""
{tables.EVENT_REVIEWS_SQL}, {tables.ITEMS_SQL}, {tables.EVENT_CATEGORIES_SQL},
e AS (
  SELECT ev.*, coalesce(cats.idx, 0) AS idx, items.item_avg_rating AS ia
  FROM ev LEFT JOIN cats ON ev.category = cats.category
          LEFT JOIN items ON ev.product_id = items.product_id
),
steps AS (
  SELECT user_id, event_id, t, category, idx, rating, helpful_votes, ia, verified,
    CAST(row_number() OVER w AS INTEGER) AS prefix_length,
    t - min(t) OVER run AS prefix_timespan,
    avg(rating) OVER run AS prefix_avg_rating,
    CAST(sum(coalesce(helpful_votes, 0)) OVER run AS DOUBLE) / row_number() OVER w
      AS prefix_avg_helpful,
    avg(ia) OVER run AS prefix_avg_item_avg_rating,
    CAST(coalesce(lag(idx, 1) OVER w, 0) AS INTEGER) AS last_2_category_idx,
    CAST(coalesce(lag(idx, 2) OVER w, 0) AS INTEGER) AS last_3_category_idx,
    CAST(coalesce(lag(idx, 3) OVER w, 0) AS INTEGER) AS last_4_category_idx,
    CAST(coalesce(lag(idx, 4) OVER w, 0) AS INTEGER) AS last_5_category_idx,
    CAST(count(*) FILTER (idx = 0) OVER run AS BIGINT) AS n0,
    CAST(count(*) FILTER (idx = 1) OVER run AS BIGINT) AS n1,
    CAST(count(*) FILTER (idx = 2) OVER run AS BIGINT) AS n2,
    CAST(count(*) FILTER (idx = 3) OVER run AS BIGINT) AS n3,
    CAST(count(*) FILTER (idx = 4) OVER run AS BIGINT) AS n4,
    CAST(count(*) FILTER (idx = 5) OVER run AS BIGINT) AS n5,
    lead(idx) OVER w AS target_category_idx,
    lead(category) OVER w AS target_category
  FROM e
  WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id),
         run AS (PARTITION BY user_id ORDER BY t, event_id
                 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
),
s AS (
  SELECT user_id, prefix_length, prefix_timespan, prefix_avg_rating, prefix_avg_helpful,
    prefix_avg_item_avg_rating, idx AS last_category_idx, rating AS last_rating,
    CAST(helpful_votes AS DOUBLE) AS last_helpful_votes, ia AS last_item_avg_rating,
    CAST(verified AS INTEGER) AS last_verified, idx AS last_1_category_idx,
    last_2_category_idx, last_3_category_idx, last_4_category_idx, last_5_category_idx,
    n0, n1, n2, n3, n4, n5,
    CAST(CASE greatest(n0, n1, n2, n3, n4, n5)
      WHEN n0 THEN 0 WHEN n1 THEN 1 WHEN n2 THEN 2 WHEN n3 THEN 3 WHEN n4 THEN 4 ELSE 5 END
      AS INTEGER) AS prefix_most_freq_category_idx,
    target_category_idx, target_category
  FROM steps WHERE prefix_length >= 3 AND target_category_idx IS NOT NULL
)"""

COUNT_COLUMNS_SQL = """
n0 AS "prefix_cat_count_Unknown", n1 AS prefix_cat_count_click, n2 AS prefix_cat_count_error,
n3 AS prefix_cat_count_purchase, n4 AS prefix_cat_count_signup, n5 AS prefix_cat_count_view"""

STATIC_SQL = """
totals AS (
  SELECT user_id, count(*) AS total_purchases, count(DISTINCT category) AS distinct_categories
  FROM ev GROUP BY user_id
)"""

ALL_COLUMNS_SQL = f"""
user_id, prefix_length, prefix_timespan, round(prefix_avg_rating, 9) AS prefix_avg_rating,
round(prefix_avg_helpful, 9) AS prefix_avg_helpful,
round(prefix_avg_item_avg_rating, 9) AS prefix_avg_item_avg_rating, last_category_idx,
last_rating, last_helpful_votes, last_item_avg_rating, last_verified, last_1_category_idx,
last_2_category_idx, last_3_category_idx, last_4_category_idx, last_5_category_idx,
{COUNT_COLUMNS_SQL}, prefix_most_freq_category_idx, target_category_idx, target_category"""


def event_samples(
    spark: SparkSession, sf_dir: str, described: bool = False, **options
) -> DataFrame:
    """Samples of the whole ``events`` table; ``described`` adds item ratings."""
    source = tables.described_event_reviews if described else tables.event_reviews
    reviews = source(spark, sf_dir)
    options = {"category_counts": False, "tie_break": ["event_id"]} | options
    return sequence_samples(reviews, event_categories(spark, sf_dir), **options)


def event_categories(spark: SparkSession, sf_dir: str) -> list[str]:
    return categories_in(tables.load(spark, sf_dir, "events"), "event_type")


def event_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.user_totals(counting.user_counts(tables.event_reviews(spark, sf_dir)))


@query(
    "seq_samples_basic",
    f"""WITH {SAMPLES_SQL}
    SELECT user_id, prefix_length, prefix_timespan,
      round(prefix_avg_rating, 9) AS prefix_avg_rating, last_category_idx, last_rating,
      last_helpful_votes, last_verified, target_category_idx, target_category FROM s""",
)
def seq_samples_basic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(
        event_samples(spark, sf_dir).select(
            "user_id", "prefix_length", "prefix_timespan", "prefix_avg_rating",
            "last_category_idx", "last_rating", "last_helpful_votes", "last_verified",
            "target_category_idx", "target_category",
        )
    )


@query(
    "seq_prefix_helpful",
    f"""WITH {SAMPLES_SQL} SELECT user_id, prefix_length,
    round(prefix_avg_helpful, 9) AS prefix_avg_helpful, last_helpful_votes FROM s""",
)
def seq_prefix_helpful(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = event_samples(spark, sf_dir)
    return rounded(
        samples.select("user_id", "prefix_length", "prefix_avg_helpful", "last_helpful_votes")
    )


@query(
    "seq_prefix_item_avg",
    f"""WITH {SAMPLES_SQL} SELECT user_id, prefix_length,
    round(prefix_avg_item_avg_rating, 9) AS prefix_avg_item_avg_rating,
    last_item_avg_rating FROM s""",
)
def seq_prefix_item_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = event_samples(spark, sf_dir, described=True)
    return rounded(
        samples.select(
            "user_id", "prefix_length", "prefix_avg_item_avg_rating", "last_item_avg_rating"
        )
    )


@query(
    "seq_last_n",
    f"""WITH {SAMPLES_SQL} SELECT user_id, prefix_length, last_1_category_idx,
    last_2_category_idx, last_3_category_idx, last_4_category_idx, last_5_category_idx FROM s""",
)
def seq_last_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    latest = [f"last_{k}_category_idx" for k in range(1, 6)]
    return event_samples(spark, sf_dir).select("user_id", "prefix_length", *latest)


@query(
    "seq_cat_counts",
    f"WITH {SAMPLES_SQL} SELECT user_id, prefix_length, {COUNT_COLUMNS_SQL} FROM s",
)
def seq_cat_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = event_samples(spark, sf_dir, category_counts=True)
    counts = [c for c in samples.columns if c.startswith("prefix_cat_count_")]
    return samples.select("user_id", "prefix_length", *counts)


@query(
    "seq_most_freq",
    f"""WITH {SAMPLES_SQL} SELECT user_id, prefix_length, prefix_most_freq_category_idx,
    target_category_idx FROM s""",
)
def seq_most_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_samples(spark, sf_dir).select(
        "user_id", "prefix_length", "prefix_most_freq_category_idx", "target_category_idx"
    )


@query(
    "seq_stride",
    f"""WITH {SAMPLES_SQL} SELECT user_id, prefix_length, last_category_idx,
    target_category_idx FROM s WHERE (prefix_length - 3) % 4 = 0""",
)
def seq_stride(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stride operator: every 4th prefix becomes a sample."""
    return event_samples(spark, sf_dir, every_k_prefix=4).select(
        "user_id", "prefix_length", "last_category_idx", "target_category_idx"
    )


@query(
    "seq_with_static",
    f"""WITH {SAMPLES_SQL}, {STATIC_SQL}
    SELECT s.user_id, prefix_length, total_purchases, distinct_categories, target_category_idx
    FROM s LEFT JOIN totals ON s.user_id = totals.user_id""",
)
def seq_with_static(spark: SparkSession, sf_dir: str) -> DataFrame:
    static = event_totals(spark, sf_dir)
    return event_samples(spark, sf_dir, static=static).select(
        "user_id", "prefix_length", "total_purchases", "distinct_categories",
        "target_category_idx",
    )


@query(
    "seq_bucketed",
    f"""WITH {SAMPLES_SQL}, {STATIC_SQL}
    SELECT s.user_id, prefix_length, prefix_timespan, prefix_most_freq_category_idx,
      total_purchases, distinct_categories, target_category_idx
    FROM s LEFT JOIN totals ON s.user_id = totals.user_id""",
)
def seq_bucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows and the join of static features over two tables in buckets by user."""
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def stored(table: DataFrame, label: str) -> DataFrame:
        path = scratch_path(spark, label)
        return write_bucketed(table, f"{label}_{path.rsplit('-', 1)[1]}", path, buckets)

    reviews = stored(tables.event_reviews(spark, sf_dir), "reviews")
    totals = stored(event_totals(spark, sf_dir), "totals")
    samples = sequence_samples(
        reviews, event_categories(spark, sf_dir), totals, category_counts=False,
        tie_break=["event_id"], sizes=totals, by_user=True,
    )
    return samples.select(
        "user_id", "prefix_length", "prefix_timespan", "prefix_most_freq_category_idx",
        "total_purchases", "distinct_categories", "target_category_idx",
    )


@query("seq_full_row", f"WITH {SAMPLES_SQL} SELECT {ALL_COLUMNS_SQL} FROM s")
def seq_full_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(event_samples(spark, sf_dir, described=True, category_counts=True))


@query("seq_hot_users", f"WITH {SAMPLES_SQL} SELECT {ALL_COLUMNS_SQL} FROM s")
def seq_hot_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The full row again, users of average size and more being cut into chunks."""
    options = {"hot_user_rows": 66, "chunk_rows": 1_000}
    return rounded(
        event_samples(spark, sf_dir, described=True, category_counts=True, **options)
    )


@query(
    "seq_orders",
    f"""WITH {tables.ORDER_REVIEWS_SQL},
    cats AS (SELECT p_brand AS category, CAST(row_number() OVER (ORDER BY p_brand) AS INTEGER) AS idx
             FROM (SELECT DISTINCT p_brand FROM part)),
    e AS (SELECT li.*, cats.idx FROM li JOIN cats ON li.category = cats.category),
    in_category AS (
      SELECT *, count(*) OVER (PARTITION BY user_id, idx
        ORDER BY t, l_orderkey, l_linenumber, product_id, l_suppkey
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS rc FROM e),
    steps AS (
      SELECT user_id, CAST(row_number() OVER w AS INTEGER) AS prefix_length,
        t - min(t) OVER run AS prefix_timespan,
        CAST(sum(helpful_votes) OVER run AS DOUBLE) / row_number() OVER w AS prefix_avg_helpful,
        avg(rating) OVER run AS prefix_avg_rating, idx AS last_category_idx,
        CAST(coalesce(lag(idx, 1) OVER w, 0) AS INTEGER) AS last_2_category_idx,
        CAST(coalesce(lag(idx, 4) OVER w, 0) AS INTEGER) AS last_5_category_idx,
        -(max({{'rc': rc, 'neg': -idx}}) OVER run).neg AS prefix_most_freq_category_idx,
        lead(idx) OVER w AS target_category_idx, lead(category) OVER w AS target_category
      FROM in_category
      WINDOW w AS (PARTITION BY user_id ORDER BY t, l_orderkey, l_linenumber, product_id, l_suppkey),
        run AS (PARTITION BY user_id ORDER BY t, l_orderkey, l_linenumber, product_id, l_suppkey
                ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
    SELECT user_id, prefix_length, prefix_timespan,
      round(prefix_avg_helpful, 9) AS prefix_avg_helpful,
      round(prefix_avg_rating, 9) AS prefix_avg_rating, last_category_idx, last_2_category_idx,
      last_5_category_idx,
      CAST(prefix_most_freq_category_idx AS INTEGER) AS prefix_most_freq_category_idx,
      target_category_idx, target_category
    FROM steps WHERE prefix_length >= 3 AND target_category_idx IS NOT NULL""",
)
def seq_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples over the order lines: 25 categories, times with ties."""
    categories = categories_in(tables.load(spark, sf_dir, "part"), "p_brand")
    samples = sequence_samples(
        tables.order_reviews(spark, sf_dir), categories,
        category_counts=False, tie_break=tables.ORDER_TIE_BREAK,
    )
    return rounded(
        samples.select(
            "user_id", "prefix_length", "prefix_timespan", "prefix_avg_helpful",
            "prefix_avg_rating", "last_category_idx", "last_2_category_idx",
            "last_5_category_idx", "prefix_most_freq_category_idx", "target_category_idx",
            "target_category",
        )
    )


@query(
    "static_first_category",
    f"""WITH {tables.EVENT_REVIEWS_SQL}, {tables.EVENT_CATEGORIES_SQL},
    f AS (SELECT user_id, idx, count(product_id) AS num_purchases_in_category,
            avg(rating) AS avg_rating_in_category
          FROM ev JOIN cats ON ev.category = cats.category GROUP BY user_id, idx)
    SELECT user_id, num_purchases_in_category,
      round(avg_rating_in_category, 9) AS avg_rating_in_category
    FROM f QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY idx) = 1""",
)
def static_first_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    reviews = tables.described_event_reviews(spark, sf_dir)
    per_category = features.user_features(reviews, event_totals(spark, sf_dir)).select(
        "user_id", "category", "num_purchases_in_category", "avg_rating_in_category"
    )
    indexed = with_category_index(per_category, event_categories(spark, sf_dir))
    return rounded(features.static_user_features(indexed))


#: The middle of the events' time, so that there are histories on both sides.
AS_OF_SQL = """cut AS (SELECT CAST(floor((min(epoch_us(ts)) + max(epoch_us(ts))) / 2) AS BIGINT) AS t0 FROM events)"""


@query(
    "seq_as_of",
    f"""WITH {SAMPLES_SQL}, {AS_OF_SQL},
    past AS (SELECT user_id, count(*) AS past_purchases, count(DISTINCT category) AS past_categories,
        round(avg(rating), 9) AS past_avg_rating FROM ev, cut WHERE t <= t0 GROUP BY user_id),
    n AS (SELECT user_id, prefix_length, lead(t) OVER (PARTITION BY user_id ORDER BY t, event_id) AS t1 FROM steps)
    SELECT n.user_id, n.prefix_length, past_purchases, past_categories, past_avg_rating
    FROM n JOIN cut ON t1 > t0 LEFT JOIN past ON n.user_id = past.user_id WHERE n.prefix_length >= 3""",
)
def seq_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples of purchases after a time, with features of the time before it only."""
    reviews = tables.event_reviews(spark, sf_dir)
    low, high = reviews.agg(F.min("unixReviewTime"), F.max("unixReviewTime")).first()
    as_of = (low + high) // 2
    samples = event_samples(
        spark, sf_dir, static=features.static_as_of(reviews, as_of), as_of=as_of
    )
    return rounded(
        samples.select("user_id", "prefix_length", "past_purchases", "past_categories", "past_avg_rating")
    )


@query("seq_incremental", f"WITH {SAMPLES_SQL} SELECT {ALL_COLUMNS_SQL} FROM s")
def seq_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The full row again, the reviews coming in three batches, the second one twice."""
    reviews = tables.described_event_reviews(spark, sf_dir)
    time = F.col("unixReviewTime")
    low, high = tables.event_reviews(spark, sf_dir).agg(F.min(time), F.max(time)).first()
    third = (high - low) // 3
    parts = [
        time < low + third,
        (time >= low + third) & (time < low + 2 * third),
        time >= low + 2 * third,
    ]
    store = SequenceStore(
        spark, scratch_path(spark, "growing"), event_categories(spark, sf_dir), tie_break=["event_id"]
    )
    for n in (0, 1, 1, 2):
        store.append(reviews.where(parts[n]), n)
    return rounded(store.samples())
