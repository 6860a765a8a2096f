"""User scoring over the order lines (25 categories, most users lack some)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketline.operators import counting, scoring, sketches
from basketline.plans import driver_tables as tables
from basketline.plans.registry import query, rounded
from basketline.sources import tables as stage_tables
from basketline.sources.categories import categories_in

LI, EV = tables.ORDER_REVIEWS_SQL, tables.EVENT_REVIEWS_SQL

TOTALS_SQL = """
n AS (SELECT user_id, category, CAST(count(*) AS BIGINT) AS c FROM li GROUP BY ALL),
u AS (SELECT user_id, CAST(sum(c) AS BIGINT) AS total_purchases,
        count(*) AS distinct_categories FROM n GROUP BY user_id)"""

#: Dense: every user meets every category, as the definition has it.
SCORES_SQL = f"""
{LI}, {TOTALS_SQL},
k AS (SELECT DISTINCT p_brand AS category FROM part),
size AS (SELECT CAST(count(*) AS DOUBLE) AS kk FROM k),
dense AS (
  SELECT u.user_id, (coalesce(n.c, 0) + 1e-9) / (total_purchases + kk * 1e-9) AS p
  FROM u CROSS JOIN k CROSS JOIN size
  LEFT JOIN n ON n.user_id = u.user_id AND n.category = k.category
),
h AS (SELECT user_id, -sum(p * ln(p)) AS entropy FROM dense GROUP BY user_id),
scores AS (
  SELECT u.user_id, total_purchases, distinct_categories, entropy,
    entropy / ln(kk) AS norm_entropy, total_purchases * (1 + entropy / ln(kk)) AS importance
  FROM u JOIN h ON u.user_id = h.user_id CROSS JOIN size
),
threshold AS (SELECT quantile_cont(importance, 0.95) AS cut FROM scores),
top AS (
  SELECT scores.* FROM scores CROSS JOIN threshold
  WHERE round(importance, 9) >= round(cut, 9)
    AND total_purchases >= 3 AND distinct_categories >= 3
)"""

SCORE_COLUMNS_SQL = """user_id, total_purchases, distinct_categories,
round(entropy, 9) AS entropy, round(norm_entropy, 9) AS norm_entropy,
round(importance, 9) AS importance"""


def order_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counting.user_counts(tables.order_reviews(spark, sf_dir))


def brands(spark: SparkSession, sf_dir: str) -> list[str]:
    return categories_in(tables.load(spark, sf_dir, "part"), "p_brand")


def order_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.user_scores(order_counts(spark, sf_dir), brands(spark, sf_dir))


def order_top_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.top_users(order_scores(spark, sf_dir))


@query(
    "user_counts_union",
    f"""WITH {LI}, {EV}, u AS (SELECT category, user_id FROM li UNION ALL
                               SELECT category, user_id FROM ev)
    SELECT category, user_id, count(*) AS num_purchases FROM u GROUP BY ALL""",
)
def user_counts_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stage_tables.union_tables(
        order_counts(spark, sf_dir), counting.user_counts(tables.event_reviews(spark, sf_dir))
    )


PIVOT_SQL = ", ".join(
    f"""CAST(count(*) FILTER (category = 'Brand#{i}') AS BIGINT) AS "Brand#{i}\""""
    for i in range(1, 26)
)


@query("user_pivot", f"WITH {LI} SELECT user_id, {PIVOT_SQL} FROM li GROUP BY user_id")
def user_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.user_pivot(order_counts(spark, sf_dir), brands(spark, sf_dir))


@query(
    "user_totals",
    f"WITH {LI}, {TOTALS_SQL} SELECT user_id, total_purchases, distinct_categories FROM u",
)
def user_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.user_totals(order_counts(spark, sf_dir))


@query(
    "user_entropy_exact",
    f"""WITH {LI}, {TOTALS_SQL}
    SELECT n.user_id,
      round(greatest(0.0, -sum(c / total_purchases * ln(c / total_purchases))), 9) AS entropy
    FROM n JOIN u ON n.user_id = u.user_id GROUP BY n.user_id""",
)
def user_entropy_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(scoring.user_entropy(order_counts(spark, sf_dir)))


@query("user_importance", f"WITH {SCORES_SQL} SELECT {SCORE_COLUMNS_SQL} FROM scores")
def user_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(order_scores(spark, sf_dir))


@query("importance_threshold", f"WITH {SCORES_SQL} SELECT round(cut, 9) AS threshold FROM threshold")
def importance_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact quantile, found through the sketch and bracket at any table size."""
    scores = scoring.stage(order_scores(spark, sf_dir), "user-scores")
    cut = scoring.importance_threshold(scores, exact_rows=1_000)
    return rounded(spark.createDataFrame([(cut,)], "threshold double"))


@query("top_users", f"WITH {SCORES_SQL} SELECT {SCORE_COLUMNS_SQL} FROM top")
def top_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(order_top_users(spark, sf_dir))


@query(
    "top_users_wide",
    f"""WITH {SCORES_SQL},
    wide AS (SELECT user_id, {PIVOT_SQL} FROM li GROUP BY user_id)
    SELECT wide.*, total_purchases, distinct_categories, round(entropy, 9) AS entropy,
      round(norm_entropy, 9) AS norm_entropy, round(importance, 9) AS importance
    FROM top JOIN wide ON top.user_id = wide.user_id""",
)
def top_users_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top users with one column per category, the table the later stages join."""
    counts, names = order_counts(spark, sf_dir), brands(spark, sf_dir)
    return rounded(scoring.top_users(scoring.user_scores(counts, names, True)))


@query("distinct_users", f"WITH {LI} SELECT DISTINCT user_id FROM li")
def distinct_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.order_reviews(spark, sf_dir).select("user_id").distinct()


@query(
    "distinct_users_sketch",
    f"""WITH {LI}, sets AS (
      SELECT category, user_id FROM li UNION ALL SELECT 'all', user_id FROM li
      UNION ALL SELECT 'from Brand#3', user_id FROM li WHERE category >= 'Brand#3')
    SELECT category, count(*) AS n_reviews, count(DISTINCT user_id) AS n_users,
      TRUE AS error_below_2_percent
    FROM sets GROUP BY category""",
)
def distinct_users_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users per category, of all and of some categories, from stored sketches of two parts."""
    reviews = tables.order_reviews(spark, sf_dir)
    odd = F.col("l_orderkey") % 2 == 1
    parts = [sketches.user_sketches(reviews.where(p), ["category"]) for p in (odd, ~odd)]
    stored = scoring.stage(parts[0].unionByName(parts[1]), "user-sketches")
    some = stored.where(F.col("category") >= "Brand#3")

    def named(table: DataFrame, name: str) -> DataFrame:
        return sketches.merged(table, []).withColumn("category", F.lit(name))

    estimated = (
        sketches.merged(stored, ["category"])
        .unionByName(named(stored, "all"))
        .unionByName(named(some, "from Brand#3"))
        .select("category", "n_reviews", sketches.n_users().alias("estimate"))
    )
    pairs = reviews.select("category", "user_id").distinct()
    exact = (
        pairs.unionByName(pairs.select("user_id").distinct().withColumn("category", F.lit("all")))
        .unionByName(
            pairs.where(F.col("category") >= "Brand#3").select("user_id").distinct()
            .withColumn("category", F.lit("from Brand#3"))
        )
        .groupBy("category").agg(F.count("user_id").alias("n_users"))
    )
    close = F.abs(F.col("estimate") - F.col("n_users")) < 0.02 * F.col("n_users")
    return estimated.join(exact, "category").select(
        "category", "n_reviews", "n_users", close.alias("error_below_2_percent")
    )
