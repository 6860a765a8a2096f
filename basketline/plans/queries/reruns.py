"""The batch stages run, and run again, over ``events`` as reviews."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketline.plans import driver_tables as tables
from basketline.plans import stages
from basketline.plans.registry import query
from basketline.sources import categories as dims
from basketline.sources import tables as stage_tables
from basketline.staging import scratch_path

EV = tables.EVENT_REVIEWS_SQL
NONE = 10**9


def _ingested(spark: SparkSession, sf_dir: str) -> tuple[stages.Tables, list[str]]:
    """Events and parts as the tables that the ingest stage leaves."""
    out = stages.Tables(scratch_path(spark, "stage-tables"))
    reviews = tables.event_reviews(spark, sf_dir).drop("event_id")
    items = tables.part_items(spark, sf_dir).select(*stages.ITEM_LINES.names)
    out.write(reviews, "reviews")
    out.write(items, "items")
    return out, dims.categories_in(reviews)


@query(
    "stage_rerun_subset",
    f"""WITH {EV} SELECT category, count(*) AS n_reviews, count(DISTINCT user_id) AS n_users
    FROM ev GROUP BY category""",
)
def stage_rerun_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics after all categories were counted, and one of them again."""
    out, names = _ingested(spark, sf_dir)
    stages.build_user_counts(spark, out, names)
    stages.build_user_counts(spark, out, names[:1])
    stats = stage_tables.read_json(spark, out.path("review_stats"))
    numbers = F.from_json("stats", "n_reviews long, n_users long")
    return stats.select("category", numbers.alias("s")).select("category", "s.n_reviews", "s.n_users")


FEATURE_TABLES = ("top_user_reviews", "user_features", "item_features", "top_user_stats")


@query(
    "stage_rerun_shrinks",
    f"""WITH {EV} SELECT unnest({list(FEATURE_TABLES)}) AS name,
    CAST(0 * count(*) AS BIGINT) AS n_rows FROM ev""",
)
def stage_rerun_shrinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the feature tables after users were selected, and then none."""
    out, names = _ingested(spark, sf_dir)
    stages.build_user_counts(spark, out, names)
    stages.select_users(spark, out, names)
    stages.extract_features(spark, out, names)
    stages.select_users(spark, out, names, min_purchases=NONE)
    stages.extract_features(spark, out, names)
    counts = None
    for name in FEATURE_TABLES:
        table = stage_tables.read_json(spark, out.path(name)) if name.endswith("stats") else out.read(spark, name)
        row = table.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("name"), "n_rows")
        counts = row if counts is None else counts.unionAll(row)
    return counts


@query(
    "stage_empty_selection",
    f"""WITH {EV}, n AS (SELECT 'prefix_cat_count_' || category AS name FROM ev GROUP BY category)
    SELECT CAST(0 AS BIGINT) AS n_rows, CAST(count(*) AS BIGINT) AS n_count_columns FROM n""",
)
def stage_empty_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sample table of a run in which no user qualified: no rows, all columns."""
    out, names = _ingested(spark, sf_dir)
    stages.build_user_counts(spark, out)
    stages.select_users(spark, out, names, min_purchases=NONE)
    stages.extract_features(spark, out)
    stages.create_sequences(spark, out, names)
    samples = stages.load_samples(spark, out)
    counted = [c for c in samples.columns if c.startswith("prefix_cat_count_") and not c.endswith("_Unknown")]
    return samples.agg(F.count("user_id").alias("n_rows")).withColumn(
        "n_count_columns", F.lit(len(counted)).cast("long")
    )
