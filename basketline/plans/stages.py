"""The batch stages, from raw lines to training samples, as tables under one folder.

Each stage reads the tables of the stages before and writes its own, so a stage can
be run again alone. ``categories`` limits a stage to some categories: it then reads
and replaces only their partitions.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from basketline import config, schemas
from basketline.operators import baselines, counting, features, scoring
from basketline.operators.sequences import sequence_samples
from basketline.sources import categories as dims
from basketline.sources import raw, tables
from basketline.staging import stage


@dataclass(frozen=True)
class Tables:
    """Where the stage tables are. Each has its schema stored beside it, so that a table
    without rows, which has no file, still has its columns and types."""

    root: str

    def path(self, name: str) -> str:
        return f"{self.root.rstrip('/')}/{name}"

    def read(self, spark: SparkSession, name: str, schema=None, categories=None) -> DataFrame:
        if schema is None:
            stored = spark.read.schema("value string").text(self.path(f"_schemas/{name}"), wholetext=True)
            schema = StructType.fromJson(json.loads(stored.first()[0]))
        return tables.read_table(spark, self.path(name), schema, categories)

    def write(
        self,
        df: DataFrame,
        name: str,
        partition_by: tuple[str, ...] = ("category",),
        categories: list[str] | None = None,
    ) -> None:
        """Replace a table, or the partitions of ``categories``."""
        if partition_by:
            tables.write_table(df, self.path(name), partition_by, categories=categories)
        else:
            df.write.mode("overwrite").parquet(self.path(name))
        schema = df.sparkSession.range(1).select(F.lit(df.schema.json()).alias("value"))
        schema.coalesce(1).write.mode("overwrite").option("lineSep", " ").text(self.path(f"_schemas/{name}"))


ITEM_LINES = schemas.StructType(
    schemas.ITEMS.fields + [schemas.StructField("line_order", schemas.LongType(), True)]
)


def ingest(
    spark: SparkSession,
    out: Tables,
    review_path,
    item_path=None,
    lenient: bool = True,
    time_unit: str = "s",
) -> None:
    """Raw JSON lines to typed tables.

    A gzip file is read by one task. This stage pays that once; all later stages read
    evenly sized Parquet files, and only the columns and categories they need.
    """
    reviews = raw.clean_reviews(raw.read_review_lines(spark, review_path, lenient), time_unit=time_unit)
    out.write(reviews, "reviews")
    items = raw.clean_items(raw.read_item_lines(spark, item_path, lenient))
    out.write(items, "items")


def build_user_counts(
    spark: SparkSession, out: Tables, categories: list[str] | None = None
) -> None:
    """Purchases per user and category; review and item statistics with histograms."""
    reviews = out.read(spark, "reviews", schemas.REVIEWS, categories)
    items = out.read(spark, "items", ITEM_LINES, categories)
    out.write(counting.user_counts(reviews), "user_counts", categories=categories)
    counts = out.read(spark, "user_counts", schemas.USER_COUNTS, categories)
    maps = {
        "rating_hist": (counting.rating_histogram(reviews), "rating"),
        "helpful_hist": (counting.helpful_histogram(reviews), "helpful"),
        "purchases_hist": (counting.purchases_histogram(counts), "purchases"),
    }
    _write_stats(out, "review_stats", counting.review_stats(reviews), maps, categories)
    numbers = {"rating_number_hist": (counting.rating_number_histogram(items), "rating_number")}
    _write_stats(out, "meta_stats", counting.item_stats(items), numbers, categories)


def _write_stats(out: Tables, name: str, scalars: DataFrame, maps: dict, categories) -> None:
    folded = {n: tables.histogram_map(hist, bucket, name=n) for n, (hist, bucket) in maps.items()}
    tables.write_json(tables.stats_as_json(scalars, folded), out.path(name), categories)


def select_users(
    spark: SparkSession,
    out: Tables,
    names: list[str],
    percentile: float = config.IMPORTANCE_PERCENTILE,
    min_purchases: int = config.MIN_TOTAL_PURCHASES,
    min_categories: int = config.MIN_DISTINCT_CATEGORIES,
) -> None:
    """Score all users and keep the most important ones, one column per category."""
    counts = out.read(spark, "user_counts", schemas.USER_COUNTS)
    present = [n for n in names if n in set(dims.categories_in(counts))]
    counts = tables.only_categories(counts, present)
    scores = scoring.user_scores(counts, present, with_category_columns=True)
    top = scoring.top_users(scores, percentile, min_purchases, min_categories)
    out.write(top, "top_users", ())
    totals = counting.user_totals_histogram(scoring.user_totals(counts))
    out.write(totals, "user_totals_hist", ())


def extract_features(
    spark: SparkSession, out: Tables, categories: list[str] | None = None
) -> None:
    """Reviews, user features and item features of the selected users."""
    top = out.read(spark, "top_users")
    reviews = out.read(spark, "reviews", schemas.REVIEWS, categories)
    items = stage(features.latest_items(out.read(spark, "items", ITEM_LINES, categories)), "latest-items")
    out.write(features.top_user_reviews(reviews, top, items), "top_user_reviews", categories=categories)
    kept = out.read(spark, "top_user_reviews", schemas.TOP_USER_REVIEWS, categories)
    out.write(features.user_features(kept, top), "user_features", categories=categories)
    out.write(features.item_features(kept, items), "item_features", categories=categories)
    ratings, helpful = features.top_user_histograms(kept)
    maps = {"rating_hist": (ratings, "rating"), "helpful_hist": (helpful, "helpful")}
    _write_stats(out, "top_user_stats", features.top_user_stats(kept), maps, categories)


def create_sequences(
    spark: SparkSession, out: Tables, names: list[str], **options
) -> DataFrame:
    """Training samples of all categories together, and their rule baselines.

    Returns the expected categories for which a feature table is missing; they are
    left out.
    """
    reviews = out.read(spark, "top_user_reviews", schemas.TOP_USER_REVIEWS)
    per_category = out.read(spark, "user_features")
    per_item = out.read(spark, "item_features", schemas.ITEM_FEATURES)
    expected = dims.category_dim(spark, names).where(F.col("category").isin(*names))
    missing = dims.missing_categories(expected, reviews, per_category, per_item)
    lacking = {row["category"] for row in missing.collect()}
    # When nothing was selected, the empty sample table has the columns of all categories.
    present = [n for n in names if n not in lacking] or names

    static = features.static_user_features(
        dims.with_category_index(tables.only_categories(per_category, present), present)
    )
    sizes = out.read(spark, "top_users").select("user_id", "total_purchases")
    samples = sequence_samples(
        tables.only_categories(reviews, present), present, static, sizes=sizes, **options
    )
    out.write(samples, "sequence_samples", ())
    stored = load_samples(spark, out)
    out.write(_baselines(stored), "baselines", ())
    return missing


def _baselines(samples: DataFrame) -> DataFrame:
    rules = {
        "majority": baselines.majority_category,
        "user_majority_in_sample": baselines.user_majority_in_sample,
        "last_category": baselines.last_category,
        "prefix_favourite": baselines.prefix_favourite,
    }
    rows = [
        rule(samples).select(F.lit(name).alias("baseline"), "accuracy")
        for name, rule in rules.items()
    ]
    return tables.union_tables(*rows)


def load_samples(spark: SparkSession, out: Tables) -> DataFrame:
    return out.read(spark, "sequence_samples")


def run_all(
    spark: SparkSession,
    out: Tables,
    review_path,
    item_path,
    names: list[str],
    lenient: bool = True,
    time_unit: str = "s",
    **options,
) -> DataFrame:
    """All stages in order; returns rows and columns of the sample table."""
    ingest(spark, out, review_path, item_path, lenient, time_unit)
    build_user_counts(spark, out, names)
    select_users(spark, out, names)
    extract_features(spark, out, names)
    create_sequences(spark, out, names, **options)
    return tables.describe_table(load_samples(spark, out))
