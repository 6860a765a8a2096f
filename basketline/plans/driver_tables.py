"""The driver's tables seen as reviews, items and categories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Time unit of ``event_reviews``: microseconds keep every user's order unique.
EVENT_TIME_UNIT = "us"


#: Columns in use. Stated here, so that opening a table runs no job to infer them.
TABLES = {
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, "
    "props string",
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, "
    "l_quantity double, l_shipdate timestamp_ntz",
    "orders": "o_orderkey long, o_custkey long",
    "part": "p_partkey long, p_name string, p_brand string, p_type string, p_size int, "
    "p_retailprice double",
}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{sf_dir}/{name}.parquet")


def utc(spark: SparkSession, when: str) -> Column:
    """A zone-free column as the instant it is in UTC, whatever the session's zone."""
    zone = spark.conf.get("spark.sql.session.timeZone")
    if zone not in ("UTC", "Etc/UTC", "Z"):
        return F.convert_timezone(F.lit("UTC"), F.lit(zone), F.col(when)).cast("timestamp")
    return F.col(when).cast("timestamp")


def event_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as reviews: the event type is the category."""
    c = F.col
    return load(spark, sf_dir, "events").select(
        c("event_type").alias("category"),
        c("user_id").cast("string").alias("user_id"),
        F.get_json_object("props", "$.k").alias("product_id"),
        F.unix_micros(utc(spark, "ts")).alias("unixReviewTime"),
        F.least(F.floor(c("value") / 100) + 1, F.lit(5)).cast("double").alias("rating"),
        F.floor("value").cast("int").alias("helpful_votes"),
        (c("event_type") == "purchase").alias("verified_purchase"),
        "event_id",
    )


def order_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem`` with its order and part as reviews: the brand is the category."""
    c = F.col
    lines = load(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_shipdate"
    )
    orders = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    parts = load(spark, sf_dir, "part").select("p_partkey", "p_brand")
    joined = lines.join(orders, c("l_orderkey") == c("o_orderkey")).join(
        parts, c("l_partkey") == c("p_partkey")
    )
    return joined.select(
        c("p_brand").alias("category"),
        c("o_custkey").cast("string").alias("user_id"),
        c("l_partkey").cast("string").alias("product_id"),
        F.unix_seconds(utc(spark, "l_shipdate")).alias("unixReviewTime"),
        F.least(F.lit(5), "l_linenumber").cast("double").alias("rating"),
        c("l_quantity").cast("int").alias("helpful_votes"),
        (c("l_linenumber") == 1).alias("verified_purchase"),
        "l_orderkey",
        "l_linenumber",
        "l_suppkey",
    )


ORDER_TIE_BREAK = ["l_orderkey", "l_linenumber", "product_id", "l_suppkey"]


def part_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``part`` as items, keyed by the brand (category) and the part key."""
    c = F.col
    return load(spark, sf_dir, "part").select(
        c("p_brand").alias("category"),
        c("p_partkey").cast("string").alias("product_id"),
        (c("p_size") / 10.0).alias("item_avg_rating"),
        F.array("p_type", "p_brand").alias("item_categories"),
        c("p_size").alias("rating_number"),
        c("p_retailprice").alias("price"),
        c("p_partkey").alias("line_order"),
    )


def described_event_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``event_reviews`` with the average rating of the part of the same number."""
    items = part_items(spark, sf_dir).select("product_id", "item_avg_rating")
    return event_reviews(spark, sf_dir).join(items, "product_id", "left")


# The same views as SQL text for DuckDB. Written from the column meanings, not
# generated from the Spark code, so that a mistake in one shows up in the other.

EVENT_REVIEWS_SQL = """
ev AS (
  SELECT event_type AS category, CAST(user_id AS VARCHAR) AS user_id,
         regexp_extract(props, '"k": *([0-9]+)', 1) AS product_id,
         epoch_us(ts) AS t, CAST(least(floor(value / 100) + 1, 5) AS DOUBLE) AS rating,
         CAST(floor(value) AS INTEGER) AS helpful_votes,
         event_type = 'purchase' AS verified, event_id
  FROM events
)"""

ORDER_REVIEWS_SQL = """
li AS (
  SELECT p_brand AS category, CAST(o_custkey AS VARCHAR) AS user_id,
         CAST(l_partkey AS VARCHAR) AS product_id,
         CAST(epoch(l_shipdate) AS BIGINT) AS t,
         CAST(least(5, l_linenumber) AS DOUBLE) AS rating,
         CAST(l_quantity AS INTEGER) AS helpful_votes, l_linenumber = 1 AS verified,
         l_orderkey, l_linenumber, l_suppkey
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
)"""

ITEMS_SQL = """
items AS (
  SELECT p_brand AS category, CAST(p_partkey AS VARCHAR) AS product_id,
         p_size / 10.0 AS item_avg_rating, p_type, p_brand,
         p_size AS rating_number, p_retailprice AS price
  FROM part
)"""

EVENT_CATEGORIES_SQL = """
cats AS (
  SELECT event_type AS category,
         CAST(row_number() OVER (ORDER BY event_type) AS INTEGER) AS idx
  FROM (SELECT DISTINCT event_type FROM events)
)"""
