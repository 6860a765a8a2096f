"""Raw records, sinks and incremental counts.

``events`` and ``part`` are written out as JSON lines with all the loose spellings that
raw records come in, then read back through the sources.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basketline import schemas
from basketline.operators import counting, features
from basketline.operators.sequences import sequence_samples
from basketline.plans import driver_tables as tables
from basketline.plans.registry import query
from basketline.sources import categories, raw
from basketline.sources import tables as stage_tables
from basketline.staging import scratch_path, stage
from basketline.streaming import running_counts

EV = tables.EVENT_REVIEWS_SQL


def _quoted(text: Column) -> Column:
    return F.concat(F.lit('"'), text, F.lit('"'))


def _field(name: str, value: Column) -> Column:
    return F.concat(F.lit(f'"{name}":'), value)


def _lines_by_category(spark: SparkSession, lines: DataFrame, label: str) -> str:
    """Write (category, value) rows as gzip text, one folder per category."""
    path = scratch_path(spark, label)
    lines.write.partitionBy("category").option("compression", "gzip").text(path)
    return path


def write_event_lines(spark: SparkSession, sf_dir: str, cut: bool, bad: bool = False) -> str:
    """``events`` as review lines.

    The field that carries the product, the votes and the time differs by event type;
    with ``cut``, signup lines of low value end early. Error events carry the product as a
    number, and the number 0 is no product. With ``bad``, some lines have no user, a rating
    that is no number, or a time that is none or missing.
    """
    c, kind = F.col, F.col("event_type")
    k = F.get_json_object("props", "$.k")
    micros = F.unix_micros(tables.utc(spark, "ts")).cast("string")
    votes = F.floor("value").cast("string")
    product = (
        F.when(kind == "click", _field("asin", _quoted(k)))
        .when(kind == "view", F.concat(F.lit('"asin":"","product_id":'), _quoted(k)))
        .when(kind == "error", F.concat(F.lit('"asin":null,"product_id":"","item_id":'), k))
        .otherwise(_field("id", _quoted(k)))
    )
    helpful = (
        F.when(kind == "click", _field("helpful_votes", votes))
        .when(kind == "view", _field("helpful_vote", _quoted(votes)))
        .when(kind == "error", F.concat(F.lit('"helpful_votes":null,"helpful_vote":'), votes))
        .when(kind == "purchase", _field("helpful_votes", F.concat(votes, F.lit(".75"))))
        .otherwise(_field("helpful_votes", _quoted(F.concat(votes, F.lit(".75")))))
    )
    time = F.when(kind == "click", _field("timestamp", micros)).otherwise(
        F.concat(F.lit('"timestamp":0,"unixReviewTime":'), _quoted(micros))
    )
    verified = (
        F.when(kind == "purchase", F.lit('"verified_purchase":true'))
        .when(kind == "view", F.lit('"verified_purchase":false,"verified":1'))
        .when(kind == "signup", F.lit('"verified":"false"'))
        .otherwise(F.lit('"verified_purchase":""'))
    )
    rating = _field("rating", F.least(F.floor(c("value") / 100) + 1, F.lit(5)).cast("string"))
    user = _field("user_id", _quoted(c("user_id").cast("string")))
    if bad:
        n = c("event_id")
        user = F.when(n % 11 == 0, F.lit('"user_id":null')).otherwise(user)
        rating = F.when(n % 13 == 1, F.lit('"rating":"n/a"')).when(n % 13 == 2, F.lit('"rating":"NaN"')).otherwise(rating)
        time = F.when(n % 17 == 3, F.lit('"timestamp":"soon"')).when(n % 17 == 4, F.lit('"timestamp":null')).otherwise(time)
    line = F.concat(F.lit("{"), F.concat_ws(",", user, product, helpful, time, verified, rating), F.lit("}"))
    if cut:
        line = F.when((kind == "signup") & (c("value") < 20), F.substring(line, 1, 25)).otherwise(line)
    events = tables.load(spark, sf_dir, "events")
    return _lines_by_category(
        spark, events.select(kind.alias("category"), line.alias("value")), "event-lines"
    )


def read_events(spark: SparkSession, path: str, lenient: bool) -> DataFrame:
    folder = raw.category_of_file(raw.FOLDER_PER_CATEGORY)
    return raw.read_review_lines(spark, path, lenient, folder)


INGESTED_SQL = """
SELECT event_type AS category, CAST(user_id AS VARCHAR) AS user_id,
  CASE WHEN event_type = 'error' THEN nullif(regexp_extract(props, '"k": *([0-9]+)', 1), '0')
    ELSE regexp_extract(props, '"k": *([0-9]+)', 1) END AS product_id,
  epoch_us(ts) AS "unixReviewTime",
  CAST(least(floor(value / 100) + 1, 5) AS DOUBLE) AS rating,
  CAST(CASE event_type WHEN 'error' THEN 0 WHEN 'signup' THEN 0 ELSE floor(value) END
    AS INTEGER) AS helpful_votes,
  event_type IN ('purchase', 'view', 'signup') AS verified_purchase
FROM events"""

NOT_CUT = "NOT (event_type = 'signup' AND value < 20)"


@query("ingest_lenient", f"{INGESTED_SQL} WHERE {NOT_CUT}")
def ingest_lenient(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Malformed lines are dropped, loose fields coerced."""
    path = write_event_lines(spark, sf_dir, cut=True)
    return raw.clean_reviews(read_events(spark, path, lenient=True))


@query("ingest_strict", INGESTED_SQL)
def ingest_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lines are well formed; one that is not would fail the job."""
    path = write_event_lines(spark, sf_dir, cut=False)
    return raw.clean_reviews(read_events(spark, path, lenient=False))


@query(
    "ingest_rejects",
    f"""SELECT event_type AS category, count(*) AS n_lines,
    count(*) FILTER (NOT ({NOT_CUT})) AS n_malformed,
    count(*) FILTER (NOT ({NOT_CUT}) OR event_id % 11 = 0) AS n_without_key,
    count(*) FILTER ({NOT_CUT} AND event_id % 13 IN (1, 2)) AS n_bad_rating,
    count(*) FILTER ({NOT_CUT} AND event_id % 17 IN (3, 4)) AS n_bad_time
    FROM events GROUP BY event_type""",
)
def ingest_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = write_event_lines(spark, sf_dir, cut=True, bad=True)
    return raw.count_rejects(read_events(spark, path, lenient=True), "user_id")


BAD_SQL = f"""
SELECT category, user_id, product_id,
  CASE WHEN event_id % 17 NOT IN (3, 4) THEN "unixReviewTime" END AS "unixReviewTime",
  CASE WHEN event_id % 13 NOT IN (1, 2) THEN rating END AS rating, helpful_votes, verified_purchase
FROM ({INGESTED_SQL.replace("FROM events", ", event_id FROM events")}) WHERE event_id % 11 <> 0"""


@query("ingest_bad", BAD_SQL)
def ingest_bad(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines without a user are dropped; unreadable ratings and times become null."""
    path = write_event_lines(spark, sf_dir, cut=False, bad=True)
    return raw.clean_reviews(read_events(spark, path, lenient=True))


@query(
    "seq_untimed",
    f"""WITH b AS ({BAD_SQL}), n AS (
      SELECT user_id, count(*) AS n FROM b WHERE "unixReviewTime" IS NOT NULL GROUP BY user_id)
    SELECT user_id, CAST(unnest(range(3, n)) AS INTEGER) AS prefix_length FROM n""",
)
def seq_untimed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples of histories from which reviews without a time are left out."""
    reviews = stage(ingest_bad(spark, sf_dir), "bad-reviews")
    names = categories.categories_in(reviews)
    return sequence_samples(reviews, names, category_counts=False).select("user_id", "prefix_length")


@query(
    "coerce_product_id",
    f"""SELECT product_id, count(*) AS n FROM ({INGESTED_SQL}) GROUP BY product_id""",
)
def coerce_product_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first non-empty of several product fields."""
    reviews = ingest_strict(spark, sf_dir)
    return reviews.groupBy("product_id").agg(F.count(F.lit(1)).alias("n"))


@query(
    "coerce_helpful",
    f"""SELECT category, helpful_votes, count(*) AS n FROM ({INGESTED_SQL}) GROUP BY ALL""",
)
def coerce_helpful(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers are cut to whole, whole text is read, other text and null count as 0."""
    reviews = ingest_strict(spark, sf_dir)
    return reviews.groupBy("category", "helpful_votes").agg(F.count(F.lit(1)).alias("n"))


@query(
    "verified_flag",
    f"""SELECT category, verified_purchase, count(*) AS n FROM ({INGESTED_SQL}) GROUP BY ALL""",
)
def verified_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Any non-empty value of either field counts as verified."""
    reviews = ingest_strict(spark, sf_dir)
    return reviews.groupBy("category", "verified_purchase").agg(F.count(F.lit(1)).alias("n"))


@query("file_category", "SELECT event_type AS category, count(*) AS n FROM events GROUP BY ALL")
def file_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The category of a line is known from its file alone."""
    path = write_event_lines(spark, sf_dir, cut=False)
    lines = read_events(spark, path, lenient=False)
    return lines.groupBy(F.col("source_category").alias("category")).agg(
        F.count(F.lit(1)).alias("n")
    )


# Items --------------------------------------------------------------------------


def ingest_part_items(spark: SparkSession, sf_dir: str, lenient: bool = True) -> DataFrame:
    """``part`` written as loose item lines and read back."""
    c = F.col
    key = F.when(
        c("p_type") == "PROMO",
        F.concat(F.lit('"parent_asin":"","asin":'), _quoted(c("p_partkey").cast("string"))),
    ).otherwise(_field("parent_asin", _quoted(c("p_partkey").cast("string"))))
    rating = F.when(
        c("p_size") < 20, F.concat(F.lit('"avg_rating":"n/a","average_rating":'), c("p_size").cast("string"))
    ).otherwise(_field("rating", _quoted(c("p_size").cast("string"))))
    labels = (
        F.when(c("p_size") % 3 == 0, _field("categories", F.concat(
            F.lit("[["), _quoted(c("p_type")), F.lit(",null],"), _quoted(c("p_brand")), F.lit(","),
            _quoted(c("p_type")), F.lit("]"))))
        .when(c("p_size") % 3 == 1, F.concat(F.lit('"categories":[],"category":'), _quoted(c("p_type"))))
        .otherwise(_field("categories", F.concat(F.lit("[null,"), _quoted(c("p_brand")), F.lit("]"))))
    )
    price = (
        F.when(c("p_size") < 10, F.lit('"price":null'))
        .when(c("p_size") < 20, F.lit('"price":"None"'))
        .when(c("p_size") < 30, _field("price", _quoted(F.concat(F.lit("$"), c("p_retailprice").cast("string")))))
        .when(c("p_size") < 40, _field("price", _quoted(c("p_retailprice").cast("string"))))
        .otherwise(_field("price", c("p_retailprice").cast("string")))
    )
    line = F.concat(F.lit("{"), F.concat_ws(",", key, rating, labels, price), F.lit("}"))
    parts = tables.load(spark, sf_dir, "part")
    path = _lines_by_category(
        spark, parts.select(c("p_type").alias("category"), line.alias("value")), "item-lines"
    )
    folder = raw.category_of_file(raw.FOLDER_PER_CATEGORY)
    return raw.clean_items(raw.read_item_lines(spark, path, lenient, folder))


ITEM_LABELS_SQL = """CASE WHEN p_size % 3 = 0 THEN p_type || '|' || p_brand
  WHEN p_size % 3 = 1 THEN p_type ELSE 'None|' || p_brand END"""


@query(
    "ingest_items_strict",
    """SELECT p_type AS category, CAST(p_partkey AS VARCHAR) AS product_id,
    CAST(p_size AS DOUBLE) AS item_avg_rating,
    CASE WHEN p_size >= 30 THEN p_retailprice END AS price FROM part""",
)
def ingest_items_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All item lines are well formed; one that is not would fail the job."""
    items = ingest_part_items(spark, sf_dir, lenient=False)
    return items.select("category", "product_id", "item_avg_rating", "price")


@query(
    "item_categories_flat",
    f"""SELECT p_type AS category, CAST(p_partkey AS VARCHAR) AS product_id,
    {ITEM_LABELS_SQL} AS labels FROM part""",
)
def item_categories_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scalar, list and list-of-lists labels as one flat list without repeats."""
    items = features.latest_items(ingest_part_items(spark, sf_dir))
    return items.select(
        "category", "product_id", F.array_join("item_categories", "|").alias("labels")
    )


@query(
    "item_rating_first_castable",
    """SELECT p_type AS category, CAST(p_partkey AS VARCHAR) AS product_id,
    CAST(p_size AS DOUBLE) AS item_avg_rating FROM part""",
)
def item_rating_first_castable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of three rating fields that is a number."""
    items = features.latest_items(ingest_part_items(spark, sf_dir))
    return items.select("category", "product_id", "item_avg_rating")


@query(
    "item_price_parse",
    """SELECT p_type AS category, count(*) AS n_items,
      count(*) FILTER (p_size >= 30) AS price_count,
      round(avg(p_retailprice) FILTER (p_size >= 30), 6) AS price_mean
    FROM part GROUP BY p_type""",
)
def item_price_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices that are null, the text None or not numeric are skipped."""
    stats = counting.item_stats(ingest_part_items(spark, sf_dir))
    return stats.select(
        "category", "n_items", "price_count", F.round("price_mean", 6).alias("price_mean")
    )


# Tables ---------------------------------------------------------------------------


@query(
    "category_dim",
    """SELECT 'Unknown' AS category, 0 AS category_idx UNION ALL
    SELECT p_brand, CAST(row_number() OVER (ORDER BY p_brand DESC) AS INTEGER)
    FROM (SELECT DISTINCT p_brand FROM part)""",
)
def category_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A category list written as text, in reverse order, and read back."""
    path = scratch_path(spark, "categories")
    names = tables.load(spark, sf_dir, "part").select(F.col("p_brand").alias("value")).distinct()
    padded = names.orderBy(F.desc("value")).select(F.concat(F.lit(" "), "value", F.lit("\n")).alias("value"))
    padded.coalesce(1).write.text(path)
    return categories.category_dim(spark, categories.read_category_list(spark, path))


@query(
    "category_names_back",
    f"""WITH {EV}, {tables.EVENT_CATEGORIES_SQL}
    SELECT coalesce(cats.category, 'Unknown') AS category, count(*) AS n
    FROM ev JOIN cats ON ev.category = cats.category GROUP BY ALL""",
)
def category_names_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Name to index and back."""
    names = categories.categories_in(tables.load(spark, sf_dir, "events"), "event_type")
    indexed = categories.with_category_index(tables.event_reviews(spark, sf_dir), names)
    named = categories.with_category_name(indexed.drop("category"), names)
    return named.groupBy("category").agg(F.count(F.lit(1)).alias("n"))


@query(
    "default_columns",
    """SELECT CAST(user_id AS VARCHAR) AS user_id, event_id, CAST(NULL AS DOUBLE) AS rating,
    0 AS helpful_votes, CAST(NULL AS DOUBLE) AS item_avg_rating, false AS verified_purchase
    FROM events""",
)
def default_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    bare = tables.event_reviews(spark, sf_dir).select("user_id", "event_id")
    return stage_tables.with_review_defaults(bare)


@query(
    "category_subset",
    f"""WITH {EV} SELECT category, user_id, count(*) AS num_purchases FROM ev
    WHERE category IN ('click', 'purchase') GROUP BY ALL""",
)
def category_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts stored by category; the scan opens two categories' folders only."""
    path = scratch_path(spark, "user-counts")
    counts = counting.user_counts(tables.event_reviews(spark, sf_dir))
    stage_tables.write_table(counts, path)
    table = stage_tables.read_table(
        spark, path, schemas.USER_COUNTS, categories=["click", "purchase"]
    )
    return table.select("category", "user_id", "num_purchases")


@query(
    "parquet_sink",
    f"""WITH {EV} SELECT category, user_id, product_id, t AS "unixReviewTime", rating,
    helpful_votes, verified AS verified_purchase FROM ev""",
)
def parquet_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews written by category with a row limit per file, and read back."""
    path = scratch_path(spark, "reviews")
    stage_tables.write_table(tables.event_reviews(spark, sf_dir), path, max_records_per_file=500)
    table = stage_tables.read_table(spark, path, schemas.REVIEWS)
    return table.select(*[f.name for f in schemas.REVIEWS])


@query(
    "bucketed_sink",
    f"""WITH {EV} SELECT user_id, event_id,
    CAST(CAST('0x' || substr(md5(user_id), 1, 8) AS BIGINT) % 256 AS INTEGER) AS user_bucket
    FROM ev""",
)
def bucketed_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews written under their user's bucket, and read back."""
    path = scratch_path(spark, "by-bucket")
    stage_tables.write_by_user_bucket(tables.event_reviews(spark, sf_dir), path)
    return stage_tables.read_table(spark, path).select("user_id", "event_id", "user_bucket")


@query(
    "dataset_shape",
    """SELECT count(*) AS n_rows, CAST(8 AS INTEGER) AS n_columns,
    'category,event_id,helpful_votes,product_id,rating,unixReviewTime,user_id,verified_purchase'
    AS column_names FROM events""",
)
def dataset_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stage_tables.describe_table(tables.event_reviews(spark, sf_dir))


@query(
    "json_sink",
    f"""WITH {EV} SELECT category, count(*) AS n_reviews, count(DISTINCT user_id) AS n_users
    FROM ev GROUP BY category""",
)
def json_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics written as JSON, one object per category, and read back."""
    stats = counting.review_stats(tables.event_reviews(spark, sf_dir))
    path = scratch_path(spark, "stats")
    stage_tables.write_json(stage_tables.stats_as_json(stats, {}), path)
    return spark.read.schema("category string, n_reviews long, n_users long").json(path)


@query(
    "incremental_counts",
    f"WITH {EV} SELECT category, user_id, count(*) AS num_purchases FROM ev GROUP BY ALL",
)
def incremental_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two arrivals of files, two runs with a compaction between them; the second run
    reads the new files only."""
    source, sink = scratch_path(spark, "arrivals"), scratch_path(spark, "running-counts")
    checkpoint = scratch_path(spark, "stream")
    reviews = tables.event_reviews(spark, sf_dir).select("category", "user_id", "verified_purchase")
    for verified in (True, False):
        part = reviews.where(F.col("verified_purchase") == F.lit(verified))
        part.write.mode("append").json(source)
        running_counts.update_user_counts(spark, source, reviews.schema, sink, checkpoint).awaitTermination()
        running_counts.compact_user_counts(spark, sink)
    return running_counts.latest_user_counts(spark, sink)
