"""Raw review and item records from JSON lines (plain or gzip)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from basketline import schemas
from basketline.functions import coerce

#: ``<category>.jsonl.gz`` and ``meta_<category>.jsonl.gz``.
FILE_PER_CATEGORY = r"/(?:meta_)?([^/]+?)\.jsonl(?:\.gz)?$"
#: ``.../category=<category>/...``.
FOLDER_PER_CATEGORY = r"/category=([^/]+)/"


def category_of_file(pattern: str = FILE_PER_CATEGORY) -> Column:
    """Category of a row, from the path of the file it came from."""
    path = F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))
    return F.regexp_extract(F.url_decode(path), pattern, 1)


def _read_lines(
    spark: SparkSession, path, schema: StructType, lenient: bool, category: Column
) -> DataFrame:
    reader = spark.read.option("recursiveFileLookup", "true")
    if not lenient:
        return (
            reader.schema(schema)
            .option("mode", "FAILFAST")
            .json(path)
            .select(category.alias("source_category"), "*")
        )
    with_corrupt = StructType(
        schema.fields + [StructField(schemas.CORRUPT, StringType(), True)]
    )
    return (
        reader.schema(with_corrupt)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", schemas.CORRUPT)
        .json(path)
        .select(category.alias("source_category"), "*")
    )


def read_review_lines(
    spark: SparkSession, path, lenient: bool = True, category: Column | None = None
) -> DataFrame:
    """Review records with raw fields.

    Strict mode fails on the first malformed line. Lenient mode keeps malformed
    lines in ``_corrupt_record``; ``clean_reviews`` drops them and
    ``count_rejects`` reports them.
    """
    category = category_of_file() if category is None else category
    return _read_lines(spark, path, schemas.REVIEWS_RAW, lenient, category)


def read_item_lines(
    spark: SparkSession, path, lenient: bool = True, category: Column | None = None
) -> DataFrame:
    """Item records with raw fields and their line order.

    ``path`` may be ``None`` when a category has no item file: the result is
    then empty with the full schema. A gzip file is read by one task, so
    ``line_order`` grows along each file.
    """
    category = category_of_file() if category is None else category
    if path is None:
        empty = spark.createDataFrame([], schemas.ITEMS_RAW)
        rows = empty.select(F.lit(None).cast("string").alias("source_category"), "*")
    else:
        rows = _read_lines(spark, path, schemas.ITEMS_RAW, lenient, category)
    return rows.withColumn("line_order", F.monotonically_increasing_id())


def _well_formed(raw: DataFrame) -> DataFrame:
    if schemas.CORRUPT not in raw.columns:
        return raw
    return raw.where(F.col(schemas.CORRUPT).isNull()).drop(schemas.CORRUPT)


def _time_field() -> Column:
    c = F.col
    return coerce.first_truthy(c("timestamp"), c("unixReviewTime"), c("unix_review_time"), c("unix_time"))


def count_rejects(raw: DataFrame, probe: str) -> DataFrame:
    """Lines, malformed lines and lines whose ``probe`` field is missing, per category; for
    reviews also well-formed lines whose rating is unreadable, and whose time is or is missing."""
    counts = {
        "n_lines": F.count(F.lit(1)),
        "n_malformed": F.count_if(F.col(schemas.CORRUPT).isNotNull()),
        "n_without_key": F.count_if(F.col(probe).isNull()),
    }
    if "unixReviewTime" in raw.columns:
        whole = F.col(schemas.CORRUPT).isNull()
        rating = F.col("rating").isNotNull() & coerce.to_double(F.col("rating")).isNull()
        counts["n_bad_rating"] = F.count_if(whole & rating)
        counts["n_bad_time"] = F.count_if(whole & coerce.to_whole(_time_field(), "long").isNull())
    category = F.col("source_category").alias("category")
    return raw.groupBy(category).agg(*[value.alias(name) for name, value in counts.items()])


def clean_reviews(
    raw: DataFrame,
    helpful_fields: tuple[str, ...] = ("helpful_votes", "helpful_vote"),
    time_unit: str = "s",
) -> DataFrame:
    """Typed reviews: malformed lines and rows without a user are dropped."""
    c = F.col
    product = coerce.first_truthy(c("asin"), c("product_id"), c("item_id"), c("id"))
    time = _time_field()
    verified = coerce.is_truthy(c("verified_purchase")) | coerce.is_truthy(c("verified"))
    return (
        _well_formed(raw)
        .where(c("user_id").isNotNull())
        .select(
            c("source_category").alias("category"),
            "user_id",
            coerce.to_text(product).alias("product_id"),
            coerce.normalise_time(coerce.to_whole(time, "long"), time_unit).alias(
                "unixReviewTime"
            ),
            coerce.to_double(c("rating")).alias("rating"),
            coerce.helpful_votes(*[c(f) for f in helpful_fields]).alias("helpful_votes"),
            verified.alias("verified_purchase"),
        )
    )


def clean_items(raw: DataFrame, item_key: tuple[str, ...] = ("parent_asin", "asin")) -> DataFrame:
    """Typed items, one row per line; ``features.latest_items`` keeps the last per key."""
    c = F.col
    return _well_formed(raw).select(
        c("source_category").alias("category"),
        coerce.to_text(coerce.first_truthy(*[c(k) for k in item_key])).alias("product_id"),
        coerce.first_double(c("avg_rating"), c("average_rating"), c("rating")).alias(
            "item_avg_rating"
        ),
        coerce.flat_categories(c("categories"), c("category")).alias("item_categories"),
        coerce.to_whole(c("rating_number"), "int").alias("rating_number"),
        coerce.to_double(c("price")).alias("price"),
        "line_order",
    )
