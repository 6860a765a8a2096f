"""Explicit schemas. Raw polymorphic JSON fields are read as VARIANT so that the
JSON type (text, number, boolean, list, explicit null) is still known when they
are coerced."""

from pyspark.sql.types import (
    ArrayType,
    BooleanType,
    DoubleType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
    VariantType,
)

CORRUPT = "_corrupt_record"


def _struct(**fields) -> StructType:
    return StructType([StructField(name, dtype, True) for name, dtype in fields.items()])


REVIEWS_RAW = _struct(
    user_id=StringType(),
    asin=VariantType(),
    product_id=VariantType(),
    item_id=VariantType(),
    id=VariantType(),
    rating=VariantType(),
    helpful_votes=VariantType(),
    helpful_vote=VariantType(),
    timestamp=VariantType(),
    unixReviewTime=VariantType(),
    unix_review_time=VariantType(),
    unix_time=VariantType(),
    verified_purchase=VariantType(),
    verified=VariantType(),
)

ITEMS_RAW = _struct(
    parent_asin=VariantType(),
    asin=VariantType(),
    avg_rating=VariantType(),
    average_rating=VariantType(),
    rating=VariantType(),
    categories=VariantType(),
    category=VariantType(),
    rating_number=VariantType(),
    price=VariantType(),
)

REVIEWS = _struct(
    category=StringType(),
    user_id=StringType(),
    product_id=StringType(),
    unixReviewTime=LongType(),
    rating=DoubleType(),
    helpful_votes=IntegerType(),
    verified_purchase=BooleanType(),
)

ITEMS = _struct(
    category=StringType(),
    product_id=StringType(),
    item_avg_rating=DoubleType(),
    item_categories=ArrayType(StringType()),
    rating_number=IntegerType(),
    price=DoubleType(),
)

USER_COUNTS = _struct(category=StringType(), user_id=StringType(), num_purchases=LongType())

TOP_USER_REVIEWS = _struct(
    category=StringType(),
    user_id=StringType(),
    product_id=StringType(),
    unixReviewTime=LongType(),
    rating=DoubleType(),
    helpful_votes=IntegerType(),
    helpful_votes_clipped=IntegerType(),
    verified_purchase=BooleanType(),
    item_avg_rating=DoubleType(),
    item_categories=ArrayType(StringType()),
)

USER_FEATURES = _struct(
    category=StringType(),
    user_id=StringType(),
    num_purchases_in_category=LongType(),
    avg_rating_in_category=DoubleType(),
    avg_helpful_vote_in_category=DoubleType(),
    avg_item_avg_rating=DoubleType(),
    first_review_time=LongType(),
    last_review_time=LongType(),
)

ITEM_FEATURES = _struct(
    category=StringType(),
    product_id=StringType(),
    num_topuser_reviews=LongType(),
    num_unique_topusers=LongType(),
    avg_rating_topusers=DoubleType(),
    avg_helpful_votes_topusers=DoubleType(),
    first_review_time=LongType(),
    last_review_time=LongType(),
    item_avg_rating_meta=DoubleType(),
    item_categories_meta=ArrayType(StringType()),
)

METRICS = _struct(
    run=StringType(), split=StringType(), metric=StringType(), value=DoubleType()
)
