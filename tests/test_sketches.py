import pytest
from pyspark.sql import functions as F

from basketline.operators.sketches import merged, n_users, user_sketches
from tests.helpers import rows

SCHEMA = "category string, product_id string, user_id string"


def test_small_sets_are_exact_with_nulls_and_repeats(spark):
    reviews = spark.createDataFrame(
        [("a", "p", "u1"), ("a", "p", "u1"), ("a", "q", "u2"), ("b", "p", None), (None, "p", "u1"), ("b", "r", "u3")],
        SCHEMA,
    )
    products = user_sketches(reviews, ["category", "product_id"])
    found = rows(products.select("category", "product_id", "n_reviews", n_users()))
    assert set(found) == {("a", "p", 2, 1), ("a", "q", 1, 1), ("b", "p", 1, 0), (None, "p", 1, 1), ("b", "r", 1, 1)}
    per_category = merged(products, ["category"])
    assert set(rows(per_category.select("category", "n_reviews", n_users()))) == {
        ("a", 3, 2), ("b", 2, 1), (None, 1, 1),
    }
    assert rows(merged(per_category, []).select("n_reviews", n_users())) == [(6, 3)]


def test_an_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert rows(user_sketches(empty, ["category"])) == []
    assert rows(user_sketches(empty, []).select("n_reviews", n_users())) == [(0, 0)]
    assert rows(merged(user_sketches(empty, ["category"]), []).select("n_reviews", n_users())) == [(0, 0)]


@pytest.mark.parametrize("lg_k, error", [(14, 0.02), (10, 0.1)])
def test_stored_parts_merge_within_the_error(spark, tmp_path, lg_k, error):
    """100,000 users in overlapping days and categories, a third of all rows from one of them."""
    users = F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 100_003)
    reviews = spark.range(300_000).select(
        (F.col("id") % 7).cast("string").alias("category"), users.cast("string").alias("user_id"),
        (F.col("id") % 2).alias("day"),
    )
    for day in (0, 1):
        part = user_sketches(reviews.where(F.col("day") == day), ["category"], lg_k)
        part.write.parquet(str(tmp_path / f"day{day}"))
    stored = spark.read.parquet(str(tmp_path / "day0")).unionByName(spark.read.parquet(str(tmp_path / "day1")))
    some = F.col("category").isin("1", "4", "6")
    for condition in (F.lit(True), some):
        total, found = merged(stored.where(condition), []).select("n_reviews", n_users()).first()
        exact = reviews.where(condition).select("user_id").distinct().count()
        assert total == reviews.where(condition).count()
        assert abs(found - exact) <= error * exact
