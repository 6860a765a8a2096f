import pytest

from basketline import schemas
from basketline.operators import features
from basketline.sources import categories as dims
from basketline.sources import tables
from tests.helpers import as_set, rows

REVIEWS = (
    "category string, user_id string, product_id string, unixReviewTime long, rating double, "
    "helpful_votes int, verified_purchase boolean"
)


@pytest.fixture
def top(spark):
    return spark.createDataFrame([("u1", 12.6), ("u2", 12.5)], "user_id string, importance double")


@pytest.fixture
def items(spark):
    return spark.createDataFrame(
        [("A", "p", 4.0, ["x"]), ("B", "p", 1.0, None)],
        "category string, product_id string, item_avg_rating double, item_categories array<string>",
    )


@pytest.fixture
def kept(spark, top, items):
    reviews = spark.createDataFrame(
        [
            ("A", "u1", "p", 10, 5.0, 99, True),
            ("A", "u1", "q", 20, None, 1, False),
            ("A", "u2", "p", None, 3.0, -4, None),
            ("A", "stranger", "p", 1, 1.0, 0, True),
            ("B", "u1", None, 5, 2.0, 0, True),
        ],
        REVIEWS,
    )
    return features.top_user_reviews(reviews, top, items)


def test_only_top_users_with_item_attributes_of_their_category(kept):
    assert [f.name for f in schemas.TOP_USER_REVIEWS] == kept.columns
    assert as_set(kept, "category", "user_id", "product_id", "helpful_votes_clipped", "item_avg_rating") == {
        ("A", "u1", "p", 50, 4.0), ("A", "u1", "q", 1, None), ("A", "u2", "p", -4, 4.0),
        ("B", "u1", None, 0, None),
    }


def test_hot_top_users_are_kept_once(spark, items):
    """A user with a third of all rows is matched outside the shuffle; rows stay the same."""
    data = [("A", "hot" if i % 3 == 0 else f"u{i % 40}", "p", i, 1.0, 1, True) for i in range(900)]
    reviews = spark.createDataFrame(data, REVIEWS)
    top = spark.createDataFrame([("hot", 300), ("u1", 15), ("u7", 15)], "user_id string, total_purchases long")
    want = sorted(d[3] for d in data if d[1] in ("hot", "u1", "u7"))
    for limit in (100, 10, 10**6):
        kept = features.top_user_reviews(reviews, top, items, hot_user_rows=limit)
        assert sorted(t for (t,) in rows(kept, "unixReviewTime")) == want


def test_user_features(kept, top):
    table = features.user_features(kept, top)
    assert as_set(
        table, "category", "user_id", "num_purchases_in_category", "avg_rating_in_category",
        "avg_helpful_vote_in_category", "first_review_time", "last_review_time", "importance",
    ) == {
        ("A", "u1", 2, 5.0, 50.0, 10, 20, 12.6), ("A", "u2", 1, 3.0, -4.0, None, None, 12.5),
        ("B", "u1", 0, 2.0, 0.0, 5, 5, 12.6),
    }


def test_item_features_leave_out_missing_products(kept, items):
    table = features.item_features(kept, items)
    assert [f.name for f in schemas.ITEM_FEATURES] == table.columns
    assert as_set(
        table, "category", "product_id", "num_topuser_reviews", "num_unique_topusers",
        "avg_rating_topusers", "avg_helpful_votes_topusers", "item_avg_rating_meta",
    ) == {("A", "p", 2, 2, 4.0, 47.5, 4.0), ("A", "q", 1, 1, None, 1.0, None)}


def test_statistics_count_distinct_users(kept):
    assert as_set(features.top_user_stats(kept)) == {("A", 3, 2), ("B", 1, 1)}
    ratings, helpful = features.top_user_histograms(kept)
    assert as_set(ratings) == {("A", 5.0, 1), ("A", 3.0, 1), ("B", 2.0, 1)}
    assert as_set(helpful) == {("A", 50, 1), ("A", 1, 1), ("A", -4, 1), ("B", 0, 1)}


def test_first_category_wins(kept, top):
    table = dims.with_category_index(features.user_features(kept, top), ["B", "A"])
    static = features.static_user_features(table)
    assert as_set(static, "user_id", "num_purchases_in_category") == {("u1", 0), ("u2", 1)}


def test_category_dimension(spark, tmp_path):
    path = tmp_path / "categories.txt"
    path.write_text("  Books \n\nUnknown\nMovies_and_TV\nBooks\n\t\n")
    names = dims.read_category_list(spark, str(path))
    assert names == ["Books", "Unknown", "Movies_and_TV", "Books"]
    assert dims.category_index(names) == {"Unknown": 0, "Books": 1, "Movies_and_TV": 2}
    assert as_set(dims.category_dim(spark, names)) == {("Unknown", 0), ("Books", 1), ("Movies_and_TV", 2)}
    df = spark.createDataFrame([("Books",), ("else",), (None,)], "category string")
    assert as_set(dims.with_category_index(df, names)) == {("Books", 1), ("else", 0), (None, 0)}
    back = spark.createDataFrame([(2,), (9,)], "category_idx int")
    assert as_set(dims.with_category_name(back, names)) == {(2, "Movies_and_TV"), (9, "Unknown")}


def test_missing_categories(spark):
    def table(*names):
        return spark.createDataFrame([(n,) for n in names], "category string")

    missing = dims.missing_categories(table("a", "b", "c", "d"), table("a", "b", "x"), table("b", "c"))
    assert as_set(missing) == {("a",), ("c",), ("d",)}


def test_empty_tables_keep_their_schema(spark, top, items):
    none = features.top_user_reviews(tables.empty_like(spark, schemas.REVIEWS), top, items)
    assert none.count() == 0
    assert dict(none.dtypes) == {f.name: f.dataType.simpleString() for f in schemas.TOP_USER_REVIEWS}
    assert features.item_features(none, items).count() == 0


def test_sink_replaces_only_its_categories(spark, tmp_path):
    path = str(tmp_path / "t")
    schema = "category string, v int"
    tables.write_table(spark.createDataFrame([("a", 1), ("b", 2)], schema), path)
    tables.write_table(spark.createDataFrame([("b", 3)], schema), path, categories=["b", "z"])
    assert as_set(tables.read_table(spark, path), "category", "v") == {("a", 1), ("b", 3)}
    one = tables.read_table(spark, path, categories=["b"])
    assert rows(one, "v") == [(3,)]
    assert "PartitionFilters: [" in one._jdf.queryExecution().executedPlan().toString()
    tables.write_table(spark.createDataFrame([("a", 4)], schema), path, categories=["a", "b"])
    assert as_set(tables.read_table(spark, path), "category", "v") == {("a", 4)}
    tables.write_table(spark.createDataFrame([("c d/e", 5)], schema), path)
    assert as_set(tables.read_table(spark, path), "category", "v") == {("c d/e", 5)}
    tables.write_table(spark.createDataFrame([], schema), path, categories=["c d/e"])
    assert tables.read_table(spark, path, spark.createDataFrame([], schema).schema).count() == 0


def test_statistics_of_other_categories_stay(spark, tmp_path):
    path = str(tmp_path / "t")
    schema = "category string, stats string"
    tables.write_json(spark.createDataFrame([("a", "{1}"), ("b", "{2}")], schema), path)
    tables.write_json(spark.createDataFrame([("a", "{3}")], schema), path, ["a", "b"])
    assert as_set(tables.read_json(spark, path)) == {("a", "{3}")}
    tables.write_json(spark.createDataFrame([("c", "{4}")], schema), path, ["c"])
    assert as_set(tables.read_json(spark, path)) == {("a", "{3}"), ("c", "{4}")}
