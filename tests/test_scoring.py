import math

import pytest
from pyspark.sql import functions as F

from basketline.operators import counting, scoring
from tests.helpers import as_set, rows

SCHEMA = "user_id string, num_purchases long, category string"
COUNTS = [("u1", 3, "Books"), ("u2", 5, "Movies_and_TV"), ("u3", 2, "Books"), ("u1", 4, "Movies_and_TV")]
NAMES = ["Books", "Movies_and_TV"]


@pytest.fixture
def counts(spark):
    return spark.createDataFrame(COUNTS, SCHEMA)


def smoothed(values):
    shifted = [v + 1e-9 for v in values]
    total = sum(shifted)
    return -sum(v / total * math.log(v / total) for v in shifted)


def test_pivot_and_totals(counts):
    assert as_set(scoring.user_pivot(counts, NAMES), "user_id", *NAMES) == {
        ("u1", 3, 4), ("u2", 0, 5), ("u3", 2, 0),
    }
    assert as_set(scoring.user_totals(counts)) == {("u1", 7, 2), ("u2", 5, 1), ("u3", 2, 1)}


def test_scores_match_the_dense_formula(counts):
    scored = {r["user_id"]: r for r in scoring.user_scores(counts, NAMES, True).collect()}
    for user, cells in {"u1": (3, 4), "u2": (0, 5), "u3": (2, 0)}.items():
        entropy = smoothed(cells)
        row = scored[user]
        assert (row["Books"], row["Movies_and_TV"]) == cells
        assert row["entropy"] == pytest.approx(entropy, abs=1e-14)
        assert row["norm_entropy"] == pytest.approx(entropy / math.log(2), abs=1e-14)
        assert row["importance"] == pytest.approx(sum(cells) * (1 + entropy / math.log(2)))


def test_exact_entropy(counts):
    found = dict(rows(scoring.user_entropy(counts)))
    want = -(3 / 7 * math.log(3 / 7) + 4 / 7 * math.log(4 / 7))
    assert found["u1"] == pytest.approx(want) and found["u2"] == 0.0


def test_one_category_has_no_entropy(spark):
    only = spark.createDataFrame([("u1", 3, "Books")], SCHEMA)
    row = scoring.user_scores(only, ["Books"]).first()
    assert row["norm_entropy"] == 0.0 and row["importance"] == 3.0


def test_top_users_reach_all_thresholds(spark):
    data = [(f"u{i}", 1 + i, c) for i in range(20) for c in ("a", "b", "c")]
    data += [("many", 500, "a"), ("few", 1, "a")]
    counts = spark.createDataFrame(data, SCHEMA)
    scores = scoring.user_scores(counts, ["a", "b", "c"])
    for exact_rows in (5, 1000):
        top = scoring.top_users(scores, percentile=0.9, exact_rows=exact_rows)
        assert as_set(top, "user_id") == {("u19",), ("u18",)}


def test_null_ids_drop_out_and_empty_ids_stay(spark):
    reviews = spark.createDataFrame(
        [("a", None), ("a", ""), ("a", "u"), ("a", "u")], "category string, user_id string"
    )
    assert as_set(counting.user_counts(reviews)) == {("a", "", 1), ("a", "u", 2)}


def test_histograms_and_bins(spark):
    counts = spark.createDataFrame([("a", f"u{i}", n) for i, n in enumerate([1, 1, 2, 51, 900])],
                                   "category string, user_id string, num_purchases long")
    hist = counting.purchases_histogram(counts)
    assert as_set(hist) == {("a", 1, 2), ("a", 2, 1), ("a", 50, 2)}
    assert as_set(counting.equal_width_bins(hist, "purchases")) == {("a", 0, 2), ("a", 1, 1), ("a", 49, 2)}
    single = hist.where(F.col("purchases") == 2)
    assert as_set(counting.equal_width_bins(single, "purchases")) == {("a", 25, 1)}


def test_a_category_without_prices(spark):
    items = spark.createDataFrame([("a", None), ("a", None), ("b", 2.0)], "category string, price double")
    assert as_set(counting.item_stats(items), "category", "n_items", "price_count", "price_mean") == {
        ("a", 2, 0, None), ("b", 1, 1, 2.0),
    }
