import math

import pytest
from pyspark.sql import functions as F

from basketline.operators import baselines, derived, metrics, splitting
from tests.helpers import as_set, rows

PAIRS = [(1, 1), (1, 2), (2, 2), (2, 2), (3, 1), (3, 3), (3, 3), (4, 1)]


@pytest.fixture
def scored(spark):
    return spark.createDataFrame(PAIRS, "y int, p int")


def test_class_report_by_hand(scored):
    report = {r["class"]: r for r in metrics.class_report(scored, "y", "p").collect()}
    assert report["1"]["precision"] == pytest.approx(1 / 3)
    assert report["1"]["recall"] == 0.5 and report["1"]["f1"] == pytest.approx(0.4)
    assert (report["4"]["precision"], report["4"]["recall"], report["4"]["f1"]) == (0, 0, 0)
    assert report["3"]["support"] == 3 and report["accuracy"]["f1"] == pytest.approx(5 / 8)
    f1 = {c: report[c]["f1"] for c in "1234"}
    assert report["macro avg"]["f1"] == pytest.approx(sum(f1.values()) / 4)
    support = {"1": 2, "2": 2, "3": 3, "4": 1}
    assert report["weighted avg"]["f1"] == pytest.approx(sum(f1[c] * support[c] for c in f1) / 8)


def test_top_k_ties_and_missing_labels(spark):
    df = spark.createDataFrame(
        [(0, [1.0, 1.0, 1.0, 1.0]), (1, [1.0, 1.0, 1.0, 1.0]), (0, [9.0, 1.0, 2.0, 3.0]),
         (1, [9.0, 1.0, 2.0, 3.0]), (7, [9.0, 1.0, 2.0, 3.0])],
        "y int, s array<double>",
    )
    hits = df.select(metrics.in_top_k(F.col("s"), F.col("y"), 3))
    assert [h for (h,) in rows(hits)] == [False, True, True, False, False]


def test_class_weights(spark):
    df = spark.createDataFrame([(1,)] * 9 + [(2,)] * 1, "y int")
    weights = dict(rows(metrics.class_weights(df, "y"), "y", "weight"))
    assert weights[2] / weights[1] == pytest.approx(3.0)
    assert (9 * weights[1] + weights[2]) / 10 == pytest.approx(1.0)
    assert dict(rows(metrics.balanced_class_weights(df, "y"), "y", "weight")) == {1: 10 / 18, 2: 5.0}


def test_majority_ties_go_to_the_smallest_index(spark):
    schema = "user_id string, target_category_idx int, target_category string, last_category_idx int"
    df = spark.createDataFrame(
        [("u", 2, "b", 2), ("u", 2, "b", 1), ("v", 1, "a", 1), ("v", 1, "a", 2), ("v", 3, "c", 3)], schema
    )
    assert rows(baselines.majority_category(df)) == [(1, "a", 0.4)]
    assert rows(baselines.user_majority_in_sample(df)) == [(4, 5, 0.8)]
    assert rows(baselines.last_category(df)) == [(3, 5, 0.6)]


def test_best_model_takes_the_first_name_on_ties(spark):
    df = spark.createDataFrame([("b", 0.5), ("a", 0.5), ("c", 0.4)], "model string, val_acc double")
    assert rows(metrics.best_model(df), "model") == [("a",)]
    assert as_set(metrics.rank_models(df), "model", "rank") == {("a", 1), ("b", 2), ("c", 3)}


def test_derived_features_by_hand(spark):
    df = spark.createDataFrame(
        [(3, 0, 0, 2, 1), (4, 172800, 10, 4, 0)],
        "prefix_length int, prefix_timespan long, total_purchases long, prefix_cat_count_a long, "
        "prefix_cat_count_b long",
    )
    none, two = derived.boosting_features(derived.linear_features(df)).orderBy("prefix_length").collect()
    assert none["prefix_reviews_per_day"] is None and none["prefix_purchases_per_day"] == 3.0
    assert none["prefix_length_frac_total"] == 0.0 and none["log_total_purchases"] == 0.0
    entropy = -(2 / 3 * math.log(2 / 3) + 1 / 3 * math.log(1 / 3))
    assert none["prefix_cat_entropy_dynamic"] == pytest.approx(entropy)
    assert none["prefix_cat_norm_entropy_dynamic"] == pytest.approx(entropy / math.log(2))
    assert two["prefix_reviews_per_day"] == 2.0 and two["prefix_timespan_days"] == 2.0
    assert two["prefix_length_frac_total"] == 0.4 and two["prefix_cat_dom_ratio"] == 1.0
    assert two["prefix_cat_entropy_dynamic"] == 0.0
    assert two["log_prefix_length"] == pytest.approx(math.log(5))


def test_one_count_column_has_no_normalised_entropy(spark):
    df = spark.createDataFrame([(0,)], "prefix_cat_count_a long")
    row = derived.linear_features(df).first()
    assert row["prefix_cat_norm_entropy_dynamic"] is None and row["prefix_cat_dom_ratio"] is None


def test_splits_share_no_user(spark):
    sizes = dict(rows(splitting.bucket_splits(spark).groupBy("split").count()))
    assert sizes == {"train": 204, "val": 25, "test": 27}
    df = spark.range(3000).select((F.col("id") % 500).cast("string").alias("user_id"))
    per_user = splitting.with_split(df).groupBy("user_id").agg(F.count_distinct("split").alias("n"))
    assert per_user.agg(F.max("n")).first()[0] == 1
    assert splitting.with_split(df).count() == 3000


def test_row_caps(spark):
    df = spark.range(4000).select(
        (F.col("id") % 7).cast("string").alias("user_id"), F.col("id").alias("prefix_length")
    )
    bucketed = splitting.with_user_bucket(df)
    assert splitting.cap_rows(bucketed, 1000, exact_rows=50).count() == 1000
    capped = splitting.cap_rows_by_bucket(bucketed, 1000, exact_rows=50)
    sizes = rows(capped.groupBy("user_bucket").count().orderBy("user_bucket"))
    whole = dict(rows(bucketed.groupBy("user_bucket").count()))
    assert sum(n for _, n in sizes) == 1000
    assert all(n == whole[b] for b, n in sizes[:-1])
    assert splitting.cap_rows_by_bucket(bucketed, 9000).count() == 4000
