import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from basketline.operators.derived import linear_features
from basketline.operators.sequences import sequence_samples
from basketline.sources.tables import write_bucketed
from tests.helpers import as_set, brute_force_samples, jobs_of, physical_plan, rows, same

NAMES = ["a", "b", "Unknown", "c"]
SCHEMA = (
    "user_id string, unixReviewTime long, tie int, category string, rating double, "
    "helpful_votes int, item_avg_rating double, verified_purchase boolean"
)


def history(seed, users=12, longest=40, one_hot=False):
    rng = random.Random(seed)
    events, tie = [], 0
    for u in range(users):
        n = longest * 20 if one_hot and u == 0 else rng.randint(0, longest)
        for _ in range(n):
            tie += 1
            events.append(
                (
                    f"u{u}",
                    rng.choice([None] + [rng.randint(0, 50) for _ in range(20)]),
                    tie,
                    rng.choice(["a", "b", "c", "Unknown", "elsewhere"]),
                    rng.choice([None, 1.0, 2.0, 4.5, 5.0]),
                    rng.choice([None, 0, 3, 70]),
                    rng.choice([None, 3.2, 4.1]),
                    rng.choice([None, True, False]),
                )
            )
    rng.shuffle(events)
    return events


def check(spark, events, step=1, **options):
    df = spark.createDataFrame(events, SCHEMA)
    samples = sequence_samples(
        df, NAMES, tie_break=["tie"], every_k_prefix=step, **options
    ).collect()
    n_latest, min_prefix = options.get("n_latest", 5), options.get("min_prefix", 3)
    expected = brute_force_samples(events, NAMES, n_latest, min_prefix, step)
    assert len(samples) == len(expected)
    for row in samples:
        want = expected[(row["user_id"], row["prefix_length"])]
        for name, value in want.items():
            assert same(row[name], value), (row["user_id"], row["prefix_length"], name)


@pytest.mark.parametrize("seed", [1, 2])
def test_random_histories_match_the_definition(spark, seed):
    check(spark, history(seed))


def test_stride_short_prefix_and_one_latest(spark):
    check(spark, history(3), step=3, min_prefix=1, n_latest=1)


@pytest.mark.parametrize("chunk_rows", [2, 7, 100])
def test_users_cut_into_chunks_match_the_definition(spark, chunk_rows):
    """Chunks down to two rows: neighbours and sums cross several chunk borders."""
    events = history(4, users=5, longest=25)
    check(spark, events, hot_user_rows=4, chunk_rows=chunk_rows)


def test_one_user_with_most_of_the_rows(spark):
    check(spark, history(5, longest=30, one_hot=True), hot_user_rows=100, chunk_rows=64, n_latest=8)


def test_static_features_reach_ordinary_and_hot_users(spark):
    events = history(6, users=6, longest=30, one_hot=True)
    static = spark.createDataFrame([("u0", 7, None), ("u1", 8, 1.5)], "user_id string, s int, t double")
    df = spark.createDataFrame(events, SCHEMA)
    samples = sequence_samples(df, NAMES, static, tie_break=["tie"], hot_user_rows=60, chunk_rows=50)
    found = {(u, s, t) for u, s, t in rows(samples, "user_id", "s", "t")}
    assert ("u0", 7, None) in found and ("u1", 8, 1.5) in found
    assert all(s is None for u, s, _ in found if u not in ("u0", "u1"))
    assert len(brute_force_samples(events, NAMES)) == samples.count()


def test_copies_of_one_row_all_become_samples(spark):
    """Identical rows cannot be ordered, and none of them may get lost."""
    event = ("u", 5, 1, "a", 4.0, 1, None, True)
    df = spark.createDataFrame([event] * 300, SCHEMA).drop("tie")
    samples = sequence_samples(df, NAMES, hot_user_rows=50, chunk_rows=40)
    got = sorted(rows(samples, "prefix_length", "prefix_cat_count_a", "target_category"))
    assert got == [(n, n, "a") for n in range(3, 300)]


def test_short_histories(spark):
    def events(n, user):
        return [(user, t, t, "a", None, None, None, None) for t in range(n)]

    df = spark.createDataFrame(events(3, "three") + events(4, "four") + events(6, "six"), SCHEMA)
    all_prefixes = sequence_samples(df, NAMES, tie_break=["tie"])
    assert sorted(rows(all_prefixes, "user_id", "prefix_length")) == [
        ("four", 3), ("six", 3), ("six", 4), ("six", 5),
    ]
    second = sequence_samples(df, NAMES, tie_break=["tie"], every_k_prefix=2)
    assert sorted(rows(second, "user_id", "prefix_length")) == [("four", 3), ("six", 3), ("six", 5)]


def test_hand_written_row(spark):
    events = [
        ("u", 10, 1, "b", None, None, None, None),
        ("u", 20, 2, "a", 4.0, 3, None, None),
        ("u", 30, 3, "a", None, None, None, None),
        ("u", 40, 4, "b", None, None, None, True),
        ("u", 50, 5, "nowhere", None, None, None, None),
    ]
    df = spark.createDataFrame(events, SCHEMA)
    row = (
        sequence_samples(df, NAMES, tie_break=["tie"]).where("prefix_length = 4").first().asDict()
    )
    assert row["prefix_avg_rating"] == 4.0
    assert row["prefix_avg_helpful"] == 0.75
    assert row["prefix_timespan"] == 30
    assert row["prefix_most_freq_category_idx"] == 1
    assert [row[f"last_{k}_category_idx"] for k in range(1, 6)] == [2, 1, 1, 2, 0]
    assert row["target_category_idx"] == 0 and row["target_category"] == "nowhere"
    assert row["last_verified"] == 1


def test_missing_columns_are_defaulted(spark):
    df = spark.createDataFrame(
        [("u", t, 1) for t in range(5)], "user_id string, unixReviewTime long, category_idx int"
    )
    row = sequence_samples(df, NAMES).orderBy("prefix_length").first()
    assert row["prefix_avg_rating"] is None and row["prefix_avg_helpful"] == 0.0
    assert row["last_verified"] == 0 and row["target_category"] == "a"


def test_invariants_on_the_driver_table(spark, tiny_dir):
    from basketline.plans.queries.sequences import event_samples

    samples = event_samples(spark, tiny_dir, category_counts=True)
    counts = [c for c in samples.columns if c.startswith("prefix_cat_count_")]
    total = sum(F.col(c) for c in counts)
    broken = samples.where(
        (total != F.col("prefix_length"))
        | (F.col("last_1_category_idx") != F.col("last_category_idx"))
    )
    assert broken.count() == 0
    per_user = spark.read.parquet(f"{tiny_dir}/events.parquet").groupBy("user_id").count()
    assert samples.count() == per_user.agg(F.sum(F.greatest(F.lit(0), F.col("count") - 3))).first()[0]


def test_all_windows_share_one_shuffle(spark, tiny_dir):
    from basketline.plans.queries.sequences import event_samples

    plan = physical_plan(event_samples(spark, tiny_dir, category_counts=True))
    assert plan.count("hashpartitioning(user_id") == 1
    assert "SortMergeJoin" not in plan


def test_many_categories_need_no_columns(spark):
    names = [f"c{i:04d}" for i in range(3_000)]
    reviews = spark.createDataFrame(
        [(f"u{i % 7}", f"p{i}", names[i * 37 % 3_000], i) for i in range(400)],
        "user_id string, product_id string, category string, unixReviewTime long",
    )
    samples = sequence_samples(reviews, names, category_counts=False)
    by_name = {n: i for i, n in enumerate(names, 1)}
    assert samples.count() == sum(max(0, 400 // 7 + (u < 400 % 7) - 3) for u in range(7))
    for row in samples.select("target_category", "target_category_idx").collect():
        assert row.target_category_idx == by_name[row.target_category]
    with pytest.raises(ValueError, match="columns"):
        sequence_samples(reviews, names)


def test_known_sizes_spare_a_pass(spark, tmp_path):
    rows_ = [(f"u{i % 5}", f"p{i}", f"c{i % 3}", i) for i in range(300)]
    reviews = spark.createDataFrame(rows_, "user_id string, product_id string, category string, unixReviewTime long")
    sizes_path = str(tmp_path / "sizes")
    reviews.groupBy("user_id").count().withColumnRenamed("count", "total_purchases").write.parquet(sizes_path)
    sizes = spark.read.parquet(sizes_path)
    names = ["c0", "c1", "c2"]
    assert jobs_of(spark, lambda: sequence_samples(reviews, names, sizes=sizes)) <= 2
    plain = as_set(sequence_samples(reviews, names))
    assert as_set(sequence_samples(reviews, names, sizes=sizes)) == plain
    assert as_set(sequence_samples(reviews, names, sizes=sizes, hot_user_rows=20, chunk_rows=15)) == plain
    later = as_set(sequence_samples(reviews, names, as_of=150))
    assert later < plain and len(later) == 149
    assert as_set(sequence_samples(reviews, names, as_of=150, hot_user_rows=20, chunk_rows=15)) == later


def test_category_spread_equals_that_of_the_counts(spark):
    df = spark.createDataFrame(history(8, one_hot=True), SCHEMA)
    names = ["prefix_cat_dom_ratio", "prefix_cat_entropy_dynamic", "prefix_cat_norm_entropy_dynamic"]

    def spread(**options):
        samples = sequence_samples(df, NAMES, tie_break=["tie"], **options)
        found = linear_features(samples, n_categories=len(NAMES)).select("user_id", "prefix_length", *names)
        return {(r[0], r[1]): tuple(r)[2:] for r in found.collect()}

    want = spread()
    for options in ({}, {"hot_user_rows": 100, "chunk_rows": 37}):
        got = spread(category_counts=False, category_spread=True, **options)
        assert got.keys() == want.keys() and len(got) > 800
        assert all(got[k] == pytest.approx(want[k], abs=1e-11) for k in want)


def test_category_spread_of_thousands_of_categories(spark):
    names = [f"c{i}" for i in range(3_000)]
    rng = random.Random(9)
    bought = [names[int(3_000 * rng.random() ** 3)] for _ in range(4_000)]
    df = spark.createDataFrame(
        [("u", i, i, c, 1.0, 0, 1.0, True) for i, c in enumerate(bought)], SCHEMA
    )
    samples = sequence_samples(
        df, names, tie_break=["tie"], category_counts=False, category_spread=True, hot_user_rows=1_000, chunk_rows=700
    )
    for row in linear_features(samples, n_categories=3_000).where("prefix_length % 397 = 3").collect():
        n = row["prefix_length"]
        counts = Counter(bought[:n])
        entropy = -sum(c / n * math.log(c / n) for c in counts.values())
        assert row["prefix_cat_dom_ratio"] == pytest.approx(max(counts.values()) / n)
        assert row["prefix_cat_entropy_dynamic"] == pytest.approx(entropy, abs=1e-10)
        assert row["prefix_cat_norm_entropy_dynamic"] == pytest.approx(entropy / math.log(3_000), abs=1e-10)


def test_tables_in_buckets_need_no_shuffle(spark, tmp_path):
    """Same samples; both windows and the static join read the buckets as they lie."""
    events = history(9, users=8, longest=15)
    df = spark.createDataFrame(events, SCHEMA)
    static = spark.createDataFrame([("u0", 7), ("u1", 8), (None, 9)], "user_id string, total_purchases int")
    reviews = write_bucketed(df, "bucketed_reviews", str(tmp_path / "r"), 4, ("unixReviewTime",))
    described = write_bucketed(static, "bucketed_static", str(tmp_path / "s"), 4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        options = {"tie_break": ["tie"], "sizes": described}
        samples = sequence_samples(reviews, NAMES, described, by_user=True, **options)
        plan = physical_plan(samples)
        found = sorted(map(repr, rows(samples)))
        plain = sequence_samples(df, NAMES, static, **options)
        assert found == sorted(map(repr, rows(plain, *samples.columns))) and found
        assert "hashpartitioning" not in plan and "hashpartitioning" in physical_plan(plain)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE bucketed_reviews")
        spark.sql("DROP TABLE bucketed_static")
