import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from basketline.functions.hashing import seeded_rank_hash
from basketline.operators import order_stats
from basketline.operators.order_stats import quantile, seeded_subset, value_at_rank
from tests.helpers import jobs_of

CASES = {
    "spread": [random.Random(1).random() for _ in range(5000)],
    "third_equal": [0.5] * 1700 + [random.Random(2).random() for _ in range(3300)],
    "all_equal": [2.0] * 5000,
    "two_values": [1.0] * 2500 + [9.0] * 2500,
    "long_tail": [float(2 ** (i % 40)) for i in range(5000)],
}


@pytest.mark.parametrize("name", CASES)
def test_exact_through_the_bracket(spark, name):
    values = CASES[name]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    ordered = sorted(values)
    for rank in (1, 1700, 2501, 5000):
        assert value_at_rank(df, "x", rank, 5000, exact_rows=50) == ordered[rank - 1]
    for share in (0.0, 0.95):
        want = np.quantile(values, share)
        assert quantile(df, "x", share, exact_rows=50) == pytest.approx(want, abs=1e-12)
    assert quantile(df, "x", 0.5) == pytest.approx(np.quantile(values, 0.5), abs=1e-12)


def test_quantile_skips_nulls_and_empty(spark):
    df = spark.createDataFrame([(1.0,), (None,), (3.0,)], "x double")
    assert quantile(df, "x", 0.5) == 2.0
    assert quantile(df.where("x > 5"), "x", 0.5) is None


def test_seeded_subset_is_exact_and_repeatable(spark):
    df = spark.range(5000).select(F.col("id").alias("k"), F.lit(1).alias("v"))
    first = {r["k"] for r in seeded_subset(df, 321, ["k"], exact_rows=20).collect()}
    again = {r["k"] for r in seeded_subset(df.repartition(3), 321, ["k"]).collect()}
    other = {r["k"] for r in seeded_subset(df, 321, ["k"], seed=7).collect()}
    assert len(first) == 321 and first == again and first != other
    assert seeded_subset(df, 9000, ["k"]).count() == 5000
    assert seeded_subset(df, 0, ["k"]).count() == 0


def test_seeded_subset_with_copies(spark):
    """A third of the rows share one key, so the cut falls among equal hashes."""
    df = spark.createDataFrame([(i if i % 3 else 0,) for i in range(3000)], "k long")
    for n in (10, 400, 1500, 2999):
        assert seeded_subset(df, n, ["k"], exact_rows=20).count() == n


def test_a_subset_takes_few_jobs(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(20_000).select(
        (F.col("id") % 300).cast("string").alias("user_id"), F.col("id").alias("prefix_length")
    ).write.parquet(path)
    df = spark.read.parquet(path)
    keys = ["user_id", "prefix_length"]
    assert jobs_of(spark, lambda: seeded_subset(df, 3_000, keys)) <= 6
    own = seeded_rank_hash(*[F.col(k) for k in keys])
    want = {r[0] for r in df.orderBy(own, *keys).limit(3_000).select("prefix_length").collect()}
    for exact_rows in (50, 500, 10**6):
        got = [r[0] for r in seeded_subset(df, 3_000, keys, exact_rows=exact_rows).select("prefix_length").collect()]
        assert len(got) == 3_000 and set(got) == want


def test_a_subset_of_equal_keys(spark):
    df = spark.range(500).select(F.lit("u").alias("user_id"), (F.col("id") % 2).alias("prefix_length"))
    for n in (0, 1, 249, 251, 499, 500, 600):
        assert seeded_subset(df, n, ["user_id", "prefix_length"], exact_rows=10).count() == min(n, 500)


@pytest.mark.parametrize("marks", [[0] * 1_001, [-1] + [1 << 60] * 1_000])
def test_a_wrong_sketch_halves_the_range(spark, monkeypatch, marks):
    """Marks that miss the rank, or say nothing: the cut is still exact, through the buffer of 40."""
    hashes = spark.range(300).select(seeded_rank_hash((F.col("id") / 2).cast("long")).alias("h"))
    want = sorted(r[0] for r in hashes.collect())
    right = order_stats._sketch
    monkeypatch.setattr(order_stats, "_sketch", lambda rows: (right(rows)[0], marks))
    cut, room, at = order_stats._smallest(hashes, 101, exact_rows=40)
    assert cut == want[100] and (room, at) == (1, 2)


def test_the_cut_in_a_key_of_many_rows(spark):
    """4,000 of 6,000 rows share the hash that the cut falls on, far beyond the buffer."""
    df = spark.range(6_000).select(F.when(F.col("id") % 3 == 0, F.col("id")).otherwise(-1).alias("k"))
    hashes = df.select(seeded_rank_hash(F.col("k")).alias("h"))
    before = hashes.where(F.col("h") < seeded_rank_hash(F.lit(-1).cast("long"))).count()
    cut, room, at = order_stats._smallest(hashes, before + 1_000, exact_rows=50)
    assert (room, at) == (1_000, 4_000)
