"""Whole jobs: stages on raw files, incremental counts, model training."""

import gzip
import json
import random

import pytest
from pyspark.sql import functions as F

from basketline import config
from basketline.operators import learning
from basketline.plans import stages, training
from basketline.sources import tables
from basketline.streaming import running_counts
from tests.helpers import as_set, brute_force_samples, rows, same

NAMES = ["Books", "Games", "Tools", "Never"]


def write_raw(folder, seed=5):
    rng = random.Random(seed)
    written, items = [], {}
    for name in NAMES[:3]:
        lines = []
        for i in range(400):
            user, product = f"u{rng.randint(0, 39)}", f"p{rng.randint(0, 20)}"
            line = {"user_id": user, "asin": product, "rating": rng.randint(1, 5),
                    "helpful_vote": rng.randint(0, 60), "timestamp": rng.randint(1, 10**6),
                    "verified_purchase": rng.random() < 0.5}
            lines.append(json.dumps(line))
            written.append((name, line))
        lines += ["", '{"user_id": "cut']
        with gzip.open(folder / f"{name}.jsonl.gz", "wt") as f:
            f.write("\n".join(lines))
        meta = [{"parent_asin": f"p{i}", "average_rating": round(1 + i / 5, 1), "price": i} for i in range(15)]
        items |= {(name, m["parent_asin"]): m["average_rating"] for m in meta}
        with gzip.open(folder / f"meta_{name}.jsonl.gz", "wt") as f:
            f.write("\n".join(json.dumps(m) for m in meta))
    return written, items


def test_all_stages_from_raw_lines_to_samples(spark, tmp_path):
    raw_dir = tmp_path / "raw"
    raw_dir.mkdir()
    written, items = write_raw(raw_dir)
    out = stages.Tables(str(tmp_path / "tables"))
    reviews = [str(raw_dir / f"{n}.jsonl.gz") for n in NAMES[:3]]
    metas = [str(raw_dir / f"meta_{n}.jsonl.gz") for n in NAMES[:3]]
    shape = stages.run_all(spark, out, reviews, metas, NAMES)

    totals = {}
    for _, line in written:
        totals[line["user_id"]] = totals.get(line["user_id"], 0) + 1
    top = {u for (u,) in rows(out.read(spark, "top_users"), "user_id")}
    assert 1 <= len(top) <= 4 and min(totals[u] for u in top) >= max(
        t for u, t in totals.items() if u not in top
    ) - 1

    events = [
        (line["user_id"], line["timestamp"], line["asin"], name, float(line["rating"]),
         line["helpful_vote"], items.get((name, line["asin"])), line["verified_purchase"])
        for name, line in written if line["user_id"] in top
    ]
    expected = brute_force_samples(events, NAMES[:3])
    samples = stages.load_samples(spark, out).collect()
    assert len(samples) == len(expected) == shape.first()["n_rows"]
    for row in samples:
        for name, value in expected[(row["user_id"], row["prefix_length"])].items():
            assert same(row[name], value), name
        assert row["total_purchases"] == totals[row["user_id"]]
    stats = [json.loads(t) for (t,) in rows(tables.read_json(spark, out.path("review_stats")), "stats")]
    assert {s["category"]: s["n_reviews"] for s in stats} == dict.fromkeys(NAMES[:3], 400)
    assert all(sum(s["rating_hist"].values()) == 400 for s in stats)
    assert as_set(out.read(spark, "baselines"), "baseline") == {
        ("majority",), ("user_majority_in_sample",), ("last_category",), ("prefix_favourite",),
    }
    missing = stages.create_sequences(spark, out, NAMES, category_counts=False)
    assert rows(missing) == [("Never",)]


def test_incremental_counts_take_each_file_once(spark, tmp_path):
    source, sink, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    schema = "category string, user_id string"

    def arrive(*records):
        spark.createDataFrame(list(records), schema).coalesce(1).write.mode("append").json(source)

    def run():
        df = spark.createDataFrame([], schema)
        running_counts.update_user_counts(spark, source, df.schema, sink, state).awaitTermination()
        return as_set(running_counts.latest_user_counts(spark, sink))

    arrive(("a", "u"), ("a", "u"), ("b", "v"), ("b", None))
    assert run() == {("a", "u", 2), ("b", "v", 1)}
    assert run() == {("a", "u", 2), ("b", "v", 1)}
    arrive(("a", "u"), ("c", "w"))
    assert run() == {("a", "u", 3), ("b", "v", 1), ("c", "w", 1)}
    want = {("a", "u", 3), ("b", "v", 1), ("c", "w", 1)}
    running_counts.compact_user_counts(spark, sink)
    running_counts.compact_user_counts(spark, sink)
    assert as_set(running_counts.latest_user_counts(spark, sink)) == want
    # The last batch runs again after the compaction: it writes what it changed, and no more.
    last = spark.read.parquet(f"{sink}/changes").agg(F.max("batch_id")).first()[0]
    changed = spark.createDataFrame([("a", "u", 3), ("c", "w", 1)], "category string, user_id string, num_purchases long")
    changed.write.mode("overwrite").parquet(f"{sink}/changes/batch_id={last}")
    assert as_set(running_counts.latest_user_counts(spark, sink)) == want
    arrive(("b", "v"))
    assert run() == {("a", "u", 3), ("b", "v", 2), ("c", "w", 1)}


@pytest.fixture(scope="module")
def samples(spark, tmp_path_factory):
    """Targets that follow from the last category, with some noise."""
    rng = random.Random(3)
    data = []
    for u in range(300):
        for n in range(3, 9):
            last = rng.choice([1, 2, 3, 6])
            target = last if rng.random() < 0.8 else rng.choice([1, 2, 3, 6])
            data.append((f"u{u}", n, rng.choice([None, rng.random()]), None, last, target, f"c{target}"))
    df = spark.createDataFrame(
        data,
        "user_id string, prefix_length int, noise double, empty double, last_category_idx int, "
        "target_category_idx int, target_category string",
    )
    path = str(tmp_path_factory.mktemp("samples") / "t")
    df.write.parquet(path)
    return spark.read.parquet(path)


def accuracy(metrics, split="test", metric="acc"):
    return metrics.where((F.col("split") == split) & (F.col("metric") == metric)).first()["value"]


def test_linear_model_beats_the_majority(spark, samples, tmp_path):
    out = str(tmp_path / "runs")
    trained, rules = training.train_logistic_regression(samples, max_iter=30, fit_rows=700, out=out)
    whole = dict(rows(training.prepare(samples, 5).samples.groupBy("split").count()))
    for split, n in whole.items():
        assert accuracy(trained.metrics, split, "rows") == n
    stored = spark.read.parquet(f"{out}/metrics")
    assert as_set(stored) == as_set(trained.metrics)
    assert json.loads(spark.read.parquet(f"{out}/settings").first()["settings"]) == {"fit_rows": 700, "max_iter": 30}
    assert learning.labels_of(learning.load_model(f"{out}/models/logistic_regression/0")) == [1, 2, 3, 6]
    assert accuracy(trained.metrics) > 0.6 > rules.first()["majority_accuracy"]
    assert accuracy(trained.metrics, metric="top3") >= accuracy(trained.metrics)
    classes = {c for (c,) in rows(trained.report, "class")}
    assert {"1", "2", "3", "6", "accuracy", "macro avg", "weighted avg"} == classes


def test_svm_tree_and_forest(samples):
    trained, best = training.train_tree_models(
        samples, svm={"max_iter": 10}, tree={"max_depth": 4}, forest={"trees": 5, "max_depth": 4}
    )
    assert set(trained) == {"linear_svm", "decision_tree", "random_forest"} and best in trained
    assert all(accuracy(t.metrics) > 0.6 for t in trained.values())


def test_boosting_search_and_ensemble(samples):
    members, metrics, report, trials = training.train_boosting(
        samples, trials=1, tuning_rows=500, tuning_rounds=1, rounds=1, class_weights=True
    )
    assert len(members) == config.ENSEMBLE_SIZE and trials.count() == 1
    assert accuracy(metrics) > 0.6
    assert report.where("class = '6'").count() == 1


def test_only_rows_to_fit_are_bounded(samples):
    data = training.prepare(samples, 100)
    assert data.to_fit().count() == 100
    assert data.samples.count() == samples.count()


def test_boosting_stops_early_and_keeps_categories_nominal(spark, tmp_path):
    """Membership in {1, 3, 5} is one split of a nominal feature, and three of an ordered one.

    One target in ten is wrong, so nothing is gained once the rule is learned.
    """
    data = [
        (f"u{i}", 3, i % 6 + 1, float(i % 7), 1 + (i + (i % 10 == 0)) % 2, f"c{(i + (i % 10 == 0)) % 2}")
        for i in range(1200)
    ]
    df = spark.createDataFrame(
        data,
        "user_id string, prefix_length int, last_category_idx int, noise double, "
        "target_category_idx int, target_category string",
    )
    columns = learning.feature_columns(df)
    df = learning.as_doubles(df, columns)
    stages = learning.boosting_preprocessing(columns)
    model = learning.fit(df, stages, learning.boosted_trees(rounds=60, max_leaf_nodes=2, learning_rate=0.5))
    assert learning.rounds_grown(model) < 60
    right = learning.score(model, df, [learning.LABEL]).where(f"predicted = {learning.LABEL}")
    assert right.count() == 1080
    learning.save_model(model, str(tmp_path / "m"))
    again = learning.load_model(str(tmp_path / "m"))
    assert rows(learning.score(again, df, ["user_id"])) == rows(learning.score(model, df, ["user_id"]))


def test_required_columns(samples):
    with pytest.raises(ValueError, match="target_category"):
        learning.checked_samples(samples.drop("target_category"))
    columns = learning.feature_columns(samples)
    assert columns.categorical == ["last_category_idx"]
    assert learning.usable_columns(samples, columns).numeric == ["prefix_length", "noise"]


def test_config_is_sane():
    assert 0 < config.IMPORTANCE_PERCENTILE < 1 and config.TRAIN_SPLIT + config.VAL_SPLIT <= 1
    assert config.USER_BUCKETS > 0 and config.MIN_PREFIX_LENGTH > 0
