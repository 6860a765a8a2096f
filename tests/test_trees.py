"""Trees grown from histograms and below small nodes: the same either way, and as brute force splits."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from basketline import config
from basketline.operators import learning, trees

from .helpers import jobs_of, rows

ROW = "user_id string, prefix_length int, a double, b double, c double, target_category_idx int, target_category string"


@pytest.fixture(scope="module")
def crossed(spark):
    """The class follows from two columns together; one row in ten has another one."""
    rng = np.random.default_rng(3)
    x = rng.integers(0, 12, (2500, 3))
    y = (x[:, 0] > 5) * 2 + (x[:, 1] % 4 > 1) + (rng.random(2500) < 0.1)
    data = [(f"u{i}", 3, *map(float, r), int(k), f"c{k}") for i, (r, k) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame(data, ROW).cache()


def stages():
    return learning.tree_preprocessing(learning.FeatureColumns(["a", "b", "c"], []))


def brute(x, y, depth, min_leaf):
    """Class of each row's leaf, every split looked at; leaves with equal shares aside."""
    counts = np.bincount(y, minlength=5)
    best = (1e-9, None)
    if depth and len(y) >= 2 * min_leaf:
        for f in range(x.shape[1]):
            for v in np.unique(x[:, f])[:-1]:
                left = x[:, f] <= v
                if min(left.sum(), (~left).sum()) >= min_leaf:
                    gain = sum((np.bincount(y[s]) ** 2).sum() / s.sum() for s in (left, ~left)) - (counts**2).sum() / len(y)
                    if gain > best[0] + 1e-9:
                        best = gain, left
    if best[1] is None:
        return np.tile(counts / counts.sum(), (len(y), 1))
    out = np.empty((len(y), 5))
    for side in (best[1], ~best[1]):
        out[side] = brute(x[side], y[side], depth - 1, min_leaf)
    return out


@pytest.mark.parametrize("local", [1, 300, 10_000])
def test_tree_by_brute_force(crossed, monkeypatch, local):
    monkeypatch.setattr(trees, "LOCAL_ROWS", local)
    model = learning.fit(crossed, stages(), learning.decision_tree(max_depth=6, min_leaf=20), partitions=3)
    got = rows(learning.score(model, crossed, ["a", "b", "c", learning.LABEL]))
    x, y = np.array([r[:3] for r in got]), np.array([r[3] for r in got])
    assert np.allclose([r[4] for r in got], brute(x, y, 6, 20))
    assert all(r[5] == np.argmax(r[4]) for r in got)


def test_passes_do_not_grow_with_nodes(spark, crossed):
    """A node that fits in a task costs no pass of its own, and a pass no more tasks for more rows."""
    jobs, nodes = [], []
    for leaf in (400, 5):
        jobs.append(jobs_of(spark, lambda leaf=leaf: nodes.append(learning.fit(crossed, stages(), learning.decision_tree(min_leaf=leaf)))))
    few, many = (m.stages[-2].node_counts[0] for m in nodes)
    assert many > 4 * few and jobs[0] == jobs[1]
    assert learning.training_partitions(10**9) == config.FIT_PARTITIONS
    assert learning.training_partitions(0) == 1 and learning.training_partitions(25_000) == 3


@pytest.mark.parametrize("local", [200, 10_000])
def test_forest(crossed, monkeypatch, tmp_path, local):
    monkeypatch.setattr(trees, "LOCAL_ROWS", local)
    build = learning.random_forest(trees=12, max_depth=8, min_leaf=5)
    model = learning.fit(crossed, stages(), build, partitions=3)
    assert len(set(model.stages[-2].node_counts)) > 3
    scored = learning.score(model, crossed, ["user_id", "a", "b", learning.LABEL])
    rule = (F.col("a") > 5).cast("int") * 2 + (F.col("b") % 4 > 1).cast("int")
    assert scored.agg(F.avg((F.col("predicted") == rule).cast("int"))).first()[0] > 0.97
    learning.save_model(model, str(tmp_path / "m"))
    again = learning.score(learning.load_model(str(tmp_path / "m")), crossed, ["user_id", "a", "b", learning.LABEL])
    assert rows(again) == rows(scored)


def test_weights_one_class_and_too_few_rows(spark):
    data = [("u", i, float(i), None, 1.0, 1 + (i < 3), "c", 10.0 if i < 3 else 1.0) for i in range(10)]
    df = spark.createDataFrame(data, ROW + ", weight double")
    two = learning.tree_preprocessing(learning.FeatureColumns(["a", "c"], []))
    root = learning.fit(df, two, learning.decision_tree(min_leaf=6, weighted=True))
    assert {r[0] for r in rows(learning.score(root, df, []), "predicted")} == {2}
    split = learning.fit(df, two, learning.decision_tree(min_leaf=3, weighted=True))
    assert rows(learning.score(split, df, ["a"]).orderBy("a"), "predicted") == [(2,)] * 3 + [(1,)] * 7
    one = learning.fit(df.where("a < 3"), two, learning.random_forest(trees=2, min_leaf=1))
    assert rows(learning.score(one, df.limit(1), []), "predicted") == [(2,)]


def test_a_large_forest_takes_no_passes_for_nodes_that_its_tasks_hold(spark, crossed, monkeypatch):
    """Many trees keep the tasks busy, so a node may have more rows; without row weights a row is sent in a byte a value."""
    monkeypatch.setattr(trees, "LOCAL_ROWS", 300)
    build = learning.random_forest(trees=100, max_depth=3)
    got = []
    held = jobs_of(spark, lambda: got.append(learning.fit(crossed, stages(), build, partitions=2)))
    monkeypatch.setattr(trees, "LOCAL_ROWS", 100_000)
    assert held == jobs_of(spark, lambda: learning.fit(crossed, stages(), build, partitions=2))
    edges, grown = got[0].stages[-2]._parts()
    assert len(grown) == 100 and all(t[3].dtype == np.float32 for t in grown)
    limits = trees._Limits([len(e) + 1 for e in edges], 4, 20, 3, 2, 42, True, False)
    bins, label = np.zeros((500, 3), np.uint8), np.zeros(500, np.uint8)
    block = pa.RecordBatch.from_pylist([{"block": 0, "bins": bins.tobytes(), "label": label.tobytes(), "weight": np.ones(500).tobytes()}])
    (sent,) = trees._rows_of({0: trees.Nodes(np.zeros(5)).frozen()}, {0: [0]}, limits)(iter([block]))
    n = len(sent["label"][0].as_py())
    assert len(sent["bins"][0].as_py()) == 3 * n and not sent["weight"][0].as_py()


def test_small_nodes_by_brute_force():
    """Rows below a node, with copies and weights, against every split looked at one by one."""
    rng = np.random.default_rng(1)
    bins, label = rng.integers(0, 9, (600, 3)).astype(np.uint8), rng.integers(0, 5, 600)
    label[bins[:, 0] > 4] = 2
    one = np.ones(600, np.uint8)
    limits = trees._Limits([9, 9, 9], 5, 20, 4, 3, 42, False)
    feature, cut, left, stats = trees.grown(bins, label, one.astype(float), one, limits, 0, (0, 0))
    got = stats[trees.walked(bins, feature, cut, left), :-1]
    assert np.allclose(got / got.sum(axis=1, keepdims=True), brute(bins, label, 4, 20))
    assert (stats[:, -1] >= 20).all() and np.array_equal(stats[:, :-1].sum(axis=1), stats[:, -1])
