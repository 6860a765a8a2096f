"""Support vector machines by Newton steps: few passes, and the least loss."""

import numpy as np
import pytest

from basketline.operators import learning, svm

from .helpers import jobs_of, rows

COLUMNS = learning.FeatureColumns(["a"], ["last_category_idx"])


def ruled(n, seed=4):
    """The class is the last category, for one row in ten the next one."""
    rng = np.random.default_rng(seed)
    last = rng.integers(1, 4, n)
    return rng.gamma(2, 1, n), last, np.where(rng.random(n) < 0.1, last % 3 + 1, last)


@pytest.mark.parametrize("of", [1, 2, 3, 7])
def test_least_loss_in_few_passes(of):
    a, last, y = ruled(3000)
    x, weight = np.column_stack([a, np.eye(4)[last], np.ones(3000)]), 0.5 + y / 2

    def loss(w):
        u = np.maximum(1 - np.where(y == of, 1, -1) * (x @ w), 0)
        return weight @ u / weight.sum() + (w[:-1] ** 2).sum() / 6000

    state, passes, done = svm._State(np.zeros(6), np.zeros(6)), 0, False
    while not done:
        (sums,) = svm._added(x, y, weight, {of: state})
        done, passes = svm._moved(state, *svm._solved(state, sums, weight.sum(), 1 / 3000)), passes + 1
    assert passes < 100
    # 7: a class without rows.
    rule = np.array([0.0, *np.where(np.arange(4) == of, 2.0, 0.0), -1.0])
    rng = np.random.default_rng(1)
    near = [state.at + rng.normal(0, s, 6) for s in (0.01, 0.1, 1) for _ in range(100)]
    assert loss(state.at) <= min(map(loss, [rule, *near])) + 1e-3


def test_fit_in_few_jobs(spark, monkeypatch, tmp_path):
    a, last, y = ruled(900)
    data = [(f"u{i}", 3, *map(float, r[:2]), int(r[2]), "c") for i, r in enumerate(zip(a, last, y, strict=True))]
    columns = "user_id string, prefix_length int, a double, last_category_idx double, target_category_idx int"
    df = spark.createDataFrame(data, columns + ", target_category string").cache()
    stages, made = learning.linear_preprocessing(COLUMNS), []

    def fit(**options):
        made.append(learning.fit(df, stages, learning.linear_svm(900, weighted=False, **options), partitions=2))

    assert jobs_of(spark, fit) < 200
    told = rows(learning.score(made[0], df, ["user_id", "last_category_idx"]))
    assert all(r[1] == r[3] for r in told)
    learning.save_model(made[0], str(tmp_path / "m"))
    assert rows(learning.score(learning.load_model(str(tmp_path / "m")), df, ["user_id", "last_category_idx"])) == told
    # One class to a pass, then by Spark ML.
    monkeypatch.setattr(svm, "CURVATURE_BYTES", 1)
    fit(max_iter=6)
    assert rows(learning.score(made[1], df, []), "predicted") == [(r[3],) for r in told]
    monkeypatch.setattr(svm, "MOST_FEATURES", 2)
    fit(max_iter=3)
    assert len(made[2].stages[-2].models) == 3
