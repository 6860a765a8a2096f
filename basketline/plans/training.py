"""Train, measure and save classifiers on a stored sample table."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketline import config
from basketline.operators import baselines, derived, learning, metrics, splitting, tuning
from basketline.operators.order_stats import seeded_subset
from basketline.staging import stage

KEEP = ["split", learning.LABEL]


@dataclass(frozen=True)
class TrainingData:
    """Samples with splits and usable features, in one stored table."""

    samples: DataFrame
    columns: learning.FeatureColumns
    fit_rows: int

    def split(self, name: str) -> DataFrame:
        return self.samples.where(F.col("split") == name)

    def to_fit(self) -> DataFrame:
        """The training rows, or a seeded subset of ``fit_rows`` of them. Only what a model is
        fitted to has this bound; every row of every split is measured."""
        return splitting.cap_rows(self.split("train"), self.fit_rows)


@dataclass(frozen=True)
class Trained:
    model: PipelineModel
    metrics: DataFrame
    report: DataFrame


def prepare(samples: DataFrame, fit_rows: int, add_features=None, time_unit="s") -> TrainingData:
    """Split by user, add derived features and store."""
    checked = splitting.with_split(learning.checked_samples(samples))
    full = add_features(checked, time_unit) if add_features else checked
    stored = stage(full, "training-data")
    train = stored.where(F.col("split") == "train")
    columns = learning.usable_columns(train, learning.feature_columns(stored))
    return TrainingData(learning.as_doubles(stored, columns), columns, fit_rows)


def save_run(out: str | None, run: str, models: list[PipelineModel], metrics_: DataFrame, settings: dict) -> None:
    """Save the models, metrics and settings of a run below ``out``."""
    if out is None:
        return
    root = out.rstrip("/")
    for i, model in enumerate(models):
        learning.save_model(model, f"{root}/models/{run}/{i}")
    learning.append_metrics(metrics_, f"{root}/metrics")
    learning.append_settings(metrics_.sparkSession, run, settings, f"{root}/settings")


def measure(scored: DataFrame, run: str) -> tuple[DataFrame, DataFrame]:
    """Metrics of all splits and the per-class report of the test split."""
    kept = stage(scored, "scored")
    test = kept.where(F.col("split") == "test")
    return (
        learning.evaluate(kept, run),
        metrics.class_report(test, learning.LABEL, "predicted"),
    )


def _trained(data: TrainingData, model: PipelineModel, run: str) -> Trained:
    return Trained(model, *measure(learning.score(model, data.samples, KEEP), run))


def _balanced(train: DataFrame) -> DataFrame:
    weights = metrics.balanced_class_weights(train, learning.LABEL)
    return metrics.with_class_weight(train, weights, learning.LABEL)


def train_logistic_regression(
    samples: DataFrame, max_iter: int = 400, time_unit: str = "s",
    fit_rows: int = config.FIT_ROWS["logistic_regression"], out: str | None = None,
) -> tuple[Trained, DataFrame]:
    """The multinomial linear model, with the rule baselines it has to beat."""
    data = prepare(samples, fit_rows, derived.linear_features, time_unit)
    train = data.to_fit()
    model = learning.fit(
        train,
        learning.linear_preprocessing(data.columns),
        learning.logistic_regression(train.count(), max_iter),
    )
    trained = _trained(data, model, "logistic_regression")
    save_run(out, "logistic_regression", [model], trained.metrics, {"max_iter": max_iter, "fit_rows": fit_rows})
    return trained, baselines.validation_baselines(data.samples)


def train_tree_models(
    samples: DataFrame, fit_rows: int = config.FIT_ROWS["tree_models"],
    svm: dict | None = None, tree: dict | None = None, forest: dict | None = None,
    out: str | None = None,
) -> tuple[dict[str, Trained], str]:
    """Linear SVM, decision tree and random forest; returns the best by validation."""
    data = prepare(samples, fit_rows)
    train = data.to_fit()
    linear = learning.linear_preprocessing(data.columns)
    plain = learning.tree_preprocessing(data.columns)
    svm, tree, forest = svm or {}, tree or {}, forest or {}
    runs = {
        "linear_svm": (_balanced(train), linear, learning.linear_svm(train.count(), **svm), svm),
        "decision_tree": (train, plain, learning.decision_tree(**tree), tree),
        "random_forest": (train, plain, learning.random_forest(**forest), forest),
    }
    trained = {}
    for name, (rows, stages, estimator, options) in runs.items():
        trained[name] = _trained(data, learning.fit(rows, stages, estimator), name)
        save_run(out, name, [trained[name].model], trained[name].metrics, options | {"fit_rows": fit_rows})
    return trained, best_by_validation(trained)


def best_by_validation(trained: dict[str, Trained]) -> str:
    rows = None
    for result in trained.values():
        rows = result.metrics if rows is None else rows.unionByName(result.metrics)
    wide = rows.where((F.col("split") == "val") & (F.col("metric") == "acc")).select(
        F.col("run").alias("model"), F.col("value").alias("val_acc")
    )
    return metrics.best_model(wide).first()["model"]


#: Seeds of the rows that settings are tried on, and of the members of the ensemble.
TUNING_SEED, MEMBERS_SEED = 11, 12


def train_boosting(
    samples: DataFrame, time_unit: str = "s", trials: int = config.TUNING_TRIALS,
    tuning_rows: int = config.TUNING_ROWS, tuning_rounds: int = 300, rounds: int = 400,
    members: int = config.ENSEMBLE_SIZE, class_weights: bool = False,
    fit_rows: int = config.FIT_ROWS["gradient_boosting"], out: str | None = None,
) -> tuple[list[PipelineModel], DataFrame, DataFrame, DataFrame | None]:
    """Random search on a subset, then an ensemble with the best setting.

    Returns the members, the ensemble's metrics and report, and the trial table.
    """
    data = prepare(samples, fit_rows, derived.boosting_features, time_unit)
    train, stages = data.to_fit(), learning.boosting_preprocessing(data.columns)
    if class_weights:
        weights = metrics.class_weights(train, learning.LABEL)
        train = metrics.with_class_weight(train, weights, learning.LABEL)
    # The setting used without tuning.
    setting, table = {"learning_rate": 0.1, "max_leaf_nodes": 63, "min_leaf": 50, "l2": 1.0}, None
    if trials > 0:
        subset = seeded_subset(train, tuning_rows, splitting.SAMPLE_KEY, TUNING_SEED)
        table, setting, _ = tuning.random_search(
            subset, data.split("val"), stages, tuning.draw_settings(trials),
            rounds=tuning_rounds, patience=config.TUNING_PATIENCE, weighted=class_weights,
        )
    def member(seed: int) -> Callable[[], PipelineModel]:
        build = learning.boosted_trees(**setting, rounds=rounds, weighted=class_weights, seed=seed)
        return lambda: learning.fit(train, stages, build)

    fitted = learning.at_once(train.sparkSession, [member(s) for s in tuning.fit_seeds(members, MEMBERS_SEED)])
    scored = learning.ensemble_score(fitted, data.samples, KEEP)
    measured, report = measure(scored, "gradient_boosting")
    settings = setting | {"rounds": rounds, "class_weights": class_weights, "fit_rows": fit_rows}
    save_run(out, "gradient_boosting", fitted, measured, settings)
    return fitted, measured, report, table
