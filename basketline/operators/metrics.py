"""Class weights, accuracy, top-k accuracy and per-class reports.

Each metric is one grouped aggregate whose result has as many rows as there are
classes or class pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _class_counts(samples: DataFrame, label: str) -> DataFrame:
    return samples.groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def _over_all_classes(value: Column) -> Column:
    """Whole-table aggregate; the tables here have one row per class, so it is small."""
    return value.over(Window.partitionBy())


def class_weights(samples: DataFrame, label: str, power: float = 0.5) -> DataFrame:
    """Weight per class, 1 / n^power, scaled so that the mean over rows is 1."""
    raw = _class_counts(samples, label).withColumn("raw", 1.0 / F.pow("n", F.lit(power)))
    rows, mass = F.sum("n"), F.sum(F.col("n") * F.col("raw"))
    weight = F.col("raw") * _over_all_classes(rows) / _over_all_classes(mass)
    return raw.select(label, "n", weight.alias("weight"))


def balanced_class_weights(samples: DataFrame, label: str) -> DataFrame:
    """Weight per class, rows / (classes x n)."""
    rows, classes = F.sum("n"), F.count(F.lit(1))
    weight = _over_all_classes(rows) / (_over_all_classes(classes) * F.col("n"))
    return _class_counts(samples, label).select(label, "n", weight.alias("weight"))


def with_class_weight(samples: DataFrame, weights: DataFrame, label: str) -> DataFrame:
    """Attach each row's class weight. ``weights`` has one row per class."""
    return samples.join(F.broadcast(weights.select(label, "weight")), label, "left")


def accuracy(scored: DataFrame, label: str, prediction: str, by: str = "split") -> DataFrame:
    return scored.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg((F.col(prediction) == F.col(label)).cast("int")).alias("accuracy"),
    )


def in_top_k(scores: Column, label: Column, k: int = 3) -> Column:
    """Whether the label, a position in ``scores``, is among the k best.

    Larger scores rank first and, among equal scores, larger labels do. A label
    without a score is not among them.
    """
    own = F.get(scores, label.cast("int"))
    position = F.transform(scores, lambda s, i: F.struct(s.alias("s"), i.alias("i")))
    better = F.filter(
        position, lambda p: (p["s"] > own) | ((p["s"] == own) & (p["i"] > label))
    )
    return own.isNotNull() & (F.size(better) < k)


def top_k_accuracy(
    scored: DataFrame, label: str, scores: str, k: int = 3, by: str = "split"
) -> DataFrame:
    hit = in_top_k(F.col(scores), F.col(label), k).cast("int")
    return scored.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"), F.avg(hit).alias(f"top{k}_accuracy")
    )


def class_report(scored: DataFrame, label: str, prediction: str) -> DataFrame:
    """Precision, recall, F1 and support per class, then accuracy and both averages.

    ``class`` is the label, or ``accuracy``, ``macro avg``, ``weighted avg``.
    Undefined ratios are 0. Classes are those seen as label or prediction. The data
    is read once: everything follows from the (label, prediction) counts.
    """
    c, none = F.col, F.lit(0).cast("long")
    pairs = scored.groupBy(
        c(label).cast("int").alias("truth"), c(prediction).cast("int").alias("guess")
    ).agg(F.count(F.lit(1)).alias("n"))
    hits = F.when(c("truth") == c("guess"), c("n")).otherwise(none)
    as_truth = F.struct(c("truth").alias("c"), c("n").alias("support"), none.alias("predicted"), hits.alias("hits"))
    as_guess = F.struct(c("guess").alias("c"), none.alias("support"), c("n").alias("predicted"), none.alias("hits"))
    classes = (
        pairs.select(F.inline(F.array(as_truth, as_guess)))
        .groupBy("c")
        .agg(*[F.sum(n).alias(n) for n in ("support", "predicted", "hits")])
    )

    def ratio(part: Column, whole: Column) -> Column:
        return F.coalesce(F.try_divide(part, whole), F.lit(0.0))

    rated = classes.select(
        c("c").cast("string").alias("class"),
        ratio(c("hits"), c("predicted")).alias("precision"),
        ratio(c("hits"), c("support")).alias("recall"),
        ratio(2 * c("hits"), c("predicted") + c("support")).alias("f1"),
        "support",
        "hits",
    )
    names, total = ["precision", "recall", "f1"], F.sum("support")

    def summary(name: str, values: list[Column]) -> Column:
        columns = [v.alias(n) for n, v in zip(names, values)]
        return F.struct(F.lit(name).alias("class"), *columns, total.alias("support"))

    overall = F.try_divide(F.sum("hits"), total)
    weighted = [F.try_divide(F.sum(c(n) * c("support")), total) for n in names]
    per_class = F.collect_list(F.struct("class", *names, "support"))
    rows = F.concat(
        per_class,
        F.array(
            summary("accuracy", [overall] * 3),
            summary("macro avg", [F.avg(n) for n in names]),
            summary("weighted avg", weighted),
        ),
    )
    return rated.agg(rows.alias("rows")).select(F.inline("rows"))


def best_model(metrics: DataFrame, by: str = "val_acc") -> DataFrame:
    """The model with the highest value of ``by``; the first name wins ties."""
    return rank_models(metrics, by).where(F.col("rank") == 1)


def rank_models(metrics: DataFrame, by: str = "val_acc") -> DataFrame:
    """Models or trials numbered from best to worst; one row each, so one small window."""
    order = Window.orderBy(F.desc(by), "model")
    return metrics.withColumn("rank", F.row_number().over(order))
