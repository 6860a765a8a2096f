"""Baselines and metrics, with rule predictors over ``events`` samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketline.operators import baselines, metrics, splitting
from basketline.plans.queries.sequences import SAMPLES_SQL, event_samples
from basketline.plans.queries.splits import SPLIT_SQL
from basketline.plans.registry import query, rounded

TARGET = baselines.TARGET
FAVOURITE = "prefix_most_freq_category_idx"


@query(
    "baseline_majority",
    f"""WITH {SAMPLES_SQL}, c AS (
      SELECT target_category_idx AS i, target_category AS name, count(*) AS n FROM s GROUP BY ALL)
    SELECT i AS majority_idx, name AS majority_category,
      round(n / (SELECT sum(n) FROM c), 9) AS accuracy
    FROM c ORDER BY n DESC, i LIMIT 1""",
)
def baseline_majority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(baselines.majority_category(event_samples(spark, sf_dir)))


@query(
    "baseline_user_majority",
    f"""WITH {SAMPLES_SQL},
    c AS (SELECT user_id, target_category_idx, count(*) AS n FROM s GROUP BY ALL),
    m AS (SELECT user_id, max(n) AS hit, sum(n) AS total FROM c GROUP BY user_id)
    SELECT CAST(sum(hit) AS BIGINT) AS n_correct, CAST(sum(total) AS BIGINT) AS n_samples,
      round(CAST(sum(hit) AS DOUBLE) / CAST(sum(total) AS DOUBLE), 9) AS accuracy FROM m""",
)
def baseline_user_majority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(baselines.user_majority_in_sample(event_samples(spark, sf_dir)))


def _share_sql(column: str) -> str:
    return f"""WITH {SAMPLES_SQL}
    SELECT count(*) FILTER ({column} = target_category_idx) AS n_correct,
      count(*) AS n_samples, round(avg(CAST({column} = target_category_idx AS INTEGER)), 9)
      AS accuracy FROM s"""


@query("baseline_last", _share_sql("last_category_idx"))
def baseline_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(baselines.last_category(event_samples(spark, sf_dir)))


@query("baseline_prefix_freq", _share_sql("prefix_most_freq_category_idx"))
def baseline_prefix_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(baselines.prefix_favourite(event_samples(spark, sf_dir)))


@query(
    "baseline_validation",
    f"""WITH {SAMPLES_SQL}, {SPLIT_SQL},
    m AS (SELECT target_category_idx AS i FROM sp WHERE split = 'train'
          GROUP BY i ORDER BY count(*) DESC, i LIMIT 1)
    SELECT any_value(i) AS majority_idx,
      round(avg(CAST(target_category_idx = i AS INTEGER)), 9) AS majority_accuracy,
      round(avg(CAST(target_category_idx = last_category_idx AS INTEGER)), 9) AS last_accuracy,
      round(avg(CAST(target_category_idx = prefix_most_freq_category_idx AS INTEGER)), 9)
        AS favourite_accuracy
    FROM sp CROSS JOIN m WHERE split = 'val'""",
)
def baseline_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = splitting.with_split(event_samples(spark, sf_dir))
    return rounded(baselines.validation_baselines(samples))


@query(
    "class_weights",
    f"""WITH {SAMPLES_SQL},
    c AS (SELECT target_category_idx, count(*) AS n FROM s GROUP BY ALL),
    z AS (SELECT sum(n) / sum(n / sqrt(n)) AS scale FROM c)
    SELECT target_category_idx, n, round(scale / sqrt(n), 9) AS weight FROM c CROSS JOIN z""",
)
def class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.class_weights(event_samples(spark, sf_dir), TARGET))


@query(
    "class_weights_balanced",
    f"""WITH {SAMPLES_SQL},
    c AS (SELECT target_category_idx, count(*) AS n FROM s GROUP BY ALL),
    z AS (SELECT CAST(sum(n) AS DOUBLE) AS rows, count(*) AS k FROM c)
    SELECT target_category_idx, n, round(rows / (k * n), 9) AS weight FROM c CROSS JOIN z""",
)
def class_weights_balanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.balanced_class_weights(event_samples(spark, sf_dir), TARGET))


@query(
    "sample_weights",
    f"""WITH {SAMPLES_SQL},
    c AS (SELECT target_category_idx, count(*) AS n FROM s GROUP BY ALL),
    z AS (SELECT sum(n) / sum(n / sqrt(n)) AS scale FROM c)
    SELECT user_id, prefix_length, s.target_category_idx, round(scale / sqrt(n), 9) AS weight
    FROM s JOIN c ON s.target_category_idx = c.target_category_idx CROSS JOIN z""",
)
def sample_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = event_samples(spark, sf_dir).select("user_id", "prefix_length", TARGET)
    weighted = metrics.with_class_weight(samples, metrics.class_weights(samples, TARGET), TARGET)
    return rounded(weighted)


@query(
    "accuracy_by_split",
    f"""WITH {SAMPLES_SQL}, {SPLIT_SQL}
    SELECT split, count(*) AS n,
      round(avg(CAST(prefix_most_freq_category_idx = target_category_idx AS INTEGER)), 9)
        AS accuracy
    FROM sp GROUP BY split""",
)
def accuracy_by_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = splitting.with_split(event_samples(spark, sf_dir))
    return rounded(metrics.accuracy(samples, TARGET, FAVOURITE))


@query(
    "top3_accuracy",
    f"""WITH {SAMPLES_SQL}, {SPLIT_SQL},
    long AS (
      SELECT user_id, prefix_length, split, target_category_idx AS y,
        unnest([n0, n1, n2, n3, n4, n5]) AS score, unnest([0, 1, 2, 3, 4, 5]) AS i FROM sp),
    ranked AS (
      SELECT *, row_number() OVER (PARTITION BY user_id, prefix_length
                                   ORDER BY score DESC, i DESC) AS place FROM long)
    SELECT split, count(*) AS n, round(avg(CAST(place <= 3 AS INTEGER)), 9) AS top3_accuracy
    FROM ranked WHERE i = y GROUP BY split""",
)
def top3_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores are the counts per category so far; the label is a position in them."""
    samples = splitting.with_split(event_samples(spark, sf_dir, category_counts=True))
    counts = [f"`{c}`" for c in samples.columns if c.startswith("prefix_cat_count_")]
    return rounded(
        metrics.top_k_accuracy(
            samples.withColumn("scores", F.array(*counts)), TARGET, "scores"
        )
    )


@query(
    "class_report",
    f"""WITH {SAMPLES_SQL},
    p AS (SELECT target_category_idx AS y, prefix_most_freq_category_idx AS g FROM s),
    k AS (SELECT y AS c FROM p UNION SELECT g FROM p),
    m AS (SELECT c, count(*) FILTER (y = c) AS support, count(*) FILTER (g = c) AS predicted,
            count(*) FILTER (y = c AND g = c) AS hits FROM k CROSS JOIN p GROUP BY c),
    r AS (SELECT CAST(c AS VARCHAR) AS class,
            CASE WHEN predicted = 0 THEN 0.0 ELSE hits / predicted END AS p,
            CASE WHEN support = 0 THEN 0.0 ELSE hits / support END AS r, support, hits FROM m),
    f AS (SELECT *, CASE WHEN p + r = 0 THEN 0.0 ELSE 2 * p * r / (p + r) END AS f FROM r)
    SELECT class, round(p, 9) AS precision, round(r, 9) AS recall, round(f, 9) AS f1, support
    FROM f
    UNION ALL
    SELECT 'accuracy', round(sum(hits) / sum(support), 9), round(sum(hits) / sum(support), 9),
      round(sum(hits) / sum(support), 9), CAST(sum(support) AS BIGINT) FROM f
    UNION ALL
    SELECT 'macro avg', round(avg(p), 9), round(avg(r), 9), round(avg(f), 9),
      CAST(sum(support) AS BIGINT) FROM f
    UNION ALL
    SELECT 'weighted avg', round(sum(p * support) / sum(support), 9),
      round(sum(r * support) / sum(support), 9), round(sum(f * support) / sum(support), 9),
      CAST(sum(support) AS BIGINT) FROM f""",
)
def class_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.class_report(event_samples(spark, sf_dir), TARGET, FAVOURITE))


RULES = {"last": "last_category_idx", "favourite": FAVOURITE, "third": "last_3_category_idx"}


def rule_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per rule with its accuracy on each split, from one pass."""
    samples = splitting.with_split(event_samples(spark, sf_dir))
    rows = F.explode(
        F.array(
            *[
                F.struct(F.lit(name).alias("model"), (F.col(c) == F.col(TARGET)).alias("hit"))
                for name, c in RULES.items()
            ]
        )
    )
    hits = samples.select("split", rows.alias("r")).select("split", "r.*")
    return hits.groupBy("model").agg(
        *[
            F.avg(F.when(F.col("split") == s, F.col("hit").cast("int"))).alias(f"{s}_acc")
            for s in ("train", "val", "test")
        ]
    )


RULES_SQL = f"""{SAMPLES_SQL}, {SPLIT_SQL},
h AS (
  SELECT 'last' AS model, split, last_category_idx = target_category_idx AS hit FROM sp
  UNION ALL SELECT 'favourite', split, prefix_most_freq_category_idx = target_category_idx FROM sp
  UNION ALL SELECT 'third', split, last_3_category_idx = target_category_idx FROM sp),
rules AS (
  SELECT model, round(avg(CAST(hit AS INTEGER)) FILTER (split = 'train'), 9) AS train_acc,
    round(avg(CAST(hit AS INTEGER)) FILTER (split = 'val'), 9) AS val_acc,
    round(avg(CAST(hit AS INTEGER)) FILTER (split = 'test'), 9) AS test_acc
  FROM h GROUP BY model)"""


@query(
    "best_model",
    f"""WITH {RULES_SQL}
    SELECT *, CAST(1 AS INTEGER) AS rank FROM rules ORDER BY val_acc DESC, model LIMIT 1""",
)
def best_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.best_model(rule_metrics(spark, sf_dir)))


@query(
    "model_ranking",
    f"""WITH {RULES_SQL}
    SELECT *, CAST(row_number() OVER (ORDER BY val_acc DESC, model) AS INTEGER) AS rank
    FROM rules""",
)
def model_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.rank_models(rule_metrics(spark, sf_dir)))
