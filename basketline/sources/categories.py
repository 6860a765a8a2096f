"""The category dimension: names in a fixed order, ``Unknown`` at index 0."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketline.config import MAX_BROADCAST_KEYS, MAX_CATEGORY_COLUMNS

UNKNOWN = "Unknown"


def read_category_list(spark: SparkSession, path: str) -> list[str]:
    """Names from a text file: trimmed, blanks dropped, file order kept."""
    name = F.regexp_replace("value", r"^\s+|\s+$", "")
    lines = spark.read.text(path).select(
        F.monotonically_increasing_id().alias("position"), name.alias("name")
    )
    return [r["name"] for r in lines.where(F.col("name") != "").orderBy("position").collect()]


def categories_in(df: DataFrame, column: str = "category") -> list[str]:
    """Distinct names found in a table, in alphabetical order."""
    names = df.select(column).where(F.col(column).isNotNull()).distinct()
    return [r[0] for r in names.orderBy(column).collect()]


def as_columns(names: list[str]) -> list[str]:
    """The names, where each becomes a column: only then is their number limited."""
    if len(names) > MAX_CATEGORY_COLUMNS:
        raise ValueError(f"more than {MAX_CATEGORY_COLUMNS} categories cannot be columns")
    return names


def category_index(names: list[str]) -> dict[str, int]:
    """Name to index. ``Unknown`` is 0, the others count from 1 in list order."""
    known = [n for n in dict.fromkeys(names) if n != UNKNOWN]
    return {UNKNOWN: 0} | {name: i for i, name in enumerate(known, start=1)}


def category_dim(spark: SparkSession, names: list[str]) -> DataFrame:
    """The dimension as a table, to broadcast up to a checked size."""
    rows = list(category_index(names).items())
    dim = spark.createDataFrame(rows, "category string, category_idx int")
    return F.broadcast(dim) if len(rows) <= MAX_BROADCAST_KEYS else dim


def with_category_index(df: DataFrame, names: list[str]) -> DataFrame:
    """Add ``category_idx``; names outside the list get 0."""
    dim = category_dim(df.sparkSession, names)
    joined = df.join(dim, "category", "left")
    return joined.withColumn("category_idx", F.coalesce("category_idx", F.lit(0)))


def with_category_name(df: DataFrame, names: list[str]) -> DataFrame:
    """Add ``category`` from ``category_idx``; unknown indexes get ``Unknown``."""
    dim = category_dim(df.sparkSession, names)
    joined = df.join(dim, "category_idx", "left")
    return joined.withColumn("category", F.coalesce("category", F.lit(UNKNOWN)))


def missing_categories(expected: DataFrame, *outputs: DataFrame) -> DataFrame:
    """Expected categories that at least one of the given tables does not hold."""
    complete = expected.select("category").distinct()
    wanted = complete
    for table in outputs:
        complete = complete.join(table.select("category"), "category", "left_semi")
    return wanted.join(complete, "category", "left_anti")
