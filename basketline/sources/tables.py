"""Stage tables: Parquet in and out, JSON statistics out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from basketline.config import MAX_RECORDS_PER_FILE, USER_BUCKETS
from basketline.functions.hashing import user_bucket


def write_table(
    df: DataFrame,
    path: str,
    partition_by: tuple[str, ...] = ("category",),
    max_records_per_file: int = MAX_RECORDS_PER_FILE,
    categories: list[str] | None = None,
) -> None:
    """Replace a stage table, or only the partitions of some ``categories`` of it.

    A named category without rows loses its old partition, too. The rebalance hint
    evens out file sizes: small categories end up in one file each, and adaptive
    execution splits a large one over many tasks.
    """
    before = _files(df.sparkSession, path, categories or [])
    writer = (
        df.hint("rebalance", *[F.col(c) for c in partition_by])
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "static" if categories is None else "dynamic")
        .option("maxRecordsPerFile", max_records_per_file)
        .partitionBy(*partition_by)
    )
    writer.parquet(path)
    _drop_unchanged(df.sparkSession, before)


def _files(spark: SparkSession, path: str, categories: list[str], key: str = "category") -> dict[str, set[str]]:
    """The files below the partition folder of each category that has one."""
    jvm, found = spark._jvm, {}
    for name in categories:
        escaped = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(name)
        folder = jvm.org.apache.hadoop.fs.Path(path, f"{key}={escaped}")
        fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
        if fs.exists(folder):
            found[folder.toString()] = {status.getPath().getName() for status in fs.listStatus(folder)}
    return found


def _drop_unchanged(spark: SparkSession, before: dict[str, set[str]]) -> None:
    """Remove partition folders that a write has left as they were: it had no rows for them."""
    jvm = spark._jvm
    for name, files in before.items():
        folder = jvm.org.apache.hadoop.fs.Path(name)
        fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
        if fs.exists(folder) and {status.getPath().getName() for status in fs.listStatus(folder)} == files:
            fs.delete(folder, True)


def write_by_user_bucket(df: DataFrame, path: str, buckets: int = USER_BUCKETS) -> None:
    """Write rows under ``user_bucket=<n>`` folders.

    The rebalance hint groups a bucket's rows into few files, while adaptive
    execution still splits a bucket that one very active user makes too large.
    """
    bucketed = df.withColumn("user_bucket", user_bucket(F.col("user_id"), buckets))
    (
        bucketed.hint("rebalance", F.col("user_bucket"))
        .write.mode("overwrite")
        .partitionBy("user_bucket")
        .parquet(path)
    )


def write_bucketed(
    df: DataFrame, name: str, path: str, buckets: int, sort_by: tuple[str, ...] = (), key: str = "user_id"
) -> DataFrame:
    """Store rows in ``buckets`` files by ``key`` as the catalog table ``name``, and scan it.

    Windows and joins on the key then need no shuffle, as often as the table is read; tables
    joined must have the same number of buckets. One task writes, and later reads, a bucket:
    choose enough of them, and cut keys beyond that (``skew``). A null key has one bucket.
    """
    (
        df.repartition(buckets, key)
        .write.mode("overwrite")
        .option("path", path)
        .bucketBy(buckets, key)
        .sortBy(key, *sort_by)
        .saveAsTable(name)
    )
    return df.sparkSession.table(name)


def exists(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def read_table(
    spark: SparkSession,
    path: str,
    schema: StructType | None = None,
    categories: list[str] | None = None,
) -> DataFrame:
    """One scan over all categories; ``categories`` prunes partition folders."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    df = reader.parquet(path)
    return df if categories is None else only_categories(df, categories)


def only_categories(df: DataFrame, categories: list[str]) -> DataFrame:
    return df.where(F.col("category").isin(*categories))


def union_tables(*tables: DataFrame) -> DataFrame:
    """UNION ALL by name; columns a table lacks are null."""
    first, *rest = tables
    for table in rest:
        first = first.unionByName(table, allowMissingColumns=True)
    return first


def empty_like(spark: SparkSession, schema: StructType) -> DataFrame:
    """An empty table that still has all its columns and types."""
    return spark.createDataFrame([], schema)


REVIEW_DEFAULTS = {
    "rating": ("double", None),
    "helpful_votes": ("int", 0),
    "item_avg_rating": ("double", None),
    "verified_purchase": ("boolean", False),
}


def with_review_defaults(df: DataFrame) -> DataFrame:
    """Add the review columns that a source lacks, with their default value."""
    absent = {
        name: F.lit(value).cast(dtype)
        for name, (dtype, value) in REVIEW_DEFAULTS.items()
        if name not in df.columns
    }
    return df.withColumns(absent) if absent else df


def describe_table(df: DataFrame) -> DataFrame:
    """Rows and columns of a table as one row."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select(
        "n_rows",
        F.lit(len(df.columns)).alias("n_columns"),
        F.lit(",".join(sorted(df.columns))).alias("column_names"),
    )


def histogram_map(hist: DataFrame, bucket: str, key: str = "category", name: str = "hist") -> DataFrame:
    """Fold histogram rows into one ordered map per key.

    Input is already aggregated: its rows per key are the distinct buckets.
    """
    entries = F.sort_array(F.collect_list(F.struct(bucket, "n")))
    folded = hist.groupBy(key).agg(entries.alias("entries"))
    as_text = F.transform("entries", lambda e: F.struct(e[bucket].cast("string"), e["n"]))
    return folded.select(key, F.map_from_entries(as_text).alias(name))


def stats_as_json(scalars: DataFrame, maps: dict[str, DataFrame], key: str = "category") -> DataFrame:
    """One JSON text per key from a scalar table and map tables."""
    joined = scalars
    for table in maps.values():
        joined = joined.join(table, key, "left")
    names = [key] + [c for c in scalars.columns if c != key] + list(maps)
    return joined.select(key, F.to_json(F.struct(*names)).alias("stats"))


def write_json(
    stats: DataFrame, path: str, categories: list[str] | None = None, key: str = "category"
) -> None:
    """One line of JSON per key, in a folder per key; ``categories`` replaces only theirs."""
    lines = stats.select(key, F.col("stats").alias("value"))
    before = _files(stats.sparkSession, path, categories or [], key)
    mode = "static" if categories is None else "dynamic"
    writer = lines.write.mode("overwrite").option("partitionOverwriteMode", mode)
    writer.partitionBy(key).text(path)
    _drop_unchanged(stats.sparkSession, before)


def read_json(spark: SparkSession, path: str, key: str = "category") -> DataFrame:
    """(key, stats) of all keys."""
    return spark.read.schema(f"value string, {key} string").text(path).select(key, F.col("value").alias("stats"))
