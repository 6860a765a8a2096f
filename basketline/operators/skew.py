"""Keys that hold too many rows for one task.

Aggregates survive such keys through map-side partials, joins through adaptive
skew splitting. Window functions do not: a window partition is one task. The
functions here find those keys and cut their rows into ordered pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketline.config import HOT_KEY_ROWS, MAX_BROADCAST_KEYS
from basketline.staging import stage


def hot_keys(df: DataFrame, key: str, max_rows: int = HOT_KEY_ROWS) -> DataFrame | None:
    """Keys with more than ``max_rows`` rows, or ``None`` when there are none.

    At most rows / ``max_rows`` keys qualify. Up to the broadcast limit the
    result carries a broadcast hint; beyond it, it is a plain stored table.
    """
    return known_hot_keys(df.groupBy(key).agg(F.count(F.lit(1)).alias("n")), key, "n", max_rows)


def known_hot_keys(
    sizes: DataFrame, key: str, size: str, max_rows: int = HOT_KEY_ROWS
) -> DataFrame | None:
    """As ``hot_keys``, from a table that already holds the rows per key."""
    large = sizes.where(F.col(size) > max_rows)
    n_hot = large.count()
    if n_hot == 0:
        return None
    keys = stage(large.select(key), "hot-keys")
    return F.broadcast(keys) if n_hot <= MAX_BROADCAST_KEYS else keys


def split_hot(df: DataFrame, key: str, hot: DataFrame | None) -> tuple[DataFrame, DataFrame | None]:
    """Rows of ordinary keys and rows of hot keys."""
    if hot is None:
        return df, None
    return df.join(hot, key, "left_anti"), df.join(hot, key, "left_semi")


def cut_in_order(df: DataFrame, key: str, order: list[str], rows_per_chunk: int) -> DataFrame:
    """Give each row a ``chunk`` number that grows with ``order`` within its key.

    A range-partitioned shuffle splits even a single key, since the order columns
    are part of the range. Rows equal in all of them are told apart by a row id
    that is stored first, so that a lost task cannot place a copy differently. The
    chunk numbers depend on sampled range bounds and are stored for the same reason.
    """
    rows = stage(df.withColumn("_row", F.monotonically_increasing_id()), "hot-rows")
    pieces = max(1, -(-rows.count() // rows_per_chunk))
    ranged = rows.repartitionByRange(pieces, key, *order, "_row")
    return stage(ranged.withColumn("chunk", F.spark_partition_id()), "hot-chunks")
