"""Stable hashes, the same in any engine that has md5."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from basketline.config import RANDOM_SEED, USER_BUCKETS


def _hex_to_long(digits: Column) -> Column:
    return F.conv(digits, 16, 10).cast("long")


def user_bucket(user_id: Column, buckets: int = USER_BUCKETS) -> Column:
    """Bucket of a user: the first 32 bits of md5, modulo ``buckets``."""
    head = F.substring(F.md5(user_id.cast("string")), 1, 8)
    return F.pmod(_hex_to_long(head), F.lit(buckets)).cast("int")


def seeded_rank_hash(*keys: Column, seed: int = RANDOM_SEED) -> Column:
    """52-bit hash of a row key, exact as a double; ordering by it is a seeded shuffle."""
    text = F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") for k in keys])
    return _hex_to_long(F.substring(F.md5(text), 1, 13))
