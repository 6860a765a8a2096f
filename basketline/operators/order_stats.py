"""Exact ranks, quantiles and seeded subsets for columns of any size.

``percentile`` keeps every distinct value in one aggregation buffer, and a large
``limit`` after a sort merges all partitions' candidates in one task. Here an
approximate sketch brackets the wanted rank, exact counts check the bracket, and
only rows strictly inside it are looked at again. The answer is exact and no task
holds more than ``exact_rows`` values.

The input is scanned a few times: pass a stored table or a cheap scan.
"""

from __future__ import annotations

import bisect
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketline.config import EXACT_RANK_ROWS, RANDOM_SEED
from basketline.functions.hashing import seeded_rank_hash
from basketline.staging import stage

SKETCH_ACCURACY = 10_000
#: Equal parts that a sketch cuts the hashes into.
GRID = 1_000


def value_at_rank(
    df: DataFrame, column: str, rank: int, n_rows: int, exact_rows: int = EXACT_RANK_ROWS
):
    """The value at a 1-based rank among the ``n_rows`` non-null values."""
    return value_at_ranks(df, column, rank, rank, n_rows, exact_rows)[0]


def value_at_ranks(
    df: DataFrame, column: str, first: int, last: int, n_rows: int, exact_rows: int = EXACT_RANK_ROWS
) -> list:
    """Values at the neighbouring 1-based ranks ``first`` to ``last``.

    Values are compared as doubles, which is exact for integers up to 2^53. Each round
    keeps a thin slice around the ranks, a few ten-thousandths of the rows plus repeats,
    so two or three rounds reach any table size.
    """
    v = F.col("v")
    rows = df.select(F.col(column).cast("double").alias("v")).where(v.isNotNull())
    found, wanted = {}, list(range(first, last + 1))
    below, inside, slack = 0, n_rows, 3.0 / SKETCH_ACCURACY
    while wanted:
        if inside <= exact_rows:
            values = rows.agg(F.sort_array(F.collect_list("v")).alias("a")).first()["a"]
            found |= {rank: values[rank - below - 1] for rank in wanted}
            break
        shares = [
            max(0.0, (wanted[0] - below) / inside - slack),
            min(1.0, (wanted[-1] - below) / inside + slack),
        ]
        low, high = rows.agg(F.percentile_approx("v", shares, SKETCH_ACCURACY)).first()[0]
        counts = rows.agg(
            F.count_if(v < low).alias("under"),
            F.count_if(v == low).alias("at_low"),
            F.count_if((v > low) & (v < high)).alias("between"),
            F.count_if((v == high) & (v > low)).alias("at_high"),
        ).first()
        start = below + counts["under"]
        first_between = start + counts["at_low"]
        last_between = first_between + counts["between"]
        if wanted[0] <= start or wanted[-1] > last_between + counts["at_high"]:
            slack *= 10
            continue
        found |= {rank: low for rank in wanted if rank <= first_between}
        found |= {rank: high for rank in wanted if rank > last_between}
        wanted = [rank for rank in wanted if rank not in found]
        rows = rows.where((v > low) & (v < high))
        below, inside, slack = first_between, counts["between"], 3.0 / SKETCH_ACCURACY
    return [found[rank] for rank in range(first, last + 1)]


def quantile(
    df: DataFrame, column: str, share: float, exact_rows: int = EXACT_RANK_ROWS
) -> float | None:
    """Linear-interpolated quantile; ``None`` for an empty column."""
    n_rows = df.agg(F.count(column)).first()[0]
    if n_rows == 0:
        return None
    position = (n_rows - 1) * share
    lower = math.floor(position)
    upper = min(lower + 1, n_rows - 1)
    ends = value_at_ranks(df, column, lower + 1, upper + 1, n_rows, exact_rows)
    return float(ends[0] + (ends[-1] - ends[0]) * (position - lower))


def seeded_subset(
    df: DataFrame,
    n: int,
    keys: list[str],
    seed: int = RANDOM_SEED,
    exact_rows: int = EXACT_RANK_ROWS,
) -> DataFrame:
    """``n`` rows without replacement: those whose seeded key hash is smallest.

    All rows when there are no more than ``n``. The cut-off hash is found first, from a
    stored column of hashes, so the subset itself is a plain filter, wherever the rows lie.
    """
    if n <= 0:
        return df.where(F.lit(False))
    own = seeded_rank_hash(*[F.col(k) for k in keys], seed=seed)
    hashes = stage(df.select(own.alias("h")), "row-hashes")
    found = _smallest(hashes, n, exact_rows)
    if found is None:
        return df
    cut, room, at = found
    hashed = df.withColumn("_h", own)
    if at <= room:
        return hashed.where(F.col("_h") <= cut).drop("_h")
    tied = hashed.where(F.col("_h") == cut).orderBy(*keys).limit(room)
    return hashed.where(F.col("_h") < cut).unionByName(tied).drop("_h")


def _sketch(hashes: DataFrame) -> tuple[int, list[int]]:
    """How many hashes there are, and marks that cut them into about equal parts."""
    grid = [k / GRID for k in range(GRID + 1)]
    return tuple(hashes.agg(F.count("h"), F.percentile_approx("h", grid, SKETCH_ACCURACY)).first())


def _smallest(hashes: DataFrame, n: int, exact_rows: int) -> tuple[int, int, int] | None:
    """The n-th smallest hash, how many rows with it belong to the n, and how many there are.

    One pass sketches the hashes; the next counts what lies in the sketch's bracket, a few
    thousandths, and brings it if the marks show that it fits in a buffer: a hash of many rows
    fills several marks. A larger bracket is sketched again, and one that does not hold the
    rank, or is no narrower, gives way to the half of the range that does. None when there
    are at most n rows.
    """
    h, below, low, high = F.col("h"), 0, -1, 1 << 60
    while True:
        inside = hashes.where((h >= low) & (h <= high))
        total, marks = _sketch(inside)
        if below + total <= n:
            return None
        small = total <= exact_rows
        step_low, step_high = low, high
        if not small:
            place = (n - below) / total * GRID
            step_low = marks[max(0, math.floor(place) - 1)]
            step_high = marks[min(GRID, math.ceil(place) + 1)]
            parts = bisect.bisect_right(marks, step_high) - bisect.bisect_left(marks, step_low) + 1
            small = total * parts * 1.1 / GRID <= exact_rows
        bracket = (h >= step_low) & (h <= step_high)
        values = F.sort_array(F.collect_list(F.when(bracket & F.lit(small), h)))
        under, kept, found = inside.agg(F.count_if(h < step_low), F.count_if(bracket), values).first()
        wanted = n - below - under
        if not 0 < wanted <= kept:
            narrower = False
        elif found:
            cut = found[wanted - 1]
            return cut, wanted - bisect.bisect_left(found, cut), found.count(cut)
        elif step_low == step_high:
            return step_low, wanted, kept
        else:
            narrower = (step_low, step_high) != (low, high)
        if narrower:
            below, low, high = below + under, step_low, step_high
            continue
        middle = (low + high) // 2
        lower = inside.agg(F.count_if(h <= middle)).first()[0]
        if n - below <= lower:
            high = middle
        else:
            below, low = below + lower, middle + 1
