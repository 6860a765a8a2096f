"""Entropy expressions over purchase counts."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from basketline.config import ENTROPY_EPSILON


def x_log_x(x: Column) -> Column:
    """``x ln x`` with the limit 0 at 0."""
    return F.when(x > 0, x * F.ln(x)).otherwise(F.lit(0.0))


def entropy_from_sums(total: Column, sum_x_log_x: Column) -> Column:
    """``ln T - (sum x ln x) / T``, the entropy of counts x with sum T; 0 when empty."""
    entropy = F.greatest(F.lit(0.0), F.ln(total) - sum_x_log_x / total)
    return F.when(total > 0, entropy).otherwise(F.lit(0.0))


def smoothed_entropy(
    total: Column, non_zero: Column, sum_smoothed: Column, n_categories: int
) -> Column:
    """Entropy after adding epsilon to the count of each of ``n_categories`` cells.

    ``sum_smoothed`` is the sum of ``x ln x`` over a user's non-zero cells, x being
    count plus epsilon. All empty cells add the same term, so they need no rows.
    """
    eps = F.lit(ENTROPY_EPSILON)
    mass = total + F.lit(n_categories * ENTROPY_EPSILON)
    empty = (F.lit(n_categories) - non_zero) * x_log_x(eps)
    return F.greatest(F.lit(0.0), F.ln(mass) - (sum_smoothed + empty) / mass)


def normalised(entropy: Column, n_categories: int) -> Column:
    """Entropy over its maximum; 0 when only one category exists."""
    if n_categories <= 1:
        return F.lit(0.0)
    return entropy / F.lit(math.log(n_categories))

