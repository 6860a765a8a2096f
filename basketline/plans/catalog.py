"""Importing this module registers all queries."""

from basketline.plans.queries import (  # noqa: F401
    counting,
    derived,
    evaluation,
    features,
    ingest,
    learning,
    reruns,
    scoring,
    sequences,
    splits,
)
from basketline.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
