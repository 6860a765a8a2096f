"""Named queries, each with the SQL text that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Register a query; ``oracle`` is left out where SQL cannot say the same."""

    def register(function: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = function
        if oracle is not None:
            ORACLES[name] = oracle
        return function

    return register


def rounded(df: DataFrame, digits: int = 9) -> DataFrame:
    """Round all doubles, since engines add them up in different orders."""
    return df.select(
        *[
            F.round(F.col(f"`{name}`"), digits).alias(name) if dtype == "double" else F.col(f"`{name}`")
            for name, dtype in df.dtypes
        ]
    )
