"""Helpers that several operators share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, with underscores put before it until no column has that name."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted


def id_remainder(doc_id: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id has no remainder."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % modulus


def held_out(doc_id: str, modulus: int, remainder: int) -> Column:
    """True for the ids set aside for testing; false for a null id."""
    return F.coalesce(id_remainder(doc_id, modulus) == remainder, F.lit(False))


def labelled_sample(
    docs: DataFrame,
    labels: DataFrame,
    label: str,
    train: Column,
    per_class: int,
    seed: int,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """At most ``per_class`` labelled training texts of either class: (text, label).

    The choice follows a seeded hash of the id, so it does not depend on row order. Ids
    are picked first, from the narrow label table; only then are texts read, against a
    list of at most ``2 * per_class`` ids, which is why that list may be broadcast. An id
    with several labels takes the larger; of several documents of one id, the text with the
    smallest seeded hash counts. Null texts are empty, null ids and labels are left out, and
    empty tables give an empty sample.
    """
    known = (
        labels.where(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull() & train)
        .groupBy(F.col(doc_id).alias("sample_id"))
        .agg(F.max(label).cast("int").alias("label"))
    )
    order = F.xxhash64(F.col("sample_id"), F.lit(seed))
    ids = None
    for value in (0, 1):
        part = known.where(F.col("label") == value).orderBy(order, "sample_id").limit(per_class)
        ids = part if ids is None else ids.unionAll(part)
    texts = docs.select(F.col(doc_id).alias("sample_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    chosen = F.min_by("text", F.xxhash64(F.col("text"), F.lit(seed))).alias("text")
    return texts.join(F.broadcast(ids), "sample_id").groupBy("sample_id", "label").agg(chosen).select("text", "label")


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Batches cut anew so that rows with equal integer ``keys``, which follow each other,
    come together. Memory is one batch and one group."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        table = table if held is None else pa.concat_tables([held, table])
        values = np.stack([table[k].to_numpy() for k in keys], axis=1)
        others = np.flatnonzero((values != values[-1]).any(axis=1))
        cut = int(others[-1]) + 1 if len(others) else 0
        if cut:
            yield table.slice(0, cut).combine_chunks()
        held = table.slice(cut)
    if held is not None:
        yield held.combine_chunks()


def group_bounds(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Where groups of equal ``keys`` begin, with the number of rows at the end."""
    values = np.stack([table[k].to_numpy() for k in keys], axis=1)
    new = np.flatnonzero((values[1:] != values[:-1]).any(axis=1)) + 1
    return np.concatenate([[0], new, [len(values)]])


class Merged:
    """Positions merged into groups; a group's label is its smallest position."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        label = self.label
        while True:
            la, lb = label[a], label[b]
            apart = la != lb
            if not apart.any():
                return
            low, high = np.minimum(la, lb)[apart], np.maximum(la, lb)[apart]
            np.minimum.at(label, high, low)
            while (label[label] != label).any():
                label[:] = label[label]
