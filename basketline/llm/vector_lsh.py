"""Near-duplicate vectors by cosine, found with random hyperplanes in several tables.

Equal vectors collapse first and count as often as they occur. Each table signs the vectors by
random hyperplanes; vectors with the same signs share a bucket. Buckets are compared in
blocks of exact cosine products in double precision. A pair that an earlier table has
already put together is left to that table, so every link is counted once. Tasks emit no
pairs: a vector's number of links in the bucket, and one link to its group there.
Connected components of these links give the groups.

The signs per table grow with the logarithm of the number of vectors, so buckets stay small,
and the tables are as many as the wanted recall needs for a pair right at the threshold.
A bucket larger than a block is compared block against block, each pair of blocks in a
task of its own; all its pairs are compared, whatever its size.

Null, empty and zero vectors, and those with null or non-finite components, link with
nothing. Vectors of different lengths don't link. A group is named by its smallest vec_id;
a row whose vec_id is null is never kept.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketline.llm.common import Merged, group_bounds, whole_groups
from basketline.llm.components import components
from basketline.staging import stage

#: Vectors that a bucket of unrelated vectors holds on average.
BUCKET = 64
#: Share of pairs right at the threshold that no table may put together.
MISSED = 0.01
#: Vectors of a bucket that are compared at a time.
BLOCK = 1_024
SEED = 4

KEYS = ["dim", "table", "code", "one", "two"]


def plan(n: int, threshold: float) -> tuple[int, int]:
    """Signs per table and number of tables for ``n`` vectors."""
    signs = min(31, max(4, math.ceil(math.log2(max(n, 1) / BUCKET))))
    together = (1 - math.acos(threshold) / math.pi) ** signs
    return signs, math.ceil(math.log(MISSED) / math.log1p(-together))


def _unit(rows: np.ndarray) -> np.ndarray:
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def _matrix(table: pa.Table, begin: int, end: int) -> np.ndarray:
    """Rows of the vector column, which all have the same length."""
    column = table["vector"].combine_chunks()
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    flat = column.slice(begin, end - begin).flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.float64).reshape(end - begin, -1)


def _sign(signs: int, tables: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            codes = np.zeros((len(batch), tables), dtype="<i4")
            dims = batch["dim"].to_numpy()
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                planes = np.random.default_rng([SEED, int(dim)]).standard_normal((dim, tables * signs))
                bits = _unit(_matrix(table.take(at), 0, len(at))) @ planes >= 0
                weights = (1 << np.arange(signs)).astype(np.int64)
                codes[at] = bits.reshape(len(at), tables, signs) @ weights
            column = pa.array([row.tobytes() for row in codes], pa.binary())
            lists = pa.ListArray.from_arrays(
                pa.array(np.arange(len(batch) + 1) * tables, pa.int32()), pa.array(codes.ravel(), pa.int32())
            )
            yield pa.RecordBatch.from_arrays(
                [*(batch[c] for c in ("node", "copies", "dim", "vector")), column, lists],
                names=["node", "copies", "dim", "vector", "codes", "buckets"],
            )

    return run


def _compare(threshold: float):
    out = ("node", "n", "root")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, KEYS):
            bounds = group_bounds(table, KEYS)
            node, copies = table["node"].to_numpy(), table["copies"].to_numpy()
            own, one, two = (table[c].to_numpy() for c in ("block", "one", "two"))
            which = table["table"].to_numpy()
            signs = table["codes"].to_pylist()
            found: list[tuple] = [tuple(np.empty(0, np.int64) for _ in out)]
            for begin, end in zip(bounds[:-1], bounds[1:], strict=True):
                if end - begin < 2:
                    continue
                unit = _unit(_matrix(table, begin, end))
                codes = np.frombuffer(b"".join(signs[begin:end]), dtype="<i4").reshape(end - begin, -1)
                earlier = codes[:, : which[begin]]
                same = one[begin] == two[begin]
                left = np.flatnonzero(own[begin:end] == one[begin])
                right = left if same else np.flatnonzero(own[begin:end] == two[begin])
                merged, links = Merged(end - begin), np.zeros(end - begin, dtype=np.int64)
                for at in range(0, len(left), 256):
                    rows = left[at : at + 256]
                    a, b = np.nonzero(unit[rows] @ unit[right].T >= threshold)
                    a, b = rows[a], right[b]
                    if same:
                        a, b = a[a < b], b[a < b]
                    fresh = ~(earlier[a] == earlier[b]).any(axis=1)
                    a, b = a[fresh], b[fresh]
                    np.add.at(links, a, copies[begin:end][b])
                    np.add.at(links, b, copies[begin:end][a])
                    merged.link(a, b)
                at = np.flatnonzero(links)
                found.append((node[begin:end][at], links[at], node[begin:end][merged.label[at]]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], names=out)

    return run


def distinct_vectors(vectors: DataFrame, vector: str, vec_id: str) -> DataFrame:
    """Usable vectors, each once: (node, vector, copies, first, dim)."""
    usable = F.expr(
        f"`{vector}` IS NOT NULL AND forall(`{vector}`, x -> x IS NOT NULL AND abs(x) < double('infinity')) "
        f"AND exists(`{vector}`, x -> x <> 0)"
    )
    return (
        vectors.where(usable)
        .groupBy(F.col(vector).alias("vector"))
        .agg(F.count("*").alias("copies"), F.min(vec_id).alias("first"))
        .withColumns({"node": F.monotonically_increasing_id(), "dim": F.size("vector").cast("long")})
    )


def near_duplicates(
    vectors: DataFrame, threshold: float = 0.9, vec_id: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row."""
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(vector).alias("own"))
    classes = stage(distinct_vectors(rows, "own", "vec_id"), "vectors")
    signs, tables = plan(classes.count(), threshold)
    signed = classes.select("node", "copies", "dim", "vector").mapInArrow(
        _sign(signs, tables),
        f"node long, copies long, dim long, vector {classes.schema['vector'].dataType.simpleString()}, "
        "codes binary, buckets array<int>",
    )
    signed = stage(signed, "signed")
    placed = signed.select("node", "dim", F.posexplode("buckets").alias("table", "code"))
    sizes = placed.groupBy("dim", "table", "code").agg(F.count("*").alias("n"))
    # Buckets of one vector have nothing to compare, and most large ones fit in a block.
    sizes = sizes.where("n > 1").withColumn("blocks", F.ceil(F.col("n") / BLOCK))
    bucketed = signed.select(
        "node", "copies", "dim", "vector", "codes", F.posexplode("buckets").alias("table", "code")
    ).join(stage(sizes, "buckets").drop("n"), ["dim", "table", "code"])
    block = F.pmod(F.xxhash64("node"), F.col("blocks"))
    paired = (
        bucketed.withColumn("block", block)
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        .withColumns({"one": F.least("block", "other"), "two": F.greatest("block", "other")})
        .select(*KEYS, "node", "copies", "vector", "codes", "block")
    )
    placed = paired.repartition(*KEYS).sortWithinPartitions(*KEYS)
    found = stage(placed.mapInArrow(_compare(threshold), "node long, n long, root long"), "links")
    links = found.groupBy("node").agg(F.sum("n").alias("n"))
    grouped = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    named = (
        classes.select("node", "vector", "copies", "first")
        .join(links, "node", "left")
        .join(grouped, "node", "left")
        .withColumn("component", F.coalesce("component", "node"))
    )
    named = stage(named, "linked")
    least = named.groupBy("component").agg(F.min("first").alias("component_id"))
    named = named.join(least, "component").select(
        "vector", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), "component_id"
    )
    return rows.join(named, F.col("own") == F.col("vector"), "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("vector").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"),
        F.coalesce(
            F.col("vector").isNull() & F.col("vec_id").isNotNull() | (F.col("vec_id") == F.col("component_id")),
            F.lit(False),
        ).alias("kept"),
    )
