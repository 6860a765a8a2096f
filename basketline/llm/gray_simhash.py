"""SimHash fingerprints, linked through a hierarchical index in Gray order.

Every distinct fingerprint is indexed; copies collapse before anything is compared. The
upper nodes of the index are masked bit patterns that their fingerprints share. Two
fingerprints that differ in at most two bits agree in full on one of three parts of their
bits, so they meet below one of three upper nodes. A node with too many fingerprints is
split again, by three parts of the bits not yet fixed, as often as it takes; pairs still
meet, for the same reason.

Within an upper node a task sorts fingerprints by Gray rank, so that neighbours share
many bits, and cuts them into leaves, and runs of leaves into inner nodes. A node keeps the
mask of bits on which all below it agree, and their pattern. Going down, a pair of nodes
gathers the differences between the bits that both have fixed so far; past the limit, the
whole pair of groups is dropped. Leaves that remain are compared fingerprint by
fingerprint. What leaves the task is not pairs but, for each fingerprint that has a
neighbour, the smallest one it is connected to there. Connected components of these
links give the groups.

Words are separated by ASCII white space; A-Z are lower-cased. Null texts and texts without a
word have fingerprint zero and link like any other. Rows with equal texts are one
fingerprint; a null doc_id has a fingerprint and a component like others, but names none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketline.llm.components import components
from basketline.llm.common import Merged, free_name, group_bounds, whole_groups
from basketline.staging import stage

SHINGLE = 3
SEED = 42
LIMIT = 2
#: Fingerprints below one upper node that a task indexes; larger nodes are split further.
NODE_SIZE = 4_096
LEAF = 32
FAN_OUT = 8
#: Shingle hashes whose bits are counted at a time.
HASHES = 1 << 16

ALL_BITS = (1 << 64) - 1


def fingerprint(text: str | None) -> int:
    """The majority bits of all shingles' hashes, as an unsigned number."""
    words = text.encode("utf-8", "replace").lower().split() if text else []
    if not words:
        return 0
    if len(words) <= SHINGLE:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, dtype=np.int64)
    shingles = map(b" ".join, zip(*(words[i:] for i in range(SHINGLE)), strict=False))
    n = len(words) - SHINGLE + 1
    for _ in range(0, n, HASHES):
        count = min(HASHES, n)
        n -= count
        hashes = np.fromiter((digest(next(shingles), SEED) for _ in range(count)), dtype=np.uint64, count=count)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(count, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    total = len(words) - SHINGLE + 1
    return int(np.packbits(ones * 2 > total, bitorder="little").view(np.uint64)[0])


def fingerprints(text: str) -> Column:
    """A column with the fingerprint of each text, as a signed long of the same bits."""

    @F.pandas_udf("long")
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            codes = np.array([fingerprint(t) for t in batch], dtype=np.uint64)
            yield pd.Series(codes.view(np.int64))

    return found(F.col(text))


def as_hex(column: str) -> Column:
    return F.lower(F.lpad(F.hex(column), 16, "0"))


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Place of each code in the Gray sequence, where neighbours differ in one bit."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def split_mask(mask: int, parts: int = LIMIT + 1) -> list[int]:
    """The mask together with each of ``parts`` shares of the bits it leaves open."""
    open_bits = [b for b in range(64) if not mask >> b & 1]
    cuts = [len(open_bits) * k // parts for k in range(parts + 1)]
    return [mask | sum(1 << b for b in open_bits[a:b_]) for a, b_ in zip(cuts[:-1], cuts[1:], strict=True)]


def _shared(codes: np.ndarray, starts: np.ndarray, masks: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Mask and pattern of the bits on which each run of codes (or nodes) agrees."""
    every = np.bitwise_and.reduceat(codes, starts)
    some = np.bitwise_or.reduceat(codes, starts)
    same = ~(every ^ some)
    if masks is not None:
        same &= np.bitwise_and.reduceat(masks, starts)
    return same, every & same


def _pairs_below(pairs: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """All pairs of children of pairs of nodes, each once; a node may be paired with itself."""
    out = []
    for a, b in pairs.T:
        left, right = np.arange(starts[a], ends[a]), np.arange(starts[b], ends[b])
        both = np.stack([np.repeat(left, len(right)), np.tile(right, len(left))])
        out.append(both[:, both[0] <= both[1]] if a == b else both)
    return np.concatenate(out, axis=1) if out else np.empty((2, 0), dtype=np.int64)


def link_node(codes: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """For distinct codes in Gray order, the position of the first code of each one's group."""
    n, merged = len(codes), Merged(len(codes))
    if n < 2:
        return merged.label
    leaf_starts = np.arange(0, n, LEAF)
    leaf_ends = np.minimum(leaf_starts + LEAF, n)
    leaf_mask, leaf_pattern = _shared(codes, leaf_starts, None)
    node_starts = np.arange(0, len(leaf_starts), FAN_OUT)
    node_ends = np.minimum(node_starts + FAN_OUT, len(leaf_starts))
    node_mask, node_pattern = _shared(leaf_pattern, node_starts, leaf_mask)
    pairs = np.stack(np.triu_indices(len(node_starts)))
    fixed = node_mask[pairs[0]] & node_mask[pairs[1]]
    gathered = np.bitwise_count((node_pattern[pairs[0]] ^ node_pattern[pairs[1]]) & fixed)
    pairs = pairs[:, gathered <= limit]
    for pair in pairs.T:
        below = _pairs_below(pair[:, None], node_starts, node_ends)
        a, b = below
        # Differences on the nodes' own bits are gathered already; a leaf adds what it fixes besides.
        top = node_mask[pair[0]] & node_mask[pair[1]]
        before = np.bitwise_count((node_pattern[pair[0]] ^ node_pattern[pair[1]]) & top)
        more = np.bitwise_count((leaf_pattern[a] ^ leaf_pattern[b]) & leaf_mask[a] & leaf_mask[b] & ~top)
        for x, y in below[:, before + more <= limit].T:
            left, right = codes[leaf_starts[x] : leaf_ends[x]], codes[leaf_starts[y] : leaf_ends[y]]
            i, j = np.nonzero(np.bitwise_count(left[:, None] ^ right[None, :]) <= limit)
            merged.link(i + leaf_starts[x], j + leaf_starts[y])
    return merged.label


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of all upper nodes of a partition, whose rows come sorted by node."""
    node = ["mask", "pattern"]
    for table in whole_groups(batches, node):
        bounds, every = group_bounds(table, node), table["code"].to_numpy().view(np.uint64)
        a, b = [np.empty(0, np.uint64)], [np.empty(0, np.uint64)]
        for k in np.flatnonzero(np.diff(bounds) > 1):
            codes = every[bounds[k] : bounds[k + 1]]
            codes = codes[np.argsort(gray_rank(codes), kind="stable")]
            label = link_node(codes)
            at = np.flatnonzero(label != np.arange(len(codes)))
            a.append(codes[at])
            b.append(codes[label[at]])
        ends = {n: pa.array(np.concatenate(x).view(np.int64)) for n, x in (("a", a), ("b", b))}
        yield pa.RecordBatch.from_pydict(ends)


def _under(codes: DataFrame, masks: list[int]) -> DataFrame:
    """A row of each code for each mask, with the pattern it has there."""
    nodes = F.array(*[F.lit(_signed(m)) for m in masks])
    return codes.select("code", F.explode(nodes).alias("mask")).withColumn("pattern", F.expr("code & mask"))


def links(codes: DataFrame) -> DataFrame:
    """Links (a, b) that connect all distinct ``code`` longs within ``LIMIT`` bits."""
    waiting, level, found = codes, [0], None
    while level:
        masks = sorted({m for mask in level for m in split_mask(mask)})
        if level == [0]:
            nodes = _under(waiting, masks)
        else:
            parts = [
                _under(waiting.where(F.col("mask") == _signed(mask)).select("code"), split_mask(mask)) for mask in level
            ]
            nodes = parts[0]
            for part in parts[1:]:
                nodes = nodes.unionAll(part)
            # A code can reach a node by two ways.
            nodes = nodes.distinct()
        nodes = stage(nodes, "index-nodes")
        large = nodes.groupBy("mask", "pattern").agg(F.count("*").alias("n")).where(F.col("n") > NODE_SIZE)
        large = stage(large, "index-large")
        masks_left = [m for m in masks if m != ALL_BITS]
        level = [r.mask & ALL_BITS for r in large.select("mask").distinct().collect() if r.mask & ALL_BITS in masks_left]
        if level:
            waiting = nodes.join(large, ["mask", "pattern"], "left_semi")
            nodes = nodes.join(large, ["mask", "pattern"], "left_anti")
        placed = nodes.repartition("mask", "pattern").sortWithinPartitions("mask", "pattern")
        part = placed.select("mask", "pattern", "code").mapInArrow(_links, "a long, b long")
        found = part if found is None else found.unionAll(part)
    return found.distinct()


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, code, component, component_id) for each row, with the columns in ``keep``.

    ``code`` is the fingerprint, ``component`` the smallest one reachable over links, and
    ``component_id`` the smallest doc_id that has any of these.
    """
    rows = stage(docs.select(F.col(doc_id).alias("doc_id"), fingerprints(text).alias("code"), *keep), "fingerprints")
    distinct = stage(rows.groupBy("code").agg(F.min("doc_id").alias("first")), "codes")
    grouped = components(links(distinct.select("code")))
    named = distinct.join(grouped, distinct["code"] == grouped["node"], "left").select(
        "code", "first", F.coalesce("component", "code").alias("component")
    )
    least = named.groupBy("component").agg(F.min("first").alias("component_id"))
    return rows.join(named.join(least, "component").drop("first"), "code").select(
        "doc_id", "code", "component", "component_id", *keep
    )


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each group: the smallest doc_id's, a null id last."""
    row = free_name(docs, "row")
    rows = stage(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    grouped = near_duplicates(rows, doc_id, text, keep=(row,))
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", row))
    chosen = grouped.groupBy("component").agg(first[row].alias(row))
    return rows.join(chosen.select(row), row, "left_semi").select(*docs.columns)
