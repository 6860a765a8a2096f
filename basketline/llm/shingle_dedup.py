"""Near-copies by the exact Jaccard similarity of their sets of five-word shingles.

Fingerprints of 64 bits cannot bound this similarity: texts at 0.8 differ in about ten bits and
some in many more, while an index for so many bits compares nearly everything. So candidates
come from the sets themselves. All shingles have one order, by hash. If two sets of n and m
shingles have a similarity of 4/5, they share at least 4n/5 and 4m/5 of them, hence one of the
first n - ceil(4n/5) + 1 and m - ceil(4m/5) + 1. Texts are put into a bucket for each of these,
and no pair is missed. A shingle that a sample finds in many texts goes to the end of the order;
which ones do changes how much is compared, not the result.

Texts with equal sets are one node. In rounds, nodes of a bucket are compared with one of them,
a different one in each bucket, which joins large groups of near-copies without comparing
them pair by pair. At last all pairs that share a bucket and are not yet in one group are
compared. Every comparison is of the texts' shingles, not of hashes. Groups are the connected
components of pairs with a similarity of at least 4/5.

Words are as in ``gray_simhash``. A text of up to five words is a single shingle; null texts and
texts without a word have the same empty set.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketline.llm.common import free_name
from basketline.llm.components import components
from basketline.staging import stage

SHINGLE = 5
SEED = 42
#: Least similarity, as a fraction.
SHARE, OF = 4, 5
#: A shingle is put last if one text in ``SAMPLED`` has it ``SEEN`` times; so many at most.
SAMPLED, SEEN, MOST_SEEN = 8, 4, 200_000
#: Rounds of comparing with one node of each bucket, while more pairs than ``PAIRS`` times the
#: buckets' rows are left and a round halves them. What is left is compared in full.
ROUNDS, PAIRS = 6, 1


def shingles(text: str | None) -> set[bytes]:
    words = text.encode("utf-8", "replace").lower().split() if text else []
    if len(words) <= SHINGLE:
        return {b" ".join(words)} if words else set()
    return set(map(b" ".join, zip(*(words[i:] for i in range(SHINGLE)), strict=False)))


def alike(a: set, b: set) -> bool:
    """Whether the Jaccard similarity is at least ``SHARE / OF``."""
    both = len(a & b)
    return OF * both >= SHARE * (len(a) + len(b) - both)


def hashes(text: str | None) -> np.ndarray:
    """The shingles' hashes in order."""
    found = shingles(text)
    codes = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in found), dtype=np.uint64, count=len(found))
    return np.unique(codes.view(np.int64))


def prefix(codes: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The first of ``codes`` that two alike sets must share one of; those in ``last``, which is sorted, come last.

    Sets below ``SHARE`` shingles are alike only if they are equal and have none.
    """
    n = len(codes)
    if n < SHARE:
        return codes[:0]
    late = np.searchsorted(last, codes, "right") > np.searchsorted(last, codes)
    return np.concatenate([codes[~late], codes[late]])[: n - -(-SHARE * n // OF) + 1]


def _common(docs: DataFrame, text: str) -> np.ndarray:
    """Hashes of shingles in many texts, from a sample of the texts."""

    @F.pandas_udf("array<long>")
    def every(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([hashes(t) for t in batch], dtype=object)

    sample = docs.where(F.pmod(F.xxhash64(text, F.lit(SEED)), F.lit(SAMPLED)) == 0)
    seen = sample.select(F.explode(every(text)).alias("shingle")).groupBy("shingle").agg(F.count("*").alias("n"))
    most = seen.where(F.col("n") >= SEEN).orderBy(F.desc("n"), "shingle").limit(MOST_SEEN)
    return np.sort(most.select("shingle").toPandas()["shingle"].to_numpy(dtype=np.int64))


def _sets(text: str, last: np.ndarray) -> Column:
    """For each text a key of its set, the set's size and its prefix."""

    @F.pandas_udf("key string, n long, prefix array<long>")
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            codes = [hashes(t) for t in batch]
            keys = [xxhash.xxh3_128_hexdigest(c.tobytes()) for c in codes]
            yield pd.DataFrame({"key": keys, "n": [len(c) for c in codes], "prefix": [prefix(c, last) for c in codes]})

    return found(F.col(text))


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes whose texts are alike."""

    @F.pandas_udf("boolean")
    def same(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series([alike(shingles(a), shingles(b)) for a, b in zip(left, right, strict=True)], dtype=bool)

    # Texts in no pair stay out of the shuffles.
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    texts = texts.join(stage(ends, "ends"), "node", "left_semi")
    for end in ("a", "b"):
        pairs = pairs.join(texts.select(F.col("node").alias(end), F.col("text").alias(f"text_{end}")), end)
    return stage(pairs.where(same("text_a", "text_b")).select("a", "b"), "near-copies")


def _possible(a: str, b: str) -> Column:
    """False if the sizes, or what follows this shingle in both sets, are too small for a pair.

    Of the shared shingles the first one passes, if the pair is alike.
    """
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    rest = F.least(n - F.col(f"{a}.at"), m - F.col(f"{b}.at"))
    sizes = (OF * n >= SHARE * m) & (OF * m >= SHARE * n)
    return sizes & (rest * (SHARE + OF) >= SHARE * (n + m))


def _pairs(a: str, b: str) -> list[Column]:
    x, y = F.col(f"{a}.node"), F.col(f"{b}.node")
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def _open(buckets: DataFrame, links: DataFrame | None) -> DataFrame:
    """Rows of buckets that hold more than one group, with their group."""
    if links is None:
        return buckets.withColumn("group", F.col("node"))
    named = components(links).select("node", F.col("component").alias("group"))
    rows = buckets.join(named, "node", "left").withColumn("group", F.coalesce("group", "node"))
    mixed = rows.groupBy("shingle").agg(F.min("group").alias("g"), F.max("group").alias("h")).where("g != h")
    return rows.join(mixed.select("shingle"), "shingle", "left_semi")


def _pairs_left(rows: DataFrame) -> tuple[int, int]:
    """Rows, and pairs of different groups in the same bucket."""
    groups = rows.groupBy("shingle", "group").agg(F.count("*").alias("k"))
    each = groups.groupBy("shingle").agg(F.sum("k").alias("k"), F.sum(F.expr("k * k")).alias("inside"))
    n, pairs = each.agg(F.sum("k"), F.sum(F.expr("(k * k - inside) div 2"))).first()
    return n or 0, pairs or 0


def links(sets: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (a, b) of alike nodes that connect all groups of (node, n, prefix)."""
    placed = sets.select("node", "n", F.posexplode("prefix").alias("at", "shingle"))
    shared = placed.groupBy("shingle").agg(F.count("*").alias("k")).where("k > 1")
    buckets = stage(placed.join(shared.select("shingle"), "shingle"), "buckets")
    found, before = None, None
    for seed in range(ROUNDS + 1):
        rows = stage(_open(buckets, found), "open-buckets")
        n, left = _pairs_left(rows)
        if seed == ROUNDS or left <= PAIRS * n or before is not None and 2 * left > before:
            break
        before = left
        order = F.xxhash64("shingle", "node", F.lit(seed))
        one = rows.groupBy("shingle").agg(F.min(F.struct(order, "node", "n", "at", "group")).alias("y"))
        one = one.select("shingle", "y.node", "y.n", "y.at", "y.group")
        met = rows.alias("x").join(one.alias("y"), "shingle").where("x.group != y.group").where(_possible("x", "y"))
        part = _verified(met.select(*_pairs("x", "y")).distinct(), texts)
        found = part if found is None else found.unionAll(part)
    apart = (F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.group") < F.col("y.group"))
    met = rows.alias("x").join(rows.alias("y"), apart & _possible("x", "y"))
    part = _verified(met.select(*_pairs("x", "y")).distinct(), texts)
    return part if found is None else found.unionAll(part)


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each group: the smallest doc_id's, a null id last."""
    row = free_name(docs, "row")
    rows = stage(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    given = rows.select(F.col(row).alias("row"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    last = _common(given, "text")
    sets = stage(given.select("row", "doc_id", _sets("text", last).alias("set")).select("row", "doc_id", "set.*"), "sets")
    nodes = stage(sets.groupBy("key").agg(F.min("row").alias("node")), "nodes")
    lead = sets.withColumnRenamed("row", "node").join(nodes.select("node"), "node", "left_semi")
    grouped = components(links(lead.select("node", "n", "prefix"), given.withColumnRenamed("row", "node")))
    named = nodes.join(grouped, "node", "left").select("key", F.coalesce("component", "node").alias("component"))
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row"))
    chosen = sets.select("row", "doc_id", "key").join(named, "key").groupBy("component").agg(first["row"].alias(row))
    return rows.join(chosen.select(row), row, "left_semi").select(*docs.columns)
