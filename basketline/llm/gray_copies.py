"""Near-copies by five-word Jaccard similarity, with candidates from a Gray-order fingerprint index.

Every distinct set of shingles has a fingerprint of 64 bits. Sets with a similarity of 4/5 differ in
about eight bits, so parts of the bits on which they must agree, as ``gray_simhash`` uses for
two, don't exist. Upper nodes are therefore patterns under several masks of sampled bits. Masks are as
long as spreads the fingerprints over nodes of about ``NODE_ROWS``, and as many as let two fingerprints
that differ in ``REACH`` bits meet below one of them with a probability of ``RECALL``. Below a
node, fingerprints are sorted by Gray rank; leaves and inner nodes keep the bits that they share,
and pairs of groups that differ in more than ``LIMIT`` of these are pruned.

First rounds, over a few masks, give each fingerprint two candidates below each node: the one before it in
Gray order and the first of its group of close ones. Candidates count only if their texts have
a similarity of at least 4/5, by their shingles, not hashes. Each round goes on with the groups that
the rounds before have found, so a large group of near-copies grows together from few pairs. The last
pass, over all masks, takes all close pairs below a node that are in different groups. Nodes of
more than ``PART_ROWS`` are cut into parts: the first rounds look within each, the last pass at all
pairs of parts. So no task holds more than two parts, and no pair is left out.

Texts made from one template can have close fingerprints and still be unlike, each to each, so that
close pairs grow with the square of their number. The last pass therefore gives a pair only if one of
its ends is close to at most ``FEW`` others there. The rest, crowds, are searched again with
the parities of their sets: shingles are dealt to bits by hash, and a bit is one if it got an odd number. Two
sets differ in at least as many shingles as their parities do in bits, so pairs whose parities differ in more
than alike sets may are dropped before their texts are brought together, and no alike pair is. Of the
pairs left, a forest below each node is compared first, then all that are still in different groups.

Words are as in ``gray_simhash``. A text of up to five words is a single shingle; null texts and
texts without a word have the same empty set. Equal sets are one node, so copies and repeated
rows collapse before anything is compared. An empty table gives an empty table.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketline.llm.common import Merged, free_name, group_bounds, whole_groups
from basketline.llm.components import components
from basketline.llm.gray_simhash import FAN_OUT, LEAF, _pairs_below, _shared, _signed, gray_rank
from basketline.llm.shingle_dedup import SEED, _verified, shingles
from basketline.staging import stage

#: Differing bits up to which fingerprints are compared by their texts.
LIMIT = 14
#: Fingerprints that differ in so many bits meet with a probability of RECALL; closer ones more often.
REACH, RECALL = 11, 0.95
#: Fingerprints below a node on average, and at most in a part of one.
NODE_ROWS, PART_ROWS = 64, 4_096
#: Masks of each of the first rounds.
ROUNDS = (1, 4)
#: Others that one end of a pair is close to at most, or both ends are in a crowd.
FEW = 4
#: Bits of a parity for each shingle at least, and the least and most bits of a parity, as powers of two.
SPREAD, LEAST_PARITY, MOST_PARITY = 4, 6, 16
#: Bits of a mask at least.
LEAST_BITS = 6


def masks(n: int) -> list[int]:
    """Masks for ``n`` fingerprints."""
    bits = min(32, max(LEAST_BITS, math.ceil(math.log2(max(n, 1) / NODE_ROWS)) if n > NODE_ROWS else LEAST_BITS))
    meet = math.prod((64 - REACH - i) / (64 - i) for i in range(bits))
    rng = random.Random(SEED)
    count = math.ceil(math.log(1 - RECALL) / math.log(1 - meet))
    return [sum(1 << b for b in rng.sample(range(64), bits)) for _ in range(count)]


def _key_and_code(text: str) -> Column:
    """For each text a key of its set of shingles and the set's fingerprint, the majority of hash bits."""

    @F.pandas_udf("key string, code long, n long")
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text in batch:
                own = shingles(text)
                codes = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in own), dtype=np.uint64, count=len(own))
                codes.sort()
                ones = np.zeros(64, dtype=np.int64)
                for at in range(0, len(codes), 1 << 16):
                    part = codes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8)
                    ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
                code = np.packbits(ones * 2 > len(codes), bitorder="little").view(np.int64)[0]
                rows.append((xxhash.xxh3_128_hexdigest(codes.tobytes()), int(code), len(codes)))
            yield pd.DataFrame(rows, columns=["key", "code", "n"])

    return found(F.col(text))


def parity(text: str | None) -> bytes:
    """For each bit whether an odd number of shingles fell on it, by their hashes' last bits."""
    own = shingles(text)
    power = min(MOST_PARITY, max(LEAST_PARITY, (SPREAD * len(own) - 1).bit_length()))
    codes = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in own), dtype=np.uint64, count=len(own))
    places = (codes & np.uint64((1 << power) - 1)).astype(np.int64)
    return np.packbits(np.bincount(places, minlength=1 << power) & 1, bitorder="little").tobytes()


def _parities(text: str) -> Column:
    @F.pandas_udf("binary")
    def found(texts: pd.Series) -> pd.Series:
        return pd.Series([parity(t) for t in texts], dtype=object)

    return found(F.col(text))


class Parities:
    """The parities of sets of ``n`` shingles, to tell pairs that can't be alike."""

    def __init__(self, parities: list[bytes], n: np.ndarray):
        rows = [np.frombuffer(p, dtype=np.uint64) for p in parities]
        self.n, self.words, self.folded = n, np.array([len(r) for r in rows]), {}
        for words in np.unique(self.words).tolist():
            at = np.flatnonzero(self.words >= words)
            place = np.zeros(len(rows), dtype=np.int64)
            place[at] = np.arange(len(at))
            # The last bits of a hash are also those of a shorter parity: longer ones are folded.
            folded = [np.bitwise_xor.reduce(rows[k].reshape(-1, words), axis=0) for k in at]
            self.folded[words] = place, np.stack(folded)

    def possible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """False for pairs of positions whose sets differ in more than a ninth of their sizes' sum."""
        words, apart = np.minimum(self.words[a], self.words[b]), np.zeros(len(a), dtype=np.int64)
        for size in np.unique(words).tolist():
            at, (place, folded) = np.flatnonzero(words == size), self.folded[size]
            both = folded[place[a[at]]] ^ folded[place[b[at]]]
            apart[at] = np.bitwise_count(both).sum(axis=1, dtype=np.int64)
        # Alike sets share at least 4/9 of their sizes' sum.
        return 9 * apart <= self.n[a] + self.n[b]


def close_pairs(codes: np.ndarray, limit: int = LIMIT) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of all pairs of codes, given in Gray order, that differ in at most ``limit`` bits."""
    n = len(codes)
    leaf_starts = np.arange(0, n, LEAF)
    leaf_ends = np.minimum(leaf_starts + LEAF, n)
    leaf_mask, leaf_pattern = _shared(codes, leaf_starts, None)
    starts = np.arange(0, len(leaf_starts), FAN_OUT)
    ends = np.minimum(starts + FAN_OUT, len(leaf_starts))
    node_mask, node_pattern = _shared(leaf_pattern, starts, leaf_mask)
    pairs = np.stack(np.triu_indices(len(starts)))
    fixed = node_mask[pairs[0]] & node_mask[pairs[1]]
    gathered = np.bitwise_count((node_pattern[pairs[0]] ^ node_pattern[pairs[1]]) & fixed)
    for pair, top in zip(pairs[:, gathered <= limit].T, fixed[gathered <= limit], strict=True):
        below = _pairs_below(pair[:, None], starts, ends)
        a, b = below
        before = np.bitwise_count((node_pattern[pair[0]] ^ node_pattern[pair[1]]) & top)
        more = np.bitwise_count((leaf_pattern[a] ^ leaf_pattern[b]) & leaf_mask[a] & leaf_mask[b] & ~top)
        for x, y in below[:, before + more <= limit].T:
            left, right = codes[leaf_starts[x] : leaf_ends[x]], codes[leaf_starts[y] : leaf_ends[y]]
            i, j = np.nonzero(np.bitwise_count(left[:, None] ^ right[None, :]) <= limit)
            i, j = i + leaf_starts[x], j + leaf_starts[y]
            yield i[i < j], j[i < j]


def _linked(codes: np.ndarray) -> list[np.ndarray]:
    """Of each code's close ones the one before it in Gray order, and their first."""
    merged = Merged(len(codes))
    for a, b in close_pairs(codes):
        merged.link(a, b)
    lined = np.argsort(merged.label, kind="stable")
    same = merged.label[lined[1:]] == merged.label[lined[:-1]]
    rest = np.flatnonzero(merged.label != np.arange(len(codes)))
    return [np.stack([lined[:-1][same], lined[1:][same]]), np.stack([merged.label[rest], rest])]


def _forest(pairs: Iterator[tuple[np.ndarray, np.ndarray]], group: np.ndarray) -> Iterator[np.ndarray]:
    """Of pairs of positions those that a forest over the groups needs."""
    _, first, at = np.unique(group, return_index=True, return_inverse=True)
    merged = Merged(len(group))
    merged.label = first[at]
    for a, b in pairs:
        while (apart := merged.label[a] != merged.label[b]).any():
            a, b = a[apart], b[apart]
            # One pair for each label, which leads to a smaller one, so there is no circle.
            _, one = np.unique(np.maximum(merged.label[a], merged.label[b]), return_index=True)
            yield np.stack([a[one], b[one]])
            merged.link(a[one], b[one])


def _few(pairs: Iterator[tuple[np.ndarray, np.ndarray]], n: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs with an end that is in at most ``FEW``, and the positions that are in more."""
    near, held = np.zeros(n, dtype=np.int64), [np.zeros((2, 0), dtype=np.int64)]
    for a, b in pairs:
        np.add.at(near, a, 1)
        np.add.at(near, b, 1)
        # Counts only rise: what is in more by now stays so.
        few = np.minimum(near[a], near[b]) <= FEW
        held.append(np.stack([a[few], b[few]]))
    a, b = np.concatenate(held, axis=1)
    few = np.minimum(near[a], near[b]) <= FEW
    return np.stack([a[few], b[few]]), np.flatnonzero(near > FEW)


#: Ways to search: first rounds; pairs with few others, and crowds; of a crowd a forest, and all pairs.
LINKED, FEWER, FOREST, CROWD = range(4)


def _searched(way: int):
    """Candidate pairs of nodes of a partition, whose rows come sorted by index node."""
    keys = ["mask", "pattern", "part", "other"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, keys):
            bounds, out = group_bounds(table, keys), []
            columns = {n: table[n].to_numpy() for n in ("mask", "code", "node", "group", "n")}
            for k in np.flatnonzero(np.diff(bounds) > 1):
                part = {n: c[bounds[k] : bounds[k + 1]] for n, c in columns.items()}
                codes = part["code"].view(np.uint64)
                order = np.argsort(gray_rank(codes), kind="stable")
                codes, node, group, n = codes[order], part["node"][order], part["group"][order], part["n"][order]
                parities = None
                if way in (FOREST, CROWD):
                    given = table["parity"].slice(bounds[k], len(codes)).to_pylist()
                    parities = Parities([given[i] for i in order], n)

                def open_pairs():
                    for a, b in _linked(codes) if way == LINKED else close_pairs(codes):
                        # Too different in size to be alike.
                        fits = (group[a] != group[b]) & (5 * np.minimum(n[a], n[b]) >= 4 * np.maximum(n[a], n[b]))
                        a, b = a[fits], b[fits]
                        yield np.stack([a, b])[:, parities.possible(a, b) if parities else slice(None)]

                if way == FEWER:
                    pairs, crowd = _few(open_pairs(), len(codes))
                    out.append(np.stack([node[crowd], node[crowd], part["mask"][crowd]]))
                else:
                    found = _forest(open_pairs(), group) if way == FOREST else open_pairs()
                    pairs = np.concatenate([np.zeros((2, 0), dtype=np.int64), *found], axis=1)
                out.append(np.concatenate([node[pairs], np.zeros((1, pairs.shape[1]), dtype=np.int64)]))
            rows = np.concatenate([np.zeros((3, 0), dtype=np.int64), *out], axis=1)
            ends = {"a": rows[:2].min(axis=0), "b": rows[:2].max(axis=0)}
            yield pa.RecordBatch.from_pydict(ends | {"mask": rows[2]})

    return run


def _candidates(nodes: DataFrame, way: int) -> DataFrame:
    """Pairs (a, b) below the index nodes of (mask, code, node, group, n), for a crowd also parity.

    ``mask`` is 0 for a pair. Otherwise a and b are one node, in a crowd under that mask.
    """
    under = nodes.withColumn("pattern", F.expr("code & mask"))
    large = under.groupBy("mask", "pattern").agg(F.count("*").alias("rows")).where(F.col("rows") > PART_ROWS)
    parts = F.coalesce(F.expr(f"rows div {PART_ROWS} + 1"), F.lit(1))
    told = under.join(stage(large, "large-index-nodes"), ["mask", "pattern"], "left").withColumn("parts", parts)
    told = told.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")))
    if way in (FEWER, CROWD):
        # Parts meet in pairs; a part alone meets itself.
        others = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("to")
        told = told.select(*under.columns, "part", others)
        told = told.withColumns({"part": F.least("part", "to"), "other": F.greatest("part", "to")})
    else:
        told = told.withColumn("other", F.col("part"))
    keys = ["mask", "pattern", "part", "other"]
    placed = told.select(*under.columns, "part", "other").repartition(*keys).sortWithinPartitions(*keys)
    return stage(placed.mapInArrow(_searched(way), "a long, b long, mask long").distinct(), "candidates")


def _grouped(nodes: DataFrame, found: DataFrame) -> DataFrame:
    """The nodes, each with its group by the links found."""
    named = components(found).select("node", F.col("component").alias("group"))
    joined = nodes.join(named, "node", "left").withColumn("group", F.coalesce("group", "node"))
    return stage(joined, "grouped")


def links(nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (a, b) of alike nodes that connect the groups of (node, code, n)."""
    every_mask = masks(nodes.count())
    grouped, found, at = nodes.withColumn("group", F.col("node")), None, 0
    for n in (*ROUNDS, None):
        chosen = every_mask[at : at + n] if n else every_mask
        under = grouped.select("*", F.explode(F.array(*[F.lit(_signed(m)) for m in chosen])).alias("mask"))
        told = _candidates(under, LINKED if n else FEWER)
        more = _verified(told.where("a != b").select("a", "b"), texts)
        found = more if found is None else found.unionAll(more)
        if n:
            at += n
            grouped = _grouped(nodes, found)
    crowd = told.where("a = b").groupBy(F.col("a").alias("node")).agg(F.collect_list("mask").alias("masks"))
    crowd = stage(crowd, "crowd")
    if crowd.isEmpty():
        return found
    own = texts.join(crowd, "node").select("node", "masks", _parities("text").alias("parity"))
    crowd = stage(own, "parities")
    for way in (FOREST, CROWD):
        under = crowd.join(_grouped(nodes, found), "node").withColumn("mask", F.explode("masks")).drop("masks")
        told = _candidates(under, way)
        found = found.unionAll(_verified(told.select("a", "b"), texts))
    return found


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each group: the smallest doc_id's, a null id last."""
    row = free_name(docs, "row")
    rows = stage(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    given = rows.select(F.col(row).alias("row"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    sets = stage(given.select("row", "doc_id", _key_and_code("text").alias("set")).select("row", "doc_id", "set.*"), "sets")
    nodes = stage(sets.groupBy("key").agg(F.min("row").alias("node"), F.first("code").alias("code"), F.first("n").alias("n")), "nodes")
    # Sets below four shingles are alike only if they are equal.
    searched = nodes.where("n >= 4").select("node", "code", "n")
    grouped = components(links(searched, given.withColumnRenamed("row", "node")))
    named = nodes.join(grouped, "node", "left").select("key", F.coalesce("component", "node").alias("component"))
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row"))
    chosen = sets.select("row", "doc_id", "key").join(named, "key").groupBy("component").agg(first["row"].alias(row))
    return rows.join(chosen.select(row), row, "left_semi").select(*docs.columns)
