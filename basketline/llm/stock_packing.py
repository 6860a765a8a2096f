"""Packing documents into sequences by cutting-stock patterns, with what is left open filled up.

Documents longer than a sequence give whole sequences and a rest. The rests, and all other
documents, are a histogram over length classes (see ``stock_patterns``); its size depends on
the sequence length only, so one process solves the linear program for any number of
documents. Documents of a class are ranked: a count per task, added up over tasks, then one
within the task. The rounded patterns hand out ranks: pattern p, used x times with k documents
of a class, takes the next k * x ranks of that class. So each document finds its sequence from its class
and rank alone. Its place there is a running sum of lengths in the sequence.

A class is as long as its longest document, so sequences stay a little open. Enough documents,
chosen by a hash of id and text, are therefore left out of the patterns. Their tokens form one
line, the open places another; where the two overlap, a piece goes to that place. The line's rest
fills more sequences, the last of them cut into powers of two. Every sequence is then full or
a power of two, and only documents of the line are cut, beside those longer than a sequence.

Null and empty texts have the end token alone. Equal rows are separate documents. Ranks follow the
order of rows in a stored table. An empty table gives an empty table. Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketline.llm import stock_patterns
from basketline.llm.residual_packing import _Ids as TokenIds
from basketline.staging import stage

#: Length classes are up to 1 / RESOLUTION of their length wide.
RESOLUTION = 32
#: Parts that documents are divided into by hash; whole parts are left out of the patterns.
PARTS = 256
#: Sequences whose open places are added up together.
GAP_BLOCK = 4_096

_ITEM = "doc long, start long, length long, crc long, doc_tokens long, part int, class int"
_RANKED = f"{_ITEM}, task long, rank long"
_LINE = "doc long, start long, length long, doc_tokens long, ids binary, task long, before long"


def part_of(doc_id: str, text: str) -> Column:
    return F.pmod(F.xxhash64(doc_id, F.coalesce(F.col(text), F.lit(""))), F.lit(PARTS)).cast("int")


def _pieces(path: str, end: int, capacity: int, batch: pa.RecordBatch) -> Iterator[tuple[int, int, int, bytes]]:
    """(row, start, tokens of the document, ids) of each piece of at most ``capacity`` ids."""
    ids, tail = TokenIds(path), np.array([end], dtype="<u4").tobytes()
    for row, data in enumerate(ids.of(batch["text"].to_pylist())):
        data += tail
        for at in range(0, len(data), 4 * capacity):
            yield row, at // 4, len(data) // 4, data[at : at + 4 * capacity]


def _items(path: str, end: int, capacity: int, sizes: np.ndarray):
    """Pieces with their class; whole sequences have the class behind the last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [
                (row, start, len(data) // 4, zlib.crc32(data), tokens)
                for row, start, tokens, data in _pieces(path, end, capacity, batch)
            ]
            rows, starts, lengths, crcs, tokens = (np.array(x, dtype=np.int64) for x in zip(*found, strict=True))
            classes = np.where(lengths == capacity, len(sizes), np.searchsorted(sizes, lengths))
            yield pa.RecordBatch.from_arrays(
                [
                    batch["doc"].take(pa.array(rows)),
                    *map(pa.array, (starts, lengths, crcs, tokens)),
                    batch["part"].take(pa.array(rows)),
                    pa.array(classes.astype(np.int32)),
                ],
                names=["doc", "start", "length", "crc", "doc_tokens", "part", "class"],
            )

    return run


def _with_local_rank(n_classes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, task = np.zeros(n_classes, dtype=np.int64), TaskContext.get().partitionId()
        for batch in batches:
            classes = batch["class"].to_numpy()
            order = np.argsort(classes, kind="stable")
            counts = np.bincount(classes, minlength=n_classes)
            rank = np.empty(len(classes), dtype=np.int64)
            firsts = np.cumsum(counts) - counts
            rank[order] = np.arange(len(classes)) - firsts[classes[order]] + seen[classes[order]]
            seen += counts
            columns = [*batch.columns, pa.array(np.full(len(classes), task)), pa.array(rank)]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "task", "rank"])

    return run


@dataclass(frozen=True)
class Plan:
    """Which sequence each rank of each class goes to.

    Entry e hands out the ranks from ``edges[e]`` on, counted through all classes: ``times[e]``
    to each of its places from ``slots[e]`` on, in the sequences from ``sequences[e]`` on.
    """

    parts: int
    n_sequences: int
    edges: np.ndarray
    times: np.ndarray
    sequences: np.ndarray
    slots: np.ndarray
    class_starts: np.ndarray

    def place(self, classes: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = self.class_starts[classes] + ranks
        e = np.searchsorted(self.edges, at, "right") - 1
        copy, instance = np.divmod(at - self.edges[e], self.times[e])
        return self.sequences[e] + instance, self.slots[e] + copy


def _planned(patterns: list[tuple[int, np.ndarray]], counts: np.ndarray, parts: int) -> Plan:
    entries, sequence = [], 0
    for times, pattern in patterns:
        slot = 0
        for k in np.flatnonzero(pattern)[::-1].tolist():
            entries.append((k, times, sequence, slot, times * int(pattern[k])))
            slot += int(pattern[k])
        sequence += times
    entries.sort(key=lambda e: e[0])
    table = np.array(entries, dtype=np.int64).reshape(-1, 5)
    edges = np.cumsum(table[:, 4]) - table[:, 4]
    return Plan(parts, sequence, edges, table[:, 1], table[:, 2], table[:, 3], np.cumsum(counts) - counts)


def plan(sizes: np.ndarray, capacity: int, counts: np.ndarray, tokens: np.ndarray) -> Plan:
    """Patterns for the documents from some part on; those before are enough to fill them.

    ``counts`` has the documents of each part and class, ``tokens`` the tokens of each part. The last
    class holds whole sequences.
    """
    every, total = counts.sum(axis=0), int(tokens.sum())
    used = np.flatnonzero(every[:-1])
    columns = inverse = np.zeros((0, 0))
    wanted = 0
    if len(used):
        columns, inverse, _ = stock_patterns.solve(sizes[used], every[used], capacity)
        open_ = capacity * np.einsum("ij,j->", inverse, every[used].astype(float)) - (total - capacity * int(every[-1]))
        wanted = open_ / (total + open_) * total
    behind = np.cumsum(tokens)
    parts = int(np.searchsorted(behind, wanted, "left")) + 1 if len(used) else 0
    while True:
        parts = min(parts, PARTS)
        left = counts[parts:].sum(axis=0)
        patterns = stock_patterns.rounded(columns, inverse, sizes[used], left[used], capacity) if left[:-1].any() else []
        whole = [(times, np.bincount(used, pattern, len(every)).astype(np.int64)) for times, pattern in patterns]
        if left[-1]:
            whole.append((int(left[-1]), np.eye(len(every), dtype=np.int64)[-1]))
        made = _planned(whole, left, parts)
        line = int(tokens[:parts].sum())
        if parts == PARTS or line >= capacity * made.n_sequences - (total - line):
            return made
        parts += 1


def _placed(ranked: DataFrame, plan_: Plan, n_classes: int) -> DataFrame:
    """Every document of the patterns with its sequence and its slot there."""
    counts = ranked.groupBy("class", "task").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("class").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    firsts = stage(counts.select("class", "task", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first")), "first-ranks")

    @F.arrow_udf("sequence long, slot long")
    def place(classes: pa.Array, ranks: pa.Array) -> pa.Array:
        found = plan_.place(classes.to_numpy(), ranks.to_numpy())
        return pa.StructArray.from_arrays(list(map(pa.array, found)), names=["sequence", "slot"])

    told = ranked.join(firsts, ["class", "task"]).withColumn("at", place("class", F.col("first") + F.col("rank")))
    return told.select("doc", "start", "length", "crc", "doc_tokens", "class", "at.sequence", "at.slot")


def _line_tokens(path: str, end: int, capacity: int):
    """Pieces of the line with their ids, and the tokens before them in their task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            docs, rows = batch["doc"].to_pylist(), []
            for row, start, tokens, data in _pieces(path, end, capacity, batch):
                rows.append((docs[row], start, len(data) // 4, tokens, data, task, before))
                before += len(data) // 4
            kinds = [pa.int64()] * 4 + [pa.binary()] + [pa.int64()] * 2
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc", "start", "length", "doc_tokens", "ids", "task", "before"])

    return run


def _on_line(pieces: DataFrame) -> DataFrame:
    """Pieces with their first token's place on the line."""
    sums = pieces.groupBy("task").agg(F.sum("length").alias("n"))
    # A row for each task of the line.
    earlier = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    firsts = sums.select("task", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first"))
    return pieces.join(firsts, "task").withColumn("at", F.col("first") + F.col("before")).drop("task", "first", "before")


def _open_places(placed: DataFrame, capacity: int) -> DataFrame:
    """(sequence, fill, room, at): open places of sequences one behind the other on the line.

    Rooms are added up in blocks of sequences, then over the blocks: a row for ``GAP_BLOCK``
    sequences reaches the one task that does the latter.
    """
    gaps = placed.where((F.col("slot") == 0) & (F.col("fill") < capacity)).select(
        "sequence", "fill", (capacity - F.col("fill")).alias("room"), F.expr(f"sequence div {GAP_BLOCK}").alias("block")
    )
    gaps = stage(gaps, "open-places")
    blocks = gaps.groupBy("block").agg(F.sum("room").alias("n"))
    earlier = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    firsts = blocks.select("block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first"))
    inside = Window.partitionBy("block").orderBy("sequence").rowsBetween(Window.unboundedPreceding, -1)
    local = gaps.withColumn("inside", F.coalesce(F.sum("room").over(inside), F.lit(0)))
    return local.join(firsts, "block").select("sequence", "fill", "room", (F.col("first") + F.col("inside")).alias("at"))


def _more_sequences(gaps: DataFrame, first: int, at: int, tokens: int, capacity: int) -> DataFrame:
    """The open places and those of new sequences for ``tokens`` more, from ``at`` on.

    The last tokens get a sequence for each power of two in their number.
    """
    spark = gaps.sparkSession
    n, rest = divmod(tokens, capacity)
    k = F.col("id")
    more = spark.range(n).select(
        (k + first).alias("sequence"), F.lit(0).cast("long").alias("fill"), F.lit(capacity).cast("long").alias("room"), (k * capacity + at).alias("at")
    )
    sizes = [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]
    starts = np.cumsum([at + n * capacity, *sizes]).tolist()
    last = [(first + n + i, 0, size, starts[i]) for i, size in enumerate(sizes)]
    return gaps.unionByName(more).unionByName(spark.createDataFrame(last, "sequence long, fill long, room long, at long"))


def _overlaps(line: DataFrame, gaps: DataFrame, capacity: int) -> DataFrame:
    """The parts of the line's pieces in the places that they overlap.

    Both are cut at multiples of ``capacity`` to meet; such a cell has at most ``capacity`` of either.
    """

    def in_cells(df: DataFrame, size: str) -> DataFrame:
        cells = F.sequence(F.expr(f"at div {capacity}"), F.expr(f"(at + {size} - 1) div {capacity}"))
        return df.select("*", F.explode(cells).alias("cell"))

    left, right = in_cells(line, "length").alias("l"), in_cells(gaps, "room").alias("g")
    begin = F.greatest("l.at", "g.at")
    end = F.least(F.col("l.at") + F.col("l.length"), F.col("g.at") + F.col("g.room"))
    # A pair that shares two cells counts in the one where the overlap begins.
    own = F.floor(begin / capacity) == F.col("l.cell")
    met = left.join(right, F.col("l.cell") == F.col("g.cell")).where((begin < end) & own)
    skipped, length = begin - F.col("l.at"), end - begin
    ids = F.expr("substring(l.ids, int(4 * skipped + 1), int(4 * length))")
    return (
        met.withColumns({"skipped": skipped, "length": length})
        .withColumn("crc", F.crc32(ids))
        .select(
            "l.doc", (F.col("l.start") + F.col("skipped")).alias("start"), F.col("length"), "crc", "l.doc_tokens",
            "g.sequence", (F.col("g.fill") + F.greatest("l.at", "g.at") - F.col("g.at")).alias("offset"),
        )
    )


def pack(
    docs: DataFrame,
    tokenizer_file: str,
    end_id: int,
    capacity: int = 4096,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Pieces of all documents with their sequences.

    Gives doc_id, start, length, ids_crc32, doc_tokens, sequence_id and offset.
    """
    sizes = stock_patterns.class_sizes(capacity, RESOLUTION)
    n_classes = len(sizes) + 1
    rows = docs.select(F.col(doc_id).cast("long").alias("doc"), F.col(text).alias("text"))
    rows = rows.withColumn("part", part_of("doc", "text"))
    items = stage(rows.mapInArrow(_items(tokenizer_file, end_id, capacity, sizes), _ITEM), "pieces")

    # At most PARTS rows for each class.
    histogram = items.groupBy("part", "class").agg(F.count("*").alias("n"), F.sum("length").alias("tokens")).collect()
    counts, tokens = np.zeros((PARTS, n_classes), dtype=np.int64), np.zeros(PARTS, dtype=np.int64)
    for r in histogram:
        counts[r["part"], r["class"]] = r["n"]
        tokens[r["part"]] += r["tokens"]
    made = plan(sizes, capacity, counts, tokens)

    in_patterns = items.where(F.col("part") >= made.parts)
    ranked = stage(in_patterns.mapInArrow(_with_local_rank(n_classes), _RANKED), "ranked")
    placed = _placed(ranked, made, n_classes)
    # Whole sequences need no place; the others meet by sequence, which holds at most ``capacity``.
    whole = placed.where(F.col("class") == len(sizes)).withColumn("offset", F.lit(0).cast("long"))
    mates = Window.partitionBy("sequence")
    earlier = mates.orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    shared = placed.where(F.col("class") < len(sizes)).withColumns(
        {"offset": F.coalesce(F.sum("length").over(earlier), F.lit(0)), "fill": F.sum("length").over(mates)}
    )
    shared = stage(shared, "placed")

    line = stage(rows.where(F.col("part") < made.parts).mapInArrow(_line_tokens(tokenizer_file, end_id, capacity), _LINE), "line")
    n_line = int(tokens[: made.parts].sum())
    n_open = capacity * made.n_sequences - int(tokens[made.parts :].sum())
    gaps = _more_sequences(_open_places(shared, capacity), made.n_sequences, n_open, n_line - n_open, capacity)
    filled = _overlaps(_on_line(line), gaps, capacity)

    columns = ["doc", "start", "length", "crc", "doc_tokens", "sequence", "offset"]
    every = shared.select(columns).unionByName(whole.select(columns)).unionByName(filled.select(columns))
    return every.select(
        F.col("doc").alias("doc_id"), "start", "length", F.col("crc").alias("ids_crc32"), "doc_tokens",
        F.col("sequence").alias("sequence_id"), "offset",
    )
