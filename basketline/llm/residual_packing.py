"""Packing documents into sequences: best fit in each partition, then up a tree of merges.

A task turns the texts of its partition into token ids, cuts documents longer than a
sequence, and packs the pieces by best fit, longest first. Bins that are nearly full leave
as sequences. The others go up a tree as items: each round, a task takes the bins of
``FAN_IN`` tasks and packs them by best fit again, bins staying whole. After best fit, no
two bins of a task fit together, so at most one is half full or less; only such bins can
still fill others. A task therefore passes on its ``CARRY`` emptiest bins and emits the
rest as they are: nothing is dropped, and no task ever holds more than
``FAN_IN * CARRY`` bins, or ``BLOCK`` pieces in the first round.

Null and empty texts have the end token alone. Equal rows are separate documents, pieces of
equal length take their order in the partition. An empty table gives an empty table.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketline.llm.worker import kept, piece_encoder, splits_plainly, tokenizer
from basketline.staging import stage

#: Pieces that a task packs at a time; what is left of a block joins the next one.
BLOCK = 200_000
#: Free places up to which a bin counts as nearly full.
SLACK = 16
#: Bins that a task passes on at most, and tasks whose bins meet in one.
CARRY = 512
FAN_IN = 16
#: Words that a worker keeps the ids of, and characters of such a word.
CACHE_SIZE = 800_000
CACHED_CHARS = 40
#: The tokenizer's splitting pattern, for lower-case texts that split plainly.
PRE_TOKEN = re.compile(r"'(?:[stmd]|re|ve|ll)|[^\W\d_]+|\d|(?:[^\s\w]|_)+")

#: A piece is (doc, piece, start, length, crc); ``at`` is its place in its bin.
PIECE = pa.struct([(n, pa.int64()) for n in ("doc", "piece", "start", "length", "crc", "at")])
BIN = pa.schema([("bin", pa.int64()), ("fill", pa.int64()), ("done", pa.bool_()), ("items", pa.list_(PIECE))])
BIN_TYPE = (
    "bin long, fill long, done boolean, items array<struct<"
    "doc: long, piece: long, start: long, length: long, crc: long, at: long>>"
)

Piece = tuple
#: What a bin holds: its fill, and its pieces in order.
Bin = tuple[int, list]


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins of positions in ``sizes``, by best fit, largest first, ties in order.

    Bins stand in stacks by their free places; an integer has a bit for each stack with
    bins, so the fullest bin that still has room is the lowest bit from the size up.
    """
    bins: list[list[int]] = []
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_bits = 0
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        size = sizes[i]
        fitting = open_bits >> size
        if fitting:
            free = size + (fitting & -fitting).bit_length() - 1
            at = stacks[free].pop()
            if not stacks[free]:
                open_bits ^= 1 << free
            bins[at].append(i)
            left = free - size
        else:
            at, left = len(bins), capacity - size
            bins.append([i])
        stacks[left].append(at)
        if left:
            open_bits |= 1 << left
    return bins


class _Ids:
    """Token ids of texts as bytes, four to an id, with a cache of words.

    Words between white space are split by ``PRE_TOKEN`` and never merge with each other.
    Texts that don't split plainly (see ``worker``) go through the library whole.
    """

    def __init__(self, path: str):
        self.library = tokenizer(path)
        self.piece = piece_encoder(path)
        self.words: dict[str, bytes] = kept(f"word ids {path}", dict)

    def learn(self, word: str) -> bytes:
        ids = [i for piece in PRE_TOKEN.findall(word) for i in self.piece(piece)]
        data = np.array(ids, dtype="<u4").tobytes()
        if len(word) <= CACHED_CHARS:
            if len(self.words) >= CACHE_SIZE:
                self.words.clear()
            self.words[word] = data
        return data

    def of(self, texts: list[str | None]) -> Iterator[bytes]:
        get, learn = self.words.get, self.learn
        for text in texts:
            if not text:
                yield b""
            elif splits_plainly(text):
                yield b"".join([get(word) or learn(word) for word in text.lower().split()])
            else:
                done = self.library.encode_batch_fast([text], add_special_tokens=False)
                yield np.array(done[0].ids, dtype="<u4").tobytes()


def _pack(items: list[Bin], capacity: int) -> list[Bin]:
    """Pack items; the pieces of an item stay together."""
    packed = best_fit([fill for fill, _ in items], capacity)
    return [(sum(items[i][0] for i in b), [p for i in b for p in items[i][1]]) for b in packed]


def _split(bins: list[Bin], capacity: int) -> tuple[list[Bin], list[Bin]]:
    """Bins that are done, and the ``CARRY`` emptiest of those that are not nearly full."""
    bins = sorted(bins, key=lambda b: b[0])
    carried = [b for b in bins[:CARRY] if b[0] < capacity - SLACK]
    return bins[len(carried) :], carried


def _rows(bins: list[Bin], done: bool, first: int) -> pa.RecordBatch:
    flat = [piece for _, pieces in bins for piece in pieces]
    counts = [len(pieces) for _, pieces in bins]
    lengths = np.array([piece[3] for piece in flat], dtype="int64")
    ends = np.cumsum([0, *counts])
    begun = np.concatenate([[0], np.cumsum(lengths)])
    at = begun[:-1] - np.repeat(begun[ends[:-1]], counts)
    fields = [pa.array([piece[k] for piece in flat], pa.int64()) for k in range(5)]
    items = pa.StructArray.from_arrays([*fields, pa.array(at, pa.int64())], fields=list(PIECE))
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.arange(first, first + len(bins)), pa.int64()),
            pa.array([fill for fill, _ in bins], pa.int64()),
            pa.array([done] * len(bins), pa.bool_()),
            pa.ListArray.from_arrays(pa.array(ends, pa.int32()), items),
        ],
        schema=BIN,
    )


def _first_round(path: str, end: int, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = _Ids(path)
        tail = np.array([end], dtype="<u4").tobytes()
        step, number = 4 * capacity, TaskContext.get().partitionId() << 32
        waiting: list[Bin] = []
        for batch in batches:
            done: list[Bin] = []
            for doc, data in zip(batch["doc"].to_pylist(), ids.of(batch["text"].to_pylist()), strict=True):
                data += tail
                for k, at in enumerate(range(0, len(data), step)):
                    part = data[at : at + step]
                    piece = (doc, k, at // 4, len(part) // 4, zlib.crc32(part))
                    (done if len(part) == step else waiting).append((len(part) // 4, [piece]))
            if len(waiting) >= BLOCK:
                full, waiting = _split(_pack(waiting, capacity), capacity)
                done += full
            if done:
                yield _rows(done, True, number)
                number += len(done)
        done, carried = _split(_pack(waiting, capacity), capacity)
        yield _rows(done, True, number)
        yield _rows(carried, False, number + len(done))

    return run


def _merge_round(round_: int, capacity: int, last: bool):
    def run(key: tuple, bins: pa.Table) -> pa.Table:
        number = round_ << 56 | key[0].as_py() << 32
        items = [
            (row["fill"], [tuple(p.values())[:5] for p in row["items"]])
            for row in bins.sort_by("bin").select(["fill", "items"]).to_pylist()
        ]
        packed = _pack(items, capacity)
        done, carried = (packed, []) if last else _split(packed, capacity)
        return pa.Table.from_batches([_rows(done, True, number), _rows(carried, False, number + len(done))])

    return run


def pack(
    docs: DataFrame,
    tokenizer_file: str,
    end_id: int,
    capacity: int = 4096,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Pieces of all documents with their sequences.

    Gives doc_id, piece, start, length, ids_crc32, sequence_id and offset.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc"), F.col(text).alias("text"))
    packed = stage(rows.mapInArrow(_first_round(tokenizer_file, end_id, capacity), BIN_TYPE), "packed")
    finished = packed.where("done")
    carried = packed.where("NOT done")
    # The number of a bin has its task's number in its middle bits.
    task = F.expr(f"shiftright(bin & {(1 << 56) - 1}, 32)")
    tasks = (carried.agg(F.max(task)).first()[0] or 0) + 1
    round_, last = 0, False
    while not last:
        round_, tasks = round_ + 1, -(-tasks // FAN_IN)
        last = tasks == 1
        merged = (
            carried.withColumn("to", F.floor(task / FAN_IN))
            .groupBy("to")
            .applyInArrow(_merge_round(round_, capacity, last), BIN_TYPE)
        )
        packed = stage(merged, "packed")
        finished = finished.unionAll(packed.where("done"))
        carried = packed.where("NOT done")
    pieces = finished.select(F.col("bin").alias("sequence_id"), F.explode("items").alias("p"))
    return pieces.select(
        F.col("p.doc").alias("doc_id"),
        F.col("p.piece").cast("int").alias("piece"),
        F.col("p.start").alias("start"),
        F.col("p.length").alias("length"),
        F.col("p.crc").alias("ids_crc32"),
        "sequence_id",
        F.col("p.at").alias("offset"),
    )
