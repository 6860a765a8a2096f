"""Shards by a consistent-hash ring with virtual nodes and bounded loads.

Every shard has ``VIRTUAL_NODES`` places on a ring of ``CELLS`` cells, which they cut into
arcs. The hash of a row's id names a cell; the row goes to the shard whose place comes next
clockwise. A shard takes no more rows than its capacity; others continue clockwise, arc by
arc, to the next shard with room. Without slack the capacities are even and add up to the
number of rows, so counts are at most one apart, whatever the ids. With slack, a shard
that comes or goes moves fewer rows.

Only row counts decide who overflows, so the walk around the ring is done on one number per
arc; how many arcs there are is a parameter. Its outcome says which ranks of an arc go
to which shard, and each row looks up its arc and rank. An arc with many rows, be it for
one frequent id, is ranked in pieces of about ``PIECE`` rows, so no task gets a whole
large arc.

Null ids share one cell. Equal rows get different slots. A null text has no bytes. An empty
table gives an empty table. Row numbers are written before use: a lost task cannot
number rows anew.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from basketline.staging import stage

VIRTUAL_NODES = 64
CELLS = 1 << 14
#: Bytes that a row takes besides its text.
ROW_BYTES = 16
#: Rows of an arc that are ranked in one task, about.
PIECE = 250_000

SEGMENT = "array<struct<arc: int, low: bigint, high: bigint, shard: int, first: bigint>>"


def ring(shards: int, virtual_nodes: int = VIRTUAL_NODES) -> tuple[list[int], list[int]]:
    """The arc of each cell, and the shard of each arc, in ring order.

    A place depends on its shard and number alone, so a new shard only cuts arcs. Of two
    virtual nodes in one cell the lower shard has it.
    """
    places: dict[int, int] = {}
    for shard in range(shards):
        for node in range(virtual_nodes):
            digest = hashlib.md5(f"{shard}/{node}".encode()).digest()
            places.setdefault(int.from_bytes(digest[:8], "big") % CELLS, shard)
    cells = sorted(places)
    arcs, arc = [], 0
    for cell in range(CELLS):
        while arc < len(cells) and cells[arc] < cell:
            arc += 1
        # Behind the last place the ring begins again.
        arcs.append(arc % len(cells))
    return arcs, [places[c] for c in cells]


def capacities(rows: int, shards: int, slack: float) -> list[int]:
    """Even shares of the rows, and ``slack`` times as many on top."""
    even = [rows // shards + (s < rows % shards) for s in range(shards)]
    return [n + int(n * slack) for n in even]


def walk(rows: dict[int, int], owners: list[int], capacity: list[int]) -> list[dict]:
    """Which ranks of each arc go to which shard, and the slot of the first of them.

    In each round, all arcs that still have rows offer them, in ring order, to one shard:
    at first the arc's own, then that of the next arc clockwise, and so on.
    """
    room, begun = list(capacity), dict.fromkeys(rows, 0)
    used = [0] * len(capacity)
    waiting = sorted(arc for arc, n in rows.items() if n)
    out = []
    for step in range(len(owners)):
        for arc in waiting:
            shard = owners[(arc + step) % len(owners)]
            n = min(rows[arc] - begun[arc], room[shard])
            if n:
                low = begun[arc]
                out.append({"arc": arc, "low": low, "high": low + n, "shard": shard, "first": used[shard]})
                begun[arc] += n
                room[shard] -= n
                used[shard] += n
        waiting = [arc for arc in waiting if begun[arc] < rows[arc]]
        if not waiting:
            return out
    raise ValueError("the shards cannot take all rows")


def shard_rows(
    docs: DataFrame,
    shards: int = 40,
    slack: float = 0.0,
    virtual_nodes: int = VIRTUAL_NODES,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) for each row; slots of a shard have no gaps."""
    arcs, owners = ring(shards, virtual_nodes)
    content = F.coalesce(F.col(text), F.lit("")).cast("binary")
    cell = F.pmod(F.xxhash64(F.col(doc_id).cast("string")), F.lit(CELLS)).cast("int")
    rows = docs.select(
        F.col(doc_id).alias("doc_id"),
        (F.octet_length(content) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(content).alias("text_crc32"),
        F.get(F.from_json(F.lit(json.dumps(arcs)), "array<int>"), cell).alias("arc"),
        F.monotonically_increasing_id().alias("row"),
    )
    rows = stage(rows, "ring-rows")
    counted = {r.arc: r.n for r in rows.groupBy("arc").agg(F.count("*").alias("n")).collect()}
    segments = walk(counted, owners, capacities(sum(counted.values()), shards, slack))
    pieces = [-(-counted.get(arc, 0) // PIECE) for arc in range(len(owners))]

    piece = F.pmod("row", F.get(F.from_json(F.lit(json.dumps(pieces)), "array<int>"), F.col("arc")))
    rows = rows.withColumn("piece", piece)
    before = (
        rows.groupBy("arc", "piece")
        .agg(F.count("*").alias("n"))
        .withColumn("before", F.sum("n").over(W.partitionBy("arc").orderBy("piece")) - F.col("n"))
        .drop("n")
    )
    in_piece = F.row_number().over(W.partitionBy("arc", "piece").orderBy("row")) - 1
    ranked = rows.withColumn("in_piece", in_piece).join(before, ["arc", "piece"])
    ranked = ranked.withColumn("rank", F.col("before") + F.col("in_piece"))
    table = docs.sparkSession.range(1).select(F.inline(F.from_json(F.lit(json.dumps(segments)), SEGMENT)))
    # As many segments as arcs and overflows between them: a number of the parameters.
    placed = ranked.join(F.broadcast(table), "arc").where("rank >= low AND rank < high")
    return placed.select(
        "doc_id", "size", "text_crc32", "shard", (F.col("first") + F.col("rank") - F.col("low")).alias("slot")
    )
