"""Mixing sources to target weights by temperature, as budgeted block permutations.

A source's share of all tokens, raised to an exponent from 0 (all sources alike) to 1 (as they
are) and normalised, is its weight. Bisection finds the largest exponent whose weights
have a target entropy, given as a part of the largest possible one. If a source would then
be repeated more often than allowed, bisection goes on towards 1 until none is.

Each source gets its weight of the token budget and spends it on passes over its documents.
A pass is a permutation of blocks: documents fall into blocks by a seeded hash, and each
pass takes the blocks, and the documents in them, in a seeded order of its own. Whole
passes take every document, the last one stops where the budget ends, past it by less than
a document. Which blocks it reaches follows from the blocks' token sums; only documents of
the one block in which a budget ends are put in order, and a block holds about
``BLOCK_ROWS`` of them however large its source is. Without a budget, the largest source gets
one whole pass and all others at least one: then no document is left out.

A null source is a source of its own. Null and empty texts count as one token, so that
every row can be drawn. Equal rows are separate documents. An empty table gives an empty
table. Sources stay a table: no step collects them.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from basketline.staging import stage

#: Rows per block, about.
BLOCK_ROWS = 500
SEED = 6
#: Bisections, and how many of them one pass over the sources' totals serves.
HALVINGS, PER_PASS = 24, 4


def word_count(text: str) -> Column:
    return F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(r"\S+"))


class Shares:
    """Entropy and repetition at any exponent, from a table of the sources' tokens."""

    def __init__(self, totals: DataFrame, budget: float | None):
        self.totals, self.budget = totals, budget
        self.sources, self.least, self.most = totals.agg(F.count("*"), F.min("tokens"), F.max("tokens")).first()

    def at(self, exponents: list[float]) -> list[tuple[float, float, float]]:
        """(normaliser, entropy, largest number of passes) at each exponent, in one job."""
        lean = F.log(F.col("tokens") / self.most)
        sums = [f(e) for e in exponents for f in (lambda e: F.sum(F.exp(lean * e)), lambda e: F.sum(F.exp(lean * e) * lean))]
        values = self.totals.agg(*[s.alias(f"s{i}") for i, s in enumerate(sums)]).first()
        out = []
        for k, exponent in enumerate(exponents):
            total, slope = values[2 * k], values[2 * k + 1]
            budget = self.tokens(exponent, total)
            smallest = math.exp(exponent * math.log(self.least / self.most)) / total
            out.append((total, math.log(total) - exponent * slope / total, smallest * budget / self.least))
        return out

    def tokens(self, exponent: float, normaliser: float) -> float:
        """The budget, or what gives the largest source one pass."""
        return self.budget if self.budget is not None else self.most * normaliser

    def bisect(self, low: float, high: float, holds: Callable[[float, float], bool]) -> float:
        """Where ``holds(entropy, passes)``, false at ``low``, becomes true up to ``high``."""
        for _ in range(HALVINGS // PER_PASS):
            parts = 1 << PER_PASS
            inner = [low + (high - low) * k / parts for k in range(1, parts)]
            true = [e for e, (_, h, p) in zip(inner, self.at(inner), strict=True) if holds(h, p)]
            width = (high - low) / parts
            high = min(true, default=high)
            low = high - width
        return high


def temperature(shares: Shares, target_entropy: float, max_repeats: float) -> float:
    """The exponent that meets the target entropy, and the repetition limit where that asks for more."""
    if shares.sources < 2:
        return 1.0
    wanted = target_entropy * math.log(shares.sources)
    (_, flat, _), (_, natural, _) = shares.at([0.0, 1.0])
    if wanted <= natural:
        exponent = 1.0
    elif wanted >= flat:
        exponent = 0.0
    else:
        exponent = shares.bisect(0.0, 1.0, lambda entropy, _: entropy <= wanted)
    ((_, _, passes),) = shares.at([exponent])
    if passes > max_repeats:
        exponent = shares.bisect(exponent, 1.0, lambda _, passes: passes <= max_repeats)
    return exponent


def _order(*parts) -> Column:
    return F.xxhash64(F.lit(SEED), *[F.lit(p) if isinstance(p, str) and p.startswith("to ") else F.col(p) for p in parts])


def _same_source(a: DataFrame, b: DataFrame) -> Column:
    return a["source"].eqNullSafe(b["its_source"])


def plan_sources(
    rows: DataFrame, target_entropy: float, max_repeats: float, budget: float | None
) -> tuple[DataFrame, float]:
    """(its_source, blocks, whole, rest) per source, and the exponent.

    ``whole`` is the number of whole passes, ``rest`` the tokens left for the last one.
    """
    totals = rows.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("rows"))
    totals = stage(totals, "mix-sources")
    shares = Shares(totals, budget)
    exponent, total = 1.0, 1.0
    if shares.sources:
        exponent = temperature(shares, target_entropy, max_repeats)
        ((normaliser, _, _),) = shares.at([exponent])
        total = shares.tokens(exponent, normaliser) / normaliser
    share = F.exp(F.log(F.col("tokens") / F.lit(shares.most)) * exponent)
    spent = F.round(share * total).cast("long")
    if budget is None:
        spent = F.greatest(spent, F.col("tokens"))
    planned = totals.withColumn("spent", spent).select(
        F.col("source").alias("its_source"),
        F.ceil(F.col("rows") / BLOCK_ROWS).alias("blocks"),
        F.expr("spent DIV tokens").alias("whole"),
        F.expr("spent % tokens").alias("rest"),
    )
    return planned, exponent


def draws(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Each stored row as often as it is drawn, with block, pass and draw.

    ``rows`` has source, n_tokens and a unique ``row``; other columns stay.
    """
    blocked = rows.join(sources, _same_source(rows, sources)).withColumn(
        "block", F.pmod(_order("to blocks", "row"), F.col("blocks"))
    )
    narrow = blocked.select("source", "block", "whole", "rest", "row", "n_tokens")
    reach = W.partitionBy("source").orderBy(_order("to order blocks", "whole", "block"), "block")
    blocks = (
        narrow.groupBy("source", "block", "whole", "rest")
        .agg(F.sum("n_tokens").alias("size"))
        .withColumn("after", F.sum("size").over(reach))
        .withColumn("room", F.col("rest") - (F.col("after") - F.col("size")))
        .where("room > 0")
        .select(F.col("source").alias("its_source"), F.col("block").alias("its_block"), "room", (F.col("room") >= F.col("size")).alias("all"))
    )
    blocks = stage(blocks, "mix-blocks")

    def to_blocks(left: DataFrame, right: DataFrame) -> Column:
        return _same_source(left, right) & (left["block"] == right["its_block"])

    # In the block where the budget ends, rows up to a place in its order are drawn.
    ending = blocks.where("NOT all").select("its_source", "its_block", "room")
    place = F.struct(_order("to order rows", "whole", "row").alias("key"), F.col("row").alias("row"))
    within = W.partitionBy("source").orderBy("place")
    last = (
        narrow.join(ending, to_blocks(narrow, ending))
        .withColumn("place", place)
        .withColumn("before", F.sum("n_tokens").over(within) - F.col("n_tokens"))
        .where("before < room")
        .groupBy("its_source", "its_block")
        .agg(F.max("place").alias("last"))
    )
    reached = blocks.select("its_source", "its_block", "all").join(
        last.select(F.col("its_source").alias("_s"), F.col("its_block").alias("_b"), "last"),
        F.col("its_source").eqNullSafe(F.col("_s")) & (F.col("its_block") == F.col("_b")),
        "left",
    )
    reached = stage(reached.select("its_source", "its_block", "all", "last"), "mix-reached")
    found = blocked.drop("its_source").join(reached, to_blocks(blocked, reached), "left")
    more = F.coalesce(F.col("all") | (place <= F.col("last")), F.lit(False)).cast("long")
    passes = F.when(F.col("whole") + more > 0, F.sequence(F.lit(0).cast("long"), F.col("whole") + more - 1))
    drawn = found.withColumn("pass", F.explode(passes)).withColumn("draw", _order("to shuffle", "row", "pass"))
    return drawn.select(*rows.columns, "block", "pass", "draw")


def mix(
    docs: DataFrame,
    target_entropy: float = 0.9,
    max_repeats: float = 4.0,
    budget: float | None = None,
    source: str = "source",
    text: str = "text",
    tokens: Column | None = None,
) -> DataFrame:
    """Each row of ``docs`` as often as it is drawn: (doc, source, n_tokens, block, pass, draw).

    ``doc`` is a struct of all its columns, ``draw`` a seeded number to order all draws by,
    ``tokens`` a column to count by instead of words.
    """
    count = (word_count(text) if tokens is None else tokens).cast("long")
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"),
        F.col(source).alias("source"),
        F.greatest(F.lit(1).cast("long"), F.coalesce(count, F.lit(1).cast("long"))).alias("n_tokens"),
        F.monotonically_increasing_id().alias("row"),
    )
    rows = stage(rows, "mix-rows")
    sources, _ = plan_sources(rows, target_entropy, max_repeats, budget)
    return draws(rows, stage(sources, "mix-plan")).drop("row")
