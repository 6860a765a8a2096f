"""Exact token counts by a two-tier lookup of pre-token lengths, without shuffling texts.

Tier one is a broadcast table: the most frequent pre-tokens of the corpus and how many
tokens each has. Every task sums up its pre-tokens and passes on its commonest ones only,
so what is merged is bounded by the number of tasks. Tier two is a cache in each worker:
pre-tokens that the table lacks are encoded by the library once and kept. The table
decides only how much is encoded anew; the counts are the library's for any table.

A byte-level BPE never merges across pre-tokens, so the lengths add up to a text's count.
A word between two spaces has the same pre-tokens in every text, so each worker also
keeps their sum per word. Texts with other white space are split by the pattern; texts
with characters outside the Latin blocks, or with a special token's string, go through the
library whole.

Null and empty texts have no tokens. An empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketline.llm.worker import kept, piece_encoder, splits_plainly, tokenizer

#: Pre-tokens in the broadcast table, that a task may propose, and that a task may count.
TABLE_SIZE = 32_768
TASK_SIZE = 4_096
TASK_COUNTERS = 1_000_000
#: Entries of a worker's caches, which start again when full, and characters of an entry.
CACHE_SIZE = 600_000
CACHED_CHARS = 40

#: The tokenizer's splitting pattern, for texts that split plainly (see ``worker``).
PRE_TOKEN = re.compile(r"'(?:[stmd]|re|ve|ll)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
#: White space other than one space or one line end between words.
ODD_SPACE = re.compile(r"[\t\r]|[ \n][ \n]|[ \n]\Z|\A[ \n]")


def frequent_pre_tokens(docs: DataFrame, text: str) -> DataFrame:
    """The commonest pre-tokens over all texts: (piece, n), at most ``TABLE_SIZE`` rows."""

    def common(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words: Counter[str] = Counter()
        for batch in batches:
            for value in batch.iloc[:, 0]:
                if value and splits_plainly(value):
                    words.update(value.split())
                    if len(words) > TASK_COUNTERS:
                        words = Counter(dict(words.most_common(TASK_COUNTERS // 2)))
        pieces: Counter[str] = Counter()
        for word, n in words.items():
            for piece in PRE_TOKEN.findall(f" {word}"):
                pieces[piece] += n
        top = pieces.most_common(TASK_SIZE)
        if top:
            yield pd.DataFrame(top, columns=["piece", "n"])

    proposed = docs.select(text).mapInPandas(common, "piece string, n long")
    merged = proposed.groupBy("piece").agg(F.sum("n").alias("n"))
    return merged.orderBy(F.desc("n"), "piece").limit(TABLE_SIZE)


def token_count(docs: DataFrame, tokenizer_file: str, text: str = "text"):
    """A column with the number of tokens of each text of ``docs``."""
    spark = docs.sparkSession
    encode_here = piece_encoder(tokenizer_file)
    pieces = [row.piece for row in frequent_pre_tokens(docs, text).select("piece").collect()]
    table = spark.sparkContext.broadcast({piece: len(encode_here(piece)) for piece in pieces})

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        library = tokenizer(tokenizer_file)
        encode = piece_encoder(tokenizer_file)
        frequent = table.value
        pieces_seen: dict[str, int] = kept(f"piece lengths {tokenizer_file}", dict)
        words_seen: dict[str, int] = kept(f"word lengths {tokenizer_file}", dict)

        def piece_length(piece: str) -> int:
            if (n := frequent.get(piece) or pieces_seen.get(piece)) is not None:
                return n
            n = len(encode(piece))
            if len(piece) <= CACHED_CHARS:
                if len(pieces_seen) >= CACHE_SIZE:
                    pieces_seen.clear()
                pieces_seen[piece] = n
            return n

        def word_length(word: str) -> int:
            n = sum(map(piece_length, PRE_TOKEN.findall(word)))
            if len(word) <= CACHED_CHARS:
                if len(words_seen) >= CACHE_SIZE:
                    words_seen.clear()
                    words_seen[""] = line_end
                words_seen[word] = n
            return n

        def of(value: str) -> int:
            if not value:
                return 0
            if not splits_plainly(value):
                return len(library.encode_batch_fast([value], add_special_tokens=False)[0].ids)
            if ODD_SPACE.search(value):
                return sum(map(piece_length, PRE_TOKEN.findall(value)))
            # An empty word stands for a line end, which is a pre-token of its own.
            words = value.replace("\n", "\n\n").replace(" ", "\n ").split("\n")
            return sum([known(word) or word_length(word) for word in words])

        known = words_seen.get
        line_end = words_seen[""] = piece_length("\n")
        for batch in batches:
            yield pd.Series([of(v) for v in batch], dtype="int64")

    return count(F.col(text))


def with_token_counts(docs: DataFrame, tokenizer_file: str, limit: int, text: str = "text") -> DataFrame:
    """``docs`` with n_bytes, n_tokens and over_limit in place of columns of these names."""
    counted = docs.withColumn("n_tokens", token_count(docs, tokenizer_file, text))
    return counted.withColumns(
        {
            "n_bytes": F.coalesce(F.octet_length(text), F.lit(0)).cast("long"),
            "over_limit": F.col("n_tokens") > limit,
        }
    )
