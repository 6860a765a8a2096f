"""Cutting-stock packing: exact round trips, padding, and the linear program by brute force."""

import random
import zlib
from collections import defaultdict
from itertools import product

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from basketline.llm import queries, stock_packing, stock_patterns

from .test_tokens import TRICKY

WORD = public_tokenizers.path("word_bpe_49k.json")


def check(rows, docs, capacity, end=2):
    """Every id of every document once, sequences without gaps, and padding; (sequences, padding, cut documents)."""
    library = Tokenizer.from_file(WORD)
    want = defaultdict(list)
    for doc_id, text in docs:
        want[doc_id].append(np.array([*library.encode(text or "", add_special_tokens=False).ids, end], dtype="<u4"))
    got, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        got[r.doc_id].append((r.start, r.length, r.ids_crc32, r.doc_tokens))
        sequences[r.sequence_id].append((r.offset, r.length))
        assert 0 < r.length <= capacity
    assert set(got) == set(want)
    cut = 0
    for doc_id, pieces in got.items():
        # Documents of one id are covered one after the other.
        if len(want[doc_id]) == 1:
            ids, at = want[doc_id][0], 0
            for start, length, crc, tokens in sorted(pieces):
                assert start == at and tokens == len(ids)
                assert crc == zlib.crc32(ids[start : start + length].tobytes())
                at += length
            assert at == len(ids)
            cut += len(ids) <= capacity and len(pieces) > 1
        else:
            assert sum(p[1] for p in pieces) == sum(map(len, want[doc_id]))
    padding = 0
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
        padding += 0 if at & (at - 1) == 0 else capacity - at
    return len(sequences), padding, cut


@pytest.mark.parametrize("capacity", [4096, 64, 7])
def test_odd_tables(spark, edge_docs, edge_rows, clashing_docs, capacity):
    assert check(stock_packing.pack(edge_docs, WORD, 2, capacity).collect(), [(r[0], r[1]) for r in edge_rows], capacity)[1] == 0
    tricky = spark.createDataFrame(list(enumerate(TRICKY)), "doc_id long, text string").repartition(3)
    assert check(stock_packing.pack(tricky, WORD, 2, capacity).collect(), list(enumerate(TRICKY)), capacity)[1] == 0
    if capacity == 64:
        check(stock_packing.pack(clashing_docs, WORD, 2, capacity).collect(), [(r[0], r[1]) for r in edge_rows], capacity)


def test_no_documents(no_docs):
    assert stock_packing.pack(no_docs, WORD, 2).count() == 0


def test_most_documents_stay_whole(spark):
    rng = random.Random(3)
    docs = [(i, " ".join(["word"] * int(rng.expovariate(1 / 40)))) for i in range(6000)]
    rows = stock_packing.pack(spark.createDataFrame(docs, "doc_id long, text string").repartition(9), WORD, 2, 256).collect()
    _, padding, cut = check(rows, docs, 256)
    assert padding == 0 and cut < 0.04 * len(docs)


def test_documents_over_half_a_sequence(spark):
    """No two fit together; a third of them fills the others."""
    docs = [(i, " ".join(["word"] * 32)) for i in range(900)]
    rows = stock_packing.pack(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), WORD, 2, 64).collect()
    sequences, padding, cut = check(rows, docs, 64)
    assert padding == 0 and sequences <= 33 * 900 // 64 + 6


def test_query(spark, tiny_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{tiny_dir}/documents.parquet").select("doc_id", "text").collect()]
    rows = queries.QUERIES["op12_stock_packing"](spark, tiny_dir).collect()
    assert check(rows, docs, 4096)[1] == 0


def test_knapsack_by_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(20):
        sizes = np.sort(rng.choice(np.arange(1, 12), 4, replace=False))
        values, capacity = rng.random(4), 14
        best, _ = stock_patterns.knapsack(values, sizes, capacity)
        for c in range(capacity + 1):
            every = [np.array(a) for a in product(*(range(c // s + 1) for s in sizes))]
            assert abs(best[c] - max(a @ values for a in every if a @ sizes <= c)) < 1e-9


def test_patterns_use_up_the_demand_near_the_bound():
    rng = np.random.default_rng(2)
    for sizes, capacity in ((np.array([3, 4, 5, 7]), 15), (stock_patterns.class_sizes(256, 16), 256)):
        demand = rng.integers(1, 5_000, len(sizes))
        columns, inverse, bound = stock_patterns.solve(sizes, demand, capacity)
        patterns = stock_patterns.rounded(columns, inverse, sizes, demand, capacity)
        assert (sum(times * p for times, p in patterns) == demand).all()
        assert all(p @ sizes <= capacity for _, p in patterns)
        n = sum(times for times, _ in patterns)
        assert bound - 1e-6 <= n <= 1.004 * bound + len(sizes)


def test_classes():
    for capacity, resolution in ((4096, 32), (64, 32), (7, 32), (1000, 4)):
        sizes = stock_patterns.class_sizes(capacity, resolution)
        assert sizes[-1] == capacity and (np.diff(sizes) > 0).all() and sizes[0] == 1
        assert all(b - a <= max(1, b / resolution) for a, b in zip(sizes[:-1], sizes[1:], strict=True))
