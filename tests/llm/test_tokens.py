"""Token counts and packing, next to the tokenizer library."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from basketline.llm import residual_packing, token_counts, worker

BYTES = public_tokenizers.path("byte_bpe_50k.json")
WORD = public_tokenizers.path("word_bpe_49k.json")

TRICKY = [
    "a  b", "a\n\nb", "a \nb", "\n", " ", "  ", "a ", "a\n", " a", "\na", "don't I'll we've _x__ 12a", "x\ty",
    "é È ñ", "日本 語", "<|endoftext|> a", "a²b", "İx", "a\r\nb", "__a__ _", "'s 't", "x's 'S", "a\n b\n\n c", "",
    "STRASSE ß ŉ", "Привет, Мир! ёлка ЁЖ 3-й", "ΟΔΟΣ σας ΑΒΓ", "日本語のテキスト、です。「はい」", "한국어 문장 한국어",
    "“quoted” – it’s… ok—so", "漢字一二三123", "x" * 5_000 + " " + "ab1!" * 3_000, "Ω²½Ⅷ ๓", "word" * 60 + " don't", "á é", "1234 567", "a.b,c!? --- ***", "a\x0bb\x0cc\x1cd\x85e\xa0f",
]


@pytest.fixture(scope="module")
def tricky(spark):
    return spark.createDataFrame(list(enumerate(TRICKY)), "doc_id long, text string")


def test_counts_are_the_librarys(spark, tricky, edge_docs):
    library = Tokenizer.from_file(BYTES)
    for docs in (tricky, edge_docs):
        got = token_counts.with_token_counts(docs, BYTES, limit=512).collect()
        assert len(got) == docs.count()
        for row in got:
            n = len(library.encode(row.text or "", add_special_tokens=False).ids)
            assert (row.n_tokens, row.over_limit) == (n, n > 512), row.text
            assert row.n_bytes == len((row.text or "").encode())


def test_a_small_table_and_cache_give_the_same(spark, edge_docs, monkeypatch):
    want = Counter((r.doc_id, r.n_tokens) for r in token_counts.with_token_counts(edge_docs, BYTES, 9).collect())
    for name, value in (("TABLE_SIZE", 3), ("TASK_SIZE", 2), ("TASK_COUNTERS", 4), ("CACHE_SIZE", 5)):
        monkeypatch.setattr(token_counts, name, value)
    got = Counter((r.doc_id, r.n_tokens) for r in token_counts.with_token_counts(edge_docs, BYTES, 9).collect())
    assert got == want


def test_no_documents(no_docs):
    assert token_counts.with_token_counts(no_docs, BYTES, 9).count() == 0
    assert residual_packing.pack(no_docs, WORD, 1).count() == 0


def test_frequent_pieces_are_the_commonest(spark, edge_docs):
    rows = token_counts.frequent_pre_tokens(edge_docs, "text").collect()
    counts = [r.n for r in rows]
    assert counts == sorted(counts, reverse=True) and " the" in [r.piece for r in rows[:60]]


@pytest.mark.parametrize("path", [BYTES, WORD])
def test_ranks_encode_like_the_library(path):
    library, encode = Tokenizer.from_file(path), worker.piece_encoder(path)
    rng = random.Random(1)
    parts = ["the", "ing", "ß", "é", "qu", "x", "ation", "z", "str", "ñ", "oo"]
    words = {"".join(rng.choices(parts, k=rng.randint(1, 7))) for _ in range(3000)}
    for word in words:
        assert list(encode(word)) == library.encode(word, add_special_tokens=False).ids


def check_packing(rows, docs, capacity, end=1):
    """Every document's ids, whole and once, in sequences without gaps."""
    library = Tokenizer.from_file(WORD)
    want = Counter()
    for doc_id, text in docs:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, end], dtype="<u4")
        for k, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at : at + capacity]
            want[(doc_id, k, at, len(part), zlib.crc32(part.tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences), sum(r.length for r in rows)


@pytest.mark.parametrize("capacity", [4096, 64, 7])
def test_packing(spark, tricky, edge_docs, edge_rows, capacity):
    rows = residual_packing.pack(edge_docs, WORD, 1, capacity).collect()
    check_packing(rows, [(r[0], r[1]) for r in edge_rows], capacity)
    rows = residual_packing.pack(tricky, WORD, 1, capacity).collect()
    check_packing(rows, list(enumerate(TRICKY)), capacity)


def test_packing_over_many_tasks_and_rounds(spark, monkeypatch):
    for name, value in (("FAN_IN", 2), ("CARRY", 3), ("BLOCK", 20)):
        monkeypatch.setattr(residual_packing, name, value)
    rng = random.Random(3)
    docs = [(i, " ".join(["word"] * rng.randint(0, 90))) for i in range(900)]
    rows = residual_packing.pack(spark.createDataFrame(docs, "doc_id long, text string").repartition(9), WORD, 1, 100)
    sequences, tokens = check_packing(rows.collect(), docs, 100)
    assert sequences <= 1.1 * -(-tokens // 100)


def test_best_fit_takes_the_fullest_bin_with_room():
    bins = residual_packing.best_fit([4, 7, 3, 6], 10)
    assert sorted(sorted(b) for b in bins) == [[0, 3], [1, 2]]
    assert residual_packing.best_fit([], 10) == []
    assert sorted(map(sorted, residual_packing.best_fit([10, 10, 1], 10))) == [[0], [1], [2]]


def test_every_plain_character_splits_as_in_the_library():
    count, word = Tokenizer.from_file(BYTES), Tokenizer.from_file(WORD)
    chars = [c for c in map(chr, range(0x10000)) if not 0xD800 <= ord(c) < 0xE000 and worker.splits_plainly(c)]
    assert len(chars) > 30_000
    for c in chars:
        text = f"a{c}b {c}{c} 1{c}2 .{c}."
        assert [text[a:b] for _, (a, b) in count.pre_tokenizer.pre_tokenize_str(text)] == token_counts.PRE_TOKEN.findall(text)
        normal = word.normalizer.normalize_str(text)
        assert normal.split() == text.lower().split()
        pieces = [normal[a:b] for _, (a, b) in word.pre_tokenizer.pre_tokenize_str(normal)]
        assert pieces == [p for w in text.lower().split() for p in residual_packing.PRE_TOKEN.findall(w)]
