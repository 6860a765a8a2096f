"""The pipeline's near-copies: the index's recall and groups by brute force."""

import random

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from basketline.llm import gray_copies, shingle_dedup

from .test_groups import smallest_reachable
from .test_shingle_dedup import plain_alike, planted


def test_close_pairs_by_brute_force():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    codes = np.unique(np.concatenate([base[rng.integers(0, 40, 700)] ^ (np.uint64(1) << rng.integers(0, 64, 700).astype(np.uint64)) for _ in range(2)]))
    codes = codes[np.argsort(gray_copies.gray_rank(codes))]
    for limit in (1, 2, 16, 30):
        got = {(int(i), int(j)) for a, b in gray_copies.close_pairs(codes, limit) for i, j in zip(a, b, strict=True)}
        near = np.bitwise_count(codes[:, None] ^ codes[None, :]) <= limit
        assert got == {(int(i), int(j)) for i, j in zip(*np.nonzero(np.triu(near, 1)), strict=True)}


@pytest.mark.parametrize("part_rows", [4096, 16])
def test_stage_keeps_one_of_each_group(spark, monkeypatch, part_rows):
    """No wrong link, and at least nine in ten of the copies to drop are dropped."""
    monkeypatch.setattr(gray_copies, "PART_ROWS", part_rows)
    texts = planted(1, 25, 6) + planted(2, 2, 40)
    rows = [(i, t, "en", "a", 1) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()}
    reached = smallest_reachable(list(range(len(texts))), plain_alike(texts))
    want = set(reached)
    # Each group keeps a member; what a lost link keeps besides is at most a tenth of the copies.
    assert {reached[i] for i in got} == want
    assert len(got) - len(want) <= 0.1 * (len(texts) - len(want))


def test_recall_on_sf01(spark):
    """Of the pairs at 0.8 or more in the larger table, nine in ten meet below an index node."""
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("text").collect()]
    sets = {frozenset(gray_copies.shingles(t)) for t in texts}
    sets = [s for s in sets if len(s) >= 4]
    seen, pairs = {}, set()
    for i, s in enumerate(sets):
        for x in s:
            seen.setdefault(x, []).append(i)
    for holders in seen.values():
        if 1 < len(holders) <= 40:
            pairs |= {(a, b) for k, a in enumerate(holders) for b in holders[k + 1 :]}
    alike = [(a, b) for a, b in pairs if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    assert len(alike) > 30
    codes = np.array([code_of(s) for s in sets], dtype=np.uint64)
    chosen = [np.uint64(m) for m in gray_copies.masks(len(sets))]
    apart = [int(np.bitwise_count(codes[a] ^ codes[b])) for a, b in alike]
    met = [d <= gray_copies.LIMIT and any((codes[a] ^ codes[b]) & m == 0 for m in chosen) for d, (a, b) in zip(apart, alike, strict=True)]
    assert sum(met) >= 0.9 * len(met), (sum(met), len(met), sorted(apart)[-5:])


def code_of(shingles):
    hashes = np.array([xxhash.xxh64_intdigest(s, 42) for s in shingles], dtype="<u8")
    ones = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=int)
    return sum(1 << b for b in range(64) if ones[b] * 2 > len(shingles))


def test_many_unlike_texts_with_one_shingle_end(spark):
    rng = random.Random(4)
    head = "all rights reserved by the owners of this page "
    rows = [(i, head + " ".join(f"w{rng.randrange(10**6)}" for _ in range(12)), "en", "a", 1) for i in range(20_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(8)
    assert gray_copies.one_of_each(docs).count() == 20_000


def test_odd_tables(spark, edge_docs, clashing_docs, no_docs):
    for docs in (edge_docs, clashing_docs, no_docs):
        kept = gray_copies.one_of_each(docs)
        assert kept.columns == docs.columns
        texts = [r.text for r in docs.select("text").collect()]
        assert kept.count() == len(set(smallest_reachable(list(range(len(texts))), plain_alike(texts))))


def crowd(seed, n):
    """Texts made from one template with up to eight words changed: close fingerprints, most unlike each other."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(3000)}" for _ in range(150)]
    texts = []
    for _ in range(n):
        words = list(base)
        for at in rng.sample(range(len(words)), rng.choice([1, 4, 5, 6, 7, 8])):
            words[at] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(words))
    return texts


@pytest.mark.parametrize("part_rows", [4096, 64])
def test_compared_pairs_of_a_crowd_grow_as_its_rows(spark, monkeypatch, part_rows):
    """Pairs of a template's unlike texts are not all brought together; the alike ones are found."""
    monkeypatch.setattr(gray_copies, "PART_ROWS", part_rows)
    compared, true = [], gray_copies._verified
    monkeypatch.setattr(gray_copies, "_verified", lambda pairs, texts: compared.append(pairs.count()) or true(pairs, texts))
    texts = crowd(1, 400)
    rows = [(i, t, "en", "a", 1) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = sorted(r.doc_id for r in gray_copies.one_of_each(docs).collect())
    reached = smallest_reachable(list(range(len(texts))), plain_alike(texts))
    assert got == sorted(set(reached)) and 200 < len(got) < 360
    assert sum(compared) <= 20 * len(texts), compared


def test_parities_drop_no_alike_pair():
    """Over sizes on both sides of a power of two and beyond the longest parity."""
    rng = random.Random(2)
    long = " ".join(f"w{rng.randrange(10**6)}" for _ in range(20_000))
    texts = [t for t in planted(3, 40, 5) if len(gray_copies.shingles(t)) >= 4] + crowd(4, 100) + [long, f"{long} end", long[:100_000]]
    sets = [gray_copies.shingles(t) for t in texts]
    parities = [gray_copies.parity(t) for t in texts]
    assert {len(p) for p in parities} >= {16, 64, 128, 8192}
    n = np.array([len(s) for s in sets])
    a, b = np.triu_indices(len(texts), 1)
    # Others are too different in size and never asked for.
    asked = 5 * np.minimum(n[a], n[b]) >= 4 * np.maximum(n[a], n[b])
    a, b = a[asked], b[asked]
    fits = gray_copies.Parities(parities, n).possible(a, b)
    alike = np.array([shingle_dedup.alike(sets[i], sets[j]) for i, j in zip(a, b, strict=True)])
    assert alike.sum() > 100 and fits[alike].all()
    assert fits[~alike].mean() < 0.01


def test_forest_joins_the_same_groups_with_fewest_pairs():
    rng = np.random.default_rng(5)
    group = np.arange(300) // 3
    pairs = [rng.integers(0, 300, (2, 60)) for _ in range(4)]
    found = np.concatenate(list(gray_copies._forest(iter(pairs), group)), axis=1)
    chain = np.stack([np.arange(299), np.arange(1, 300)])[:, group[1:] == group[:-1]]

    def joined(links):
        merged = gray_copies.Merged(300)
        merged.link(*links)
        return merged.label

    want, got = joined(np.concatenate([chain, *pairs], axis=1)), joined(np.concatenate([chain, found], axis=1))
    assert (want == got).all() and found.shape[1] == 100 - len(set(want.tolist()))
