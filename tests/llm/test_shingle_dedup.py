"""Near-copies by five-word Jaccard similarity, by brute force."""

import random

import numpy as np
import pytest

from basketline.llm import gray_simhash, shingle_dedup

from .test_groups import smallest_reachable


def plain_shingles(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_alike(texts):
    sets = [plain_shingles(t) for t in texts]
    same = [[5 * len(a & b) >= 4 * len(a | b) for b in sets] for a in sets]
    return np.array(same, dtype=bool).reshape(len(sets), len(sets))


def planted(seed, groups, copies):
    """Texts in groups, whose members have up to four words or the end changed; and short ones."""
    rng = random.Random(seed)
    texts = [None, "", " ", "one word", "One  word", "a b c d e", "a b c d e f g h", "a b c d e f g h i", "a b c d e f g"]
    for g in range(groups):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([30, 120, 300]))]
        for _ in range(copies):
            words = list(base)
            for _ in range(rng.randrange(5)):
                words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
            texts.append(" ".join(words[: len(words) - rng.randrange(len(words) // 8)]))
    return texts


def kept_ids(texts):
    return sorted(set(smallest_reachable(list(range(len(texts))), plain_alike(texts))))


@pytest.mark.parametrize("case", [(1, 25, 6, {}), (2, 2, 40, {}), (3, 8, 12, {"PAIRS": 0, "SAMPLED": 1, "SEEN": 2})])
def test_stage_keeps_one_of_each_group(spark, monkeypatch, case):
    seed, groups, copies, bounds = case
    for name, value in bounds.items():
        monkeypatch.setattr(shingle_dedup, name, value)
    texts = planted(seed, groups, copies)
    rows = [(i, t, "en", "a", 1) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    kept = shingle_dedup.one_of_each(docs)
    assert sorted(r.doc_id for r in kept.collect()) == kept_ids(texts)


def test_planted_copies_are_beyond_two_bits():
    """The cases above hold pairs that fingerprints at two bits do not link."""
    texts = planted(1, 25, 6)
    codes = np.array([gray_simhash.fingerprint(t) for t in texts], dtype=np.uint64)
    apart = np.bitwise_count(codes[:, None] ^ codes[None, :])
    assert (plain_alike(texts) & (apart > 2)).sum() > 20


def test_alike_sets_share_a_prefix():
    rng = np.random.default_rng(4)
    for _ in range(2000):
        n = int(rng.integers(4, 60))
        codes = np.unique(rng.integers(0, 10**6, n))
        other = np.unique(np.concatenate([codes[rng.random(len(codes)) < 0.95], rng.integers(0, 10**6, n // 12)]))
        last = np.sort(rng.choice(codes, len(codes) // 3))
        if shingle_dedup.alike(set(codes.tolist()), set(other.tolist())):
            assert np.intersect1d(shingle_dedup.prefix(codes, last), shingle_dedup.prefix(other, last)).size


def test_odd_tables(spark, edge_docs, clashing_docs, no_docs):
    for docs in (edge_docs, clashing_docs, no_docs):
        kept = shingle_dedup.one_of_each(docs)
        assert kept.columns == docs.columns
        rows = docs.select("doc_id", "text").collect()
        reached = smallest_reachable(list(range(len(rows))), plain_alike([r.text for r in rows]))
        assert kept.count() == len(set(reached))
