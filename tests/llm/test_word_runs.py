"""Periodic runs, by trying every period at every word."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from basketline.llm import queries, word_runs

from .conftest import prose


def brute(words):
    """Runs (start, length, period) by the definition."""
    n, out = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            start, length = i, j + q - i
            if length >= max(6, 4 * q) and not any(smaller_period(words[start : start + length], p) for p in range(1, q)):
                out.append((start, length, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def smaller_period(words, p):
    return all(words[i] == words[i + p] for i in range(len(words) - p))


def collapse(words, runs):
    dropped = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in dropped)


def split(text):
    return [w.decode() for w in (text or "").encode().split()]


def random_words(rng):
    kind, letters = rng.randrange(4), "abcdef"[: rng.randint(1, 4)]
    if kind == 0:
        return [rng.choice(letters) for _ in range(rng.randrange(60))]
    words = [f"w{rng.randrange(50)}" for _ in range(rng.randrange(20))]
    for _ in range(rng.randint(1, 3)):
        # Also periods that are powers, and runs inside of runs.
        unit = [rng.choice(letters) for _ in range(rng.choice([1, 2, 3, 5, 6, 7, 18, 19, 20, 58]))]
        if kind == 2:
            unit = unit * rng.randint(1, 5) + ["x"]
        times = rng.randint(3, 6)
        words += (unit * (times + 1))[: len(unit) * times + rng.randrange(len(unit))]
        words += [f"w{rng.randrange(50)}" for _ in range(rng.randrange(8))]
    return words


def check(docs):
    rows = word_runs.with_runs(docs).select("doc_id", "text", "periodic.*").collect()
    for r in rows:
        words = split(r.text)
        runs = [tuple(x) for x in r.runs]
        assert r.n_words == len(words)
        if len(words) < 3000:
            assert runs == brute(words), words
        assert r.collapsed == collapse(words, runs)
        best = min(runs, key=lambda x: (-x[1] / x[2], x[0], x[2])) if runs else None
        assert (r.strongest and tuple(r.strongest)) == best
    return rows


def test_runs_by_brute_force(spark, edge_docs, clashing_docs, no_docs):
    rng = random.Random(5)
    texts = [(i, " ".join(random_words(rng))) for i in range(1500)]
    rows = check(spark.createDataFrame(texts, "doc_id long, text string").repartition(4))
    assert sum(len(r.runs) for r in rows) > 1000
    assert len(check(edge_docs)) == edge_docs.count()
    assert word_runs.with_runs(clashing_docs).columns == [*clashing_docs.columns, "periodic"]
    check(clashing_docs)
    assert word_runs.with_runs(no_docs).count() == 0


def test_blocks_and_separators(spark, monkeypatch):
    monkeypatch.setattr(word_runs, "BLOCK_BYTES", 30)
    texts = ["a a a a a a", "a a a a a", None, "", " \t\n", "a\x0ba\x0ca\x1ca a", "é é é é é é é é é", "a b a b a b a b", "a b a b a b a",
             "a " * 6, "b " * 40 + "c " * 40, "a b b a b b a b b a b b"]
    check(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))


def test_one_word_and_long_periods():
    """Work stays near linear where a k-gram occurs at nearly every word."""
    words = np.zeros(200_000, dtype=np.int64)
    assert word_runs.find_runs(words, np.array([0, len(words)])) == [[(0, 200_000, 1)]]
    unit = np.arange(20_000)
    words = np.concatenate([[99_999], np.tile(unit, 4), unit[:7], [88_888]])
    assert word_runs.find_runs(words, np.array([0, len(words)])) == [[(1, 80_007, 20_000)]]
    nested = np.tile(np.concatenate([np.tile([0, 1], 30), [2]]), 50)
    runs = word_runs.find_runs(nested, np.array([0, len(nested)]))[0]
    assert (0, len(nested), 61) in runs and len(runs) == 51


def test_bands_cover_all_lags():
    bands = list(word_runs.bands(100_000))
    assert bands[0] == (5, 1, 5)
    for (_, _, high), (k, low, top) in zip(bands[:-1], bands[1:], strict=True):
        assert low == high + 1 and k == top
        assert all(word_runs.overlap(lag) >= k for lag in range(low, top + 1))
    assert bands[-1][2] >= 25_000


def planted(doc_id, words):
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_query(spark, sf):
    sf_dir = f"/root/testdata/{sf}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in queries.QUERIES["op13_word_runs"](spark, sf_dir).collect()}
    assert len(got) == len(docs)
    for doc in docs:
        words = planted(doc.doc_id, split(doc.text))
        if len(words) > 2500:
            continue
        runs, row = brute(words), got[doc.doc_id]
        best = min(runs, key=lambda x: (-x[1] / x[2], x[0], x[2])) if runs else (None,) * 3
        assert (row.n_runs, row.start, row.length, row.period) == (len(runs), *best)
        assert row.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert row.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
        assert row.collapsed_sha256 == hashlib.sha256(collapse(words, runs).encode()).hexdigest()


def test_planted_texts(spark, edge_docs, no_docs):
    docs = spark.createDataFrame([(i, prose(i, i % 40)) for i in range(300)] + [(None, "a b")], "doc_id long, text string")
    rows = docs.select("doc_id", "text", queries.with_periods("doc_id", "text").alias("made")).collect()
    assert any(r.made != r.text for r in rows)
    for r in rows:
        assert split(r.made) == (planted(r.doc_id, split(r.text)) if r.doc_id is not None else split(r.text))
