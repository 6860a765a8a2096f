"""Near-duplicates by fingerprints and vectors, and components, by brute force."""

import random
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from basketline.llm import gray_simhash, vector_lsh
from basketline.llm.common import Merged
from basketline.llm.components import components

from .conftest import prose


def smallest_reachable(keys, linked):
    """Of each position, the smallest non-null key of its group."""
    merged = Merged(len(keys))
    a, b = np.nonzero(linked)
    merged.link(a, b)
    out = {}
    for label, key in zip(merged.label.tolist(), keys, strict=True):
        if key is not None:
            out[label] = min(out.get(label, key), key)
    return [out.get(label) for label in merged.label.tolist()]


@pytest.mark.parametrize("kind", ["path", "star", "random", "loops", "none"])
def test_components(spark, kind):
    rng = random.Random(2)
    edges = {
        "path": [(i, i + 1) for i in range(60)],
        "star": [(7, i) for i in range(50)],
        "random": [(rng.randrange(200), rng.randrange(200)) for _ in range(120)],
        "loops": [(3, 3), (4, 3), (3, 4), (-9, 4)],
        "none": [],
    }[kind]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = sorted({n for e in edges if e[0] != e[1] for n in e})
    at = {n: i for i, n in enumerate(nodes)}
    linked = np.zeros((len(nodes), len(nodes)), bool)
    for a, b in edges:
        if a != b:
            linked[at[a], at[b]] = True
    assert got == dict(zip(nodes, smallest_reachable(nodes, linked), strict=True))


def plain_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def check_groups(rows, docs):
    codes = np.array([plain_fingerprint(t) for _, t in docs], dtype=np.uint64)
    want = smallest_reachable([d for d, _ in docs], np.bitwise_count(codes[:, None] ^ codes[None, :]) <= 2)
    made = Counter((d, f"{c:016x}", w) for (d, _), c, w in zip(docs, codes.tolist(), want, strict=True))
    assert Counter((r.doc_id, r.f, r.component_id) for r in rows) == made


def test_fingerprints_and_groups(spark, edge_docs, edge_rows, clashing_docs, no_docs):
    for docs in (edge_docs, clashing_docs):
        found = gray_simhash.near_duplicates(docs).withColumn("f", gray_simhash.as_hex("code"))
        check_groups(found.collect(), [(r[0], r[1]) for r in edge_rows])
    assert gray_simhash.near_duplicates(no_docs).count() == 0


def test_near_copies_chain(spark):
    rng = random.Random(4)
    docs, base = [], prose(1, 400).split()
    for i in range(150):
        words = list(base)
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(len(words))] = f"w{rng.randrange(9)}"
        docs.append((i, " ".join(words)))
    found = gray_simhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string").repartition(4))
    check_groups(found.withColumn("f", gray_simhash.as_hex("code")).collect(), docs)


def near_codes(n, seed):
    rng = random.Random(seed)
    codes = {rng.getrandbits(64) for _ in range(max(1, n // 8))}
    while len(codes) < n:
        x = rng.choice(sorted(codes)[:50])
        for _ in range(rng.randint(1, 4)):
            x ^= 1 << rng.randrange(64)
        codes.add(x)
    return np.array(sorted(codes), dtype=np.uint64)


@pytest.mark.parametrize("n", [1, 2, 33, 700])
def test_index_finds_all_links_of_a_node(n):
    codes = near_codes(n, n)
    codes = codes[np.argsort(gray_simhash.gray_rank(codes))]
    merged = Merged(n)
    merged.link(*np.nonzero(np.bitwise_count(codes[:, None] ^ codes[None, :]) <= 2))
    assert (gray_simhash.link_node(codes) == merged.label).all()


def test_gray_neighbours_differ_in_one_bit():
    codes = np.arange(64, dtype=np.uint64)
    ordered = codes[np.argsort(gray_simhash.gray_rank(codes))]
    assert (np.bitwise_count(ordered[1:] ^ ordered[:-1]) == 1).all()


def test_parts_of_a_mask_cover_all_bits():
    for mask in (0, 0b1011, (1 << 63) | 1):
        parts = gray_simhash.split_mask(mask)
        assert len(parts) == 3 and parts[0] | parts[1] | parts[2] == gray_simhash.ALL_BITS
        assert parts[0] & parts[1] == mask


def test_large_nodes_are_split(spark, monkeypatch):
    monkeypatch.setattr(gray_simhash, "NODE_SIZE", 20)
    codes = near_codes(400, 9).view(np.int64)
    found = gray_simhash.links(spark.createDataFrame([(int(c),) for c in codes], "code long"))
    got = {r.node: r.component for r in components(found).collect()}
    bits = codes.view(np.uint64)
    want = smallest_reachable(codes.tolist(), np.bitwise_count(bits[:, None] ^ bits[None, :]) <= 2)
    assert [got.get(c, c) for c in codes.tolist()] == want


def test_one_of_each_group(spark, edge_docs, clashing_docs, no_docs):
    for docs in (edge_docs, clashing_docs, no_docs):
        kept = gray_simhash.one_of_each(docs)
        assert kept.columns == docs.columns
        found = gray_simhash.near_duplicates(docs)
        assert kept.count() == found.select("component").distinct().count()
        ids = Counter(r.doc_id for r in kept.collect())
        assert all(r.component_id in ids for r in found.collect())


def vectors(seed, n, dim=16):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((n // 6, dim))
    rows = centres[rng.integers(0, len(centres), n)] + rng.standard_normal((n, dim)) * rng.choice([0.02, 0.15, 0.6], (n, 1))
    return [[float(x) for x in row] for row in rows.astype(np.float32)]


def check_vectors(rows, given, exact=True):
    usable = [i for i, (_, v) in enumerate(given) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    linked = np.zeros((len(given), len(given)), bool)
    for i in usable:
        for j in usable:
            a, b = given[i][1], given[j][1]
            if i != j and len(a) == len(b):
                a, b = np.array(a, float), np.array(b, float)
                linked[i, j] = a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= 0.9
    want = smallest_reachable([k for k, _ in given], linked)
    made = Counter(
        (k, int(n), w, k is not None and k == w) for (k, _), n, w in zip(given, linked.sum(1), want, strict=True)
    )
    got = Counter((r.vec_id, r.n_links, r.component_id, r.kept) for r in rows)
    if exact:
        assert got == made
    return sum(r.n_links for r in rows), int(linked.sum())


SCHEMA = "vec_id long, embedding array<float>"


def test_vectors_link_by_cosine(spark):
    given = list(enumerate(vectors(1, 300)))
    found, all_ = check_vectors(vector_lsh.near_duplicates(spark.createDataFrame(given, SCHEMA)).collect(), given, exact=False)
    assert 0.95 * all_ <= found <= all_


def test_strange_vectors(spark):
    one = [1.0, 2.0, 0.5]
    odd = [None, [], [0.0, 0.0, 0.0], [1.0, None, 1.0], [float("nan"), 1.0, 1.0], [float("inf"), 1.0, 1.0]]
    given = list(enumerate(odd)) + [(10, one), (10, one), (11, one), (12, [2.0, 4.0, 1.0]), (None, one)]
    given += [(13, [1.0, 2.0]), (14, [-1.0, -2.0, -0.5]), (15, [1e-30, 2e-30, 5e-31])]
    df = spark.createDataFrame(given, SCHEMA)
    check_vectors(vector_lsh.near_duplicates(df).collect(), given)
    clashing = df.withColumns({n: F.lit(1) for n in ("node", "dim", "own", "first", "n", "code", "vector")})
    check_vectors(vector_lsh.near_duplicates(clashing).collect(), given)
    assert vector_lsh.near_duplicates(df.where("false")).count() == 0


def test_large_buckets_go_by_blocks(spark, monkeypatch):
    """All pairs of a hot bucket are compared, block against block, and counted once."""
    monkeypatch.setattr(vector_lsh, "BLOCK", 16)
    rng = np.random.default_rng(5)
    near = rng.standard_normal(8) + rng.standard_normal((150, 8)) * 0.01
    given = [(i, [float(x) for x in v]) for i, v in enumerate(near)]
    check_vectors(vector_lsh.near_duplicates(spark.createDataFrame(given, SCHEMA)).collect(), given)


def test_signs_and_tables_grow_with_the_vectors():
    few, many = vector_lsh.plan(1_000, 0.9), vector_lsh.plan(10_000_000, 0.9)
    assert few[0] < many[0] and few[1] < many[1]
