"""Rules, shards and mixtures by brute force; queries next to SQL; the pipeline."""

import math
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from basketline.llm import adaptive_rules, bounded_ring, queries, temperature_mix

from .conftest import SCHEMA, prose
from .test_tokens import check_packing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counts(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    repeated = {i + j for i, w in enumerate(windows) if often[w] > 1 for j in range(3)}
    failed = len(words) < 50 or 100 * len(repeated) > 50 * len(words)
    symbols = sum(c in "#*$%&|<>" for c in text)
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(repeated), failed


def check_counts(rows, texts):
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rows)
    assert got == Counter((d, *counts(t)) for d, t in texts)


REPEATS = [
    "a b c a b c", "a a a a", "a b c d", "a b", "", "x a b c y a b c z x a b c", "a b c b c a b c", "#a *b\n#a *b\n\n \n#a *b",
    "a b c " * 40, "é\x0bé\x0cé é é\r\né é", "<<>> | && 100% $5", "a  b   c a b c",
]


def test_counts(spark, edge_docs, edge_rows, clashing_docs, no_docs):
    for docs in (edge_docs, clashing_docs):
        check_counts(adaptive_rules.judge(docs).collect(), [(r[0], r[1]) for r in edge_rows])
    assert adaptive_rules.judge(no_docs).count() == 0
    docs = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in enumerate(REPEATS)], SCHEMA)
    check_counts(adaptive_rules.judge(docs).collect(), list(enumerate(REPEATS)))


@pytest.mark.parametrize("bits", [2, 13])
def test_windows_that_share_a_hash_are_told_apart(spark, monkeypatch, bits):
    """With most of the hash given to places, or places that don't fit, words decide."""
    place = 62 if bits == 13 else bits
    monkeypatch.setattr(adaptive_rules, "PLACE_BITS", place)
    monkeypatch.setattr(adaptive_rules, "_PLACE", (1 << place) - 1)
    texts = [*REPEATS, *(prose(i, 120) for i in range(5))]
    docs = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in enumerate(texts)], SCHEMA)
    check_counts(adaptive_rules.judge(docs).collect(), list(enumerate(texts)))


def test_limits_follow_the_group(spark):
    """Symbols that are usual in one source are an outlier in another; both have null languages."""
    docs = []
    for i in range(500):
        text = prose(i, 80)
        if i % 2 == 0 or i == 77:
            text += " #" * 40
        docs.append((i, text, None, "noisy" if i % 2 == 0 else "calm", 0))
    kept = {r.doc_id: r.kept for r in adaptive_rules.judge(spark.createDataFrame(docs, SCHEMA)).collect()}
    assert not kept[77]
    assert sum(kept[i] for i in range(0, 500, 2)) >= 245
    assert sum(kept[i] for i in range(1, 500, 2)) >= 245


def test_sketches_merge(spark):
    docs = spark.createDataFrame([(i, prose(i, 60 + i), "en", f"s{i % 3}", 0) for i in range(90)], SCHEMA)
    measured = adaptive_rules.measure(docs, "text", F.col("lang"), F.col("source"))
    halves = [adaptive_rules.sketches(measured.where(F.col("n_words") % 2 == k)) for k in (0, 1)]
    keys = ["lang", "source", "ratio", "low", "high"]
    merged = halves[0].unionAll(halves[1]).groupBy(*keys).agg(F.sum("n").alias("n"))
    assert Counter(map(tuple, merged.collect())) == Counter(map(tuple, adaptive_rules.sketches(measured).collect()))


def check_slots(rows, texts, shards):
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter(
        (d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t in texts
    )
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return [len(slots[s]) for s in range(shards)]


def test_even_shards(spark, edge_docs, edge_rows, clashing_docs, no_docs, monkeypatch):
    texts = [(r[0], r[1]) for r in edge_rows]
    for docs in (edge_docs, clashing_docs):
        for shards in (1, 7, 40):
            sizes = check_slots(bounded_ring.shard_rows(docs, shards).collect(), texts, shards)
            assert max(sizes) - min(sizes) <= 1
    assert bounded_ring.shard_rows(no_docs).count() == 0
    monkeypatch.setattr(bounded_ring, "PIECE", 3)
    same = [(5, "x")] * 60 + [(i, None) for i in range(30)]
    sizes = check_slots(bounded_ring.shard_rows(spark.createDataFrame(same, "doc_id long, text string"), 8).collect(), same, 8)
    assert sum(sizes) == 90 and max(sizes) - min(sizes) <= 1


def test_few_rows_move_to_a_new_shard(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    before, after = (
        {r.doc_id: r.shard for r in bounded_ring.shard_rows(docs, n, slack=0.25).collect()} for n in (20, 21)
    )
    moved = [d for d in before if before[d] != after[d]]
    assert len(moved) < 0.25 * len(before)
    for placed, n in ((before, 20), (after, 21)):
        assert max(Counter(placed.values()).values()) <= math.ceil(4000 / n) * 1.25


def test_overflow_goes_clockwise():
    owners = [0, 1, 2, 0]
    out = bounded_ring.walk({0: 5, 1: 1, 3: 2}, owners, [3, 3, 2])
    taken = defaultdict(int)
    for s in out:
        taken[s["arc"], s["shard"]] += s["high"] - s["low"]
    # Arc 0 fills shard 0; its other rows go to 1, then 2; arc 3 finds 0 full, then 1, then 2.
    assert dict(taken) == {(0, 0): 3, (1, 1): 1, (0, 1): 2, (3, 2): 2}
    with pytest.raises(ValueError):
        bounded_ring.walk({0: 9}, owners, [3, 3, 2])


def sources(spark, sizes):
    rows = [(f"s{k}" if k else None, i, " ".join(["w"] * (1 + i % 7))) for k, n in enumerate(sizes) for i in range(n)]
    return spark.createDataFrame(rows, "source string, doc_id long, text string").repartition(3)


def plain_temperature(tokens, target, limit, budget=None):
    """Exponent by a fine search, passes per source."""
    best = None
    for k in range(20_001):
        t = k / 20_000
        w = [n**t for n in tokens]
        w = [x / sum(w) for x in w]
        total = budget or max(n / x for n, x in zip(tokens, w, strict=True))
        passes = [x * total / n for n, x in zip(tokens, w, strict=True)]
        entropy = -sum(x * math.log(x) for x in w)
        if best is None and entropy <= target * math.log(len(tokens)) + 1e-12 and max(passes) <= limit:
            best = t, passes
    return best or (1.0, passes)


@pytest.mark.parametrize(("target", "limit"), [(0.95, 9.0), (0.95, 1.5), (0.2, 4.0), (1.0, 100.0)])
def test_mixture(spark, monkeypatch, target, limit):
    monkeypatch.setattr(temperature_mix, "BLOCK_ROWS", 10)
    docs = sources(spark, [40, 300, 7, 100])
    rows = temperature_mix.mix(docs, target, limit).collect()
    size, drawn, docs_of = defaultdict(int), defaultdict(int), defaultdict(Counter)
    for r in docs.collect():
        size[r.source] += len(r.text.split())
    for r in rows:
        drawn[r.source] += r.n_tokens
        docs_of[r.source][r.doc.doc_id] += 1
        assert r.n_tokens == len(r.doc.text.split())
    names = sorted(size, key=str)
    _, passes = plain_temperature([size[n] for n in names], target, limit)
    for name, want in zip(names, passes, strict=True):
        assert want * size[name] - 2 <= drawn[name] <= want * size[name] + 8
        # Whole passes, then a part of one: no document twice more than another.
        assert len(docs_of[name]) == [40, 300, 7, 100][int(name[1:]) if name else 0]
        assert max(docs_of[name].values()) - min(docs_of[name].values()) <= 1
    assert len({(r.doc.doc_id, r.source, r["pass"]) for r in rows}) == len(rows)


def test_a_budget_leaves_out_part_of_a_large_source(spark):
    docs = sources(spark, [10, 400])
    rows = temperature_mix.mix(docs, 1.0, 50.0, budget=400.0).collect()
    drawn = Counter()
    for r in rows:
        drawn[r.source] += r.n_tokens
    assert all(200 <= n <= 207 for n in drawn.values())


def test_mixing_edge_rows(spark, edge_docs, clashing_docs, no_docs):
    for docs in (edge_docs, clashing_docs):
        drawn = temperature_mix.mix(docs, 0.9, 3.0).select("doc.*")
        assert drawn.columns == docs.columns
        assert docs.exceptAll(drawn).count() == 0
    assert temperature_mix.mix(no_docs).count() == 0
    assert temperature_mix.mix(edge_docs.where("source = 'a'")).count() == edge_docs.where("source = 'a'").count()


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_with_sql(spark, tiny_dir, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tiny_dir}/{t}.parquet'")
    df = queries.QUERIES[name](spark, tiny_dir)
    want = con.sql(f"SELECT {','.join(df.columns)} FROM ({queries.ORACLES[name]})").fetchall()
    assert Counter(map(tuple, df.collect())) == Counter(want)


COLUMNS = {
    1: ["doc_id", "held_out", "score", "predicted"],
    3: ["doc_id", "held_out", "lang_pred", "score"],
    4: ["vec_id", "n_links", "component_id", "kept"],
    5: ["doc_id", "n_bytes", "n_tokens", "over_limit"],
    7: ["doc_id", "fingerprint", "component_id"],
    8: ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"],
    9: ["doc_id", "held_out", "score", "predicted"],
    10: ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_cover_their_tables(spark, tiny_dir, name):
    n = int(re.match(r"op(\d+)_", name)[1])
    df = queries.QUERIES[name](spark, tiny_dir)
    assert set(COLUMNS.get(n, [])) <= set(df.columns)
    key = "vec_id" if n == 4 else "doc_id"
    of = "embeddings" if n == 4 else "documents"
    ids = spark.read.parquet(f"{tiny_dir}/{of}.parquet").select(key)
    assert df.select(key).distinct().exceptAll(ids).count() == 0
    assert ids.exceptAll(df.select(key).distinct()).count() == 0


def test_pipeline(spark, tiny_dir):
    """Each stage on its own input: what it keeps, and that all of it is worked on."""
    docs = spark.read.parquet(f"{tiny_dir}/documents.parquet")
    found = {}
    for name, function in corpus_pipeline.STAGES[:-1]:
        out = function(spark, docs, tiny_dir)
        rows = out.collect()
        assert out.columns == docs.columns, name
        found[name] = (docs, rows)
        docs = spark.createDataFrame(rows, docs.schema)
    for name in ("quality classifier", "language ID", "SimHash near-dedup"):
        before, after = found[name]
        assert not Counter(after) - Counter(before.collect())
    before, after = found["mixing sources to target weights"]
    assert set(after) == set(before.collect())
    rows = corpus_pipeline.STAGES[-1][1](spark, docs, tiny_dir).collect()
    sequences, tokens = check_packing(rows, [(r.doc_id, r.text) for r in docs.collect()], 4096)
    assert sequences <= 1 + 1.05 * tokens / 4096


def test_pipeline_runs_on_no_documents(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
