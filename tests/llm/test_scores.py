"""Toxicity, language and quality: exact parts by brute force, the rest by held-out rows."""

import itertools
import math
import random
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from basketline.llm import hd_langid, knn_quality, toxicity_crf
from basketline.llm.common import held_out, labelled_sample

from .conftest import prose

def everything():
    return F.lit(True)


def insulted(i):
    """Every third text has insults, some inflected."""
    rng = random.Random(i)
    words = prose(i, 40).split()
    if i % 3 == 0:
        for _ in range(3):
            words.insert(rng.randint(0, len(words)), rng.choice(["grobbler", "snarkling", "snarkly", "vilest"]))
    return " ".join(words)


@pytest.fixture(scope="module")
def labelled(spark):
    docs = [(i, insulted(i) if i % 2 else insulted(i).upper().replace(" ", "!! ") if i % 5 == 0 else insulted(i)) for i in range(600)]
    labels = [(i, int(not (i % 5 == 0 and i % 2 == 0)), int(i % 3 == 0)) for i in range(600)]
    return (
        spark.createDataFrame(docs, "doc_id long, text string").cache(),
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int").cache(),
    )


def test_marginals_are_exact():
    field = toxicity_crf.Field({}, -2.0, 0.3, -0.2, 1.1)
    chain = toxicity_crf.Chain(field)
    tokens, n = [(1, 0.7), (2, -1.5), (6, 2.0)], 9
    potentials = [dict(tokens).get(i, field.bias) for i in range(n)]
    step = [[0.0, field.enter], [field.leave, field.stay]]
    total, toxic = 0.0, [0.0] * n
    for states in itertools.product((0, 1), repeat=n):
        score = sum(step[a][b] for a, b in zip((0, *states), states, strict=False))
        weight = math.exp(score + sum(p for p, s in zip(potentials, states, strict=True) if s))
        total += weight
        for i, s in enumerate(states):
            toxic[i] += weight * s
    assert chain.marginals(tokens, n) == pytest.approx([toxic[i] / total for i, _ in tokens])


def test_toxic_texts_and_their_spans(spark, labelled):
    docs, labels = labelled
    apart = held_out("doc_id", 4, 2)
    field = toxicity_crf.learn(docs, labels, ~apart)
    rows = docs.where(apart).select("doc_id", "text", toxicity_crf.tag(field, docs).alias("f")).collect()
    assert len(rows) > 100
    for row in rows:
        assert (row.f.score >= 0.3) == (row.doc_id % 3 == 0)
        found = " ".join(row.text[s.start : s.end].lower() for s in row.f.spans)
        said = sum(row.text.lower().count(w) for w in ("grobbler", "snarkl", "vilest"))
        assert sum(found.count(w) for w in ("grobbler", "snarkl", "vilest")) == said


def test_scores_do_not_depend_on_partitions(spark, labelled):
    docs, labels = labelled
    got = []
    for n in (1, 5):
        field = toxicity_crf.learn(docs.repartition(n), labels.repartition(n), everything(), per_class=50)
        space = knn_quality.learn(docs.repartition(n), labels.repartition(n), everything(), per_class=50)
        scored = docs.select("doc_id", toxicity_crf.tag(field, docs)["score"], knn_quality.score(space, docs))
        got.append(sorted(map(tuple, scored.collect())))
    assert np.allclose(got[0], got[1])


def test_quality_by_neighbours(spark, labelled):
    docs, labels = labelled
    apart = held_out("doc_id", 5, 0)
    space = knn_quality.learn(docs, labels, ~apart)
    rows = docs.where(apart).select("doc_id", knn_quality.score(space, docs).alias("s")).collect()
    for row in rows:
        assert (row.s >= 0.3) == (not (row.doc_id % 5 == 0 and row.doc_id % 2 == 0))


def test_votes_equal_all_pairs(spark, labelled):
    docs, labels = labelled
    space = knn_quality.learn(docs, labels, everything(), per_class=60)
    assert len(space.labels) <= 120
    rows = docs.limit(20).select("text", knn_quality.score(space, docs).alias("s")).collect()
    column = {t: k for k, t in enumerate(space.terms.tolist())}
    for row in rows:
        counts = np.zeros((1, len(column)))
        for t in knn_quality._triples(row.text).tolist():
            if t in column:
                counts[0, column[t]] += 1
        own = knn_quality._weighted(counts, np.array([knn_quality._repeats(row.text)]), space.weights)[0]
        latent = own @ space.directions
        cosines = [float(np.dot(latent, v) / np.linalg.norm(latent)) for v in space.vectors]
        best = sorted(range(len(cosines)), key=lambda k: -cosines[k])[: knn_quality.NEIGHBOURS]
        weight = [max(cosines[k], 0) ** knn_quality.SHARPNESS for k in best]
        want = sum(w for w, k in zip(weight, best, strict=True) if space.labels[k]) / sum(weight)
        assert row.s == pytest.approx(want, abs=0.02)


def test_bundles_are_sums_of_bound_triples():
    text = "Ab, c"
    padded = " ab c "
    want = np.zeros(hd_langid.DIMENSIONS)
    for i in range(len(padded) - 2):
        a, b, c = (hd_langid._letter(ord(x)).astype(int) for x in padded[i : i + 3])
        want += np.roll(a, 2) * np.roll(b, 1) * c
    assert (hd_langid.bundle([text, "zz"])[0] == want).all()


def test_many_letters_use_the_other_count():
    text = "".join(chr(0x4E00 + i) for i in range(400))
    assert hd_langid.bundle([text])[0].any()
    assert np.allclose(hd_langid.bundle([text, "ab"])[1], hd_langid.bundle(["ab"])[0])


def plain_bundle(text):
    letters = [c if c.isalpha() else " " for c in text.lower()]
    padded = f" {' '.join(''.join(letters).split())} "
    vectors = [hd_langid._letter(ord(c)).astype(int) for c in padded]
    out = np.zeros(hd_langid.DIMENSIONS)
    for a, b, c in zip(vectors, vectors[1:], vectors[2:], strict=False):
        out += np.roll(a, 2) * np.roll(b, 1) * c
    return out


def test_prototypes_cosines_and_scores_by_brute_force(spark):
    langs = ("en", "de")
    rows = [(i, prose(i, 8, langs[i % 2]) + ("½ ²x Ⅷ" if i % 5 == 0 else ""), langs[i % 2]) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1)
    known = hd_langid.prototypes(docs, F.col("doc_id") < 30)
    assert sorted(known) == sorted(langs)
    for name in langs:
        # The texts of a block are joined by a blank.
        assert (known[name] == plain_bundle(" ".join(t for i, t, lang in rows if i < 30 and lang == name))).all()
    found = {r.doc_id: r.f for r in docs.select("doc_id", hd_langid.identify(known, docs).alias("f")).collect()}
    for i, text, _ in rows:
        own = plain_bundle(text)
        cosines = {n: own @ v / np.linalg.norm(own) / np.linalg.norm(v) for n, v in known.items()}
        best = max(cosines, key=cosines.get)
        want = 1 / sum(math.exp(hd_langid.SHARPNESS * (c - cosines[best])) for c in cosines.values())
        assert found[i].lang_pred == best and found[i].score == pytest.approx(want, abs=1e-3)


def test_number_signs_are_no_letters(spark):
    known = {"en": hd_langid.bundle(["some words"])[0]}
    texts = ["½", "²", "Ⅷ", "③", "123 ½", "_", "५", "x½", "Ⅷa", "ª", "漢"]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    for row in docs.select("text", hd_langid.identify(known, docs)["lang_pred"].alias("l")).collect():
        assert (row.l == "und") == (not any(c.isalpha() for c in row.text)), row.text


def test_many_short_texts_of_many_letters():
    rng = random.Random(4)
    texts = ["".join(chr(0x4E00 + rng.randrange(20_000)) for _ in range(20)) for _ in range(9_000)]
    hd_langid.bundle(texts[:300])
    tracemalloc.start()
    out = hd_langid.bundle(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 500 << 20
    for i in (0, 205, 206, 4_567, 8_999):
        assert (out[i] == plain_bundle(texts[i])).all()
    assert (hd_langid.bundle([*texts[:300], "a"])[:300] == out[:300]).all()


def test_sample_keeps_its_bound(spark):
    hot = [(1, None if i % 3 else f"hot {i}") for i in range(50_000)]
    docs = spark.createDataFrame([*hot, *((i, f"text {i}") for i in range(2, 60)), (None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(None, 1)], "doc_id long, toxic int")
    for per_class in (5, 100):
        sample = [labelled_sample(d, labels, "toxic", everything(), per_class, 1).collect() for d in (docs, docs.repartition(7))]
        assert sorted(sample[0]) == sorted(sample[1])
        assert len(sample[0]) <= 2 * per_class
    assert sum(r.text in {t or "" for _, t in hot} for r in sample[0]) == 1 and len(sample[0]) == 59


def test_words_behind_the_twelfth_window_are_learned(spark):
    rows = []
    for i in range(200):
        words = prose(i, 1_500).split()
        if i % 2:
            # Twelve windows around one insult, the other behind them.
            for k in range(13):
                words[20 + 60 * k] = "grobbler"
            for k in range(8):
                words[900 + 60 * k] = "vilest"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, toxic int")
    field = toxicity_crf.learn(docs, labels, everything())
    assert any(f.startswith("vile") and weight > 0 for f, weight in field.weights.items())


def test_languages(spark):
    docs = spark.createDataFrame(
        [(i, prose(i, 30, "de" if i % 2 else "en"), "de" if i % 2 else "en") for i in range(300)],
        "doc_id long, text string, lang string",
    )
    apart = held_out("doc_id", 4, 2)
    known = hd_langid.prototypes(docs, ~apart)
    assert list(known) == ["de", "en"]
    rows = docs.where(apart).select("lang", hd_langid.identify(known, docs).alias("f")).collect()
    assert sum(r.lang == r.f.lang_pred for r in rows) >= 0.98 * len(rows)
    assert all(0 <= r.f.score <= 1 for r in rows)


def test_edge_rows(spark, edge_docs, no_docs, clashing_docs, labelled):
    _, labels = labelled
    field = toxicity_crf.learn(*labelled, everything(), per_class=100)
    space = knn_quality.learn(*labelled, everything(), per_class=100)
    known = hd_langid.prototypes(edge_docs, everything())
    for docs in (edge_docs, clashing_docs, no_docs):
        out = docs.select(
            "doc_id",
            "text",
            toxicity_crf.tag(field, docs).alias("t"),
            knn_quality.score(space, docs).alias("q"),
            hd_langid.identify(known, docs).alias("l"),
        ).collect()
        assert len(out) == docs.count()
        for row in out:
            assert 0 <= row.t.score <= 1 and 0 <= row.q <= 1 and 0 <= row.l.score <= 1
            letters = any(c.isalpha() for c in row.text or "")
            assert (row.l.lang_pred == "und") == (not letters)
        by_text = {}
        for row in out:
            assert by_text.setdefault(row.text, row.t.score) == row.t.score


def test_nothing_to_learn_from(spark, edge_docs, no_docs, labelled):
    _, labels = labelled
    nothing = labels.where("false")
    for docs in (edge_docs, no_docs):
        for given in (nothing, labels):
            if docs is edge_docs and given is labels:
                continue
            field, space = toxicity_crf.learn(docs, given, everything()), knn_quality.learn(docs, given, everything())
            assert field is None and space is None
            known = hd_langid.prototypes(docs.where("false"), everything())
            found = docs.select(
                toxicity_crf.tag(field, docs)["score"].alias("t"),
                knn_quality.score(space, docs).alias("q"),
                hd_langid.identify(known, docs)["lang_pred"].alias("l"),
            )
            assert {tuple(r) for r in found.collect()} <= {(0.0, 0.5, "und")}


def test_held_out_ids(spark):
    import zlib

    rows = spark.createDataFrame([(i,) for i in [*range(50), None]], "doc_id long")
    for row in rows.select("doc_id", held_out("doc_id", 4, 2).alias("h")).collect():
        assert row.h == (row.doc_id is not None and zlib.crc32(str(row.doc_id).encode()) % 4 == 2)
