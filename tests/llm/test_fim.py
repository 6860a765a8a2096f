"""Fill-in-middle outputs by the definition, and round trips."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from basketline.llm import queries, swar_fim

from .conftest import prose

LINE = re.compile(r"[^\n]*\n|[^\n]+")
ODD = [
    None, "", "\n", "\n\n\n", "a", "a\n", "a\nb", "\na", "é\nñandú\n日本語\n\n🙂 x", "a <P> b\nc", "<S>", "<M>\n", "<", "<\n<\n>",
    "P>\nS>\nM>", "<S\n<M\n<P", "\r\n\r\n", "x\x00y\n\x00", "a b\nc\x85d\x0be", "1234567\n", "12345678\n9", "\n" * 50,
    "ends in a sign <\n", ">" * 9 + "\n" + "<" * 9,
]


def plain(doc_id, text):
    text = text or ""
    units = LINE.findall(text)
    n = len(units)
    digest = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")):
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    front, middle, rest = ("".join(u) for u in (units[:a], units[a:b], units[b:]))
    if h[3] % 100 < 50:
        return n, "spm", len(front), len(middle), f"<S>{rest}<P>{front}<M>{middle}"
    return n, "psm", len(front), len(middle), f"<P>{front}<S>{rest}<M>{middle}"


def check(docs):
    done = swar_fim.with_fim(docs)
    back = swar_fim.restored(F.col("fim.form"), F.col("fim.output")).alias("back")
    rows = done.select("doc_id", "text", "fim.*", back).collect()
    for r in rows:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == plain(r.doc_id, r.text)
        assert r.back == (r.text or "")
    return rows


def test_odd_texts(spark, edge_docs, clashing_docs, no_docs):
    odd = [(i, t) for i in range(60) for t in ODD]
    rows = check(spark.createDataFrame(odd, "doc_id long, text string").repartition(3))
    assert {r.form for r in rows} == {"plain", "psm", "spm"}
    assert len(check(edge_docs)) == edge_docs.count()
    assert swar_fim.with_fim(clashing_docs).columns == [*clashing_docs.columns, "fim"]
    check(clashing_docs)
    assert swar_fim.with_fim(no_docs).count() == 0


@pytest.mark.parametrize("size", [1, 64])
def test_small_blocks_give_the_same(spark, edge_docs, monkeypatch, size):
    monkeypatch.setattr(swar_fim, "BLOCK_BYTES", size)
    check(edge_docs)
    rng = random.Random(size)
    texts = [(i, "".join(rng.choice("ab\né🙂 ") for _ in range(rng.randrange(40)))) for i in range(400)]
    check(spark.createDataFrame(texts, "doc_id long, text string"))


def test_rank_and_select_by_brute_force():
    rng = np.random.default_rng(3)
    for n in (0, 1, 7, 8, 9, 63, 64, 65, 1000):
        data = rng.choice(np.array([10, 9, 11, 138, 0, 255, 128, 65], dtype=np.uint8), n)
        marks = swar_fim.Marks(swar_fim.equal_marks(swar_fim.as_words(data), 10))
        places = np.flatnonzero(data == 10)
        assert marks.select(np.arange(1, len(places) + 1)).tolist() == places.tolist()
        at = np.arange(n + 1)
        assert marks.rank(at).tolist() == [int((data[:k] == 10).sum()) for k in at]
        points = swar_fim.Marks(swar_fim.point_marks(swar_fim.as_words(data)))
        assert points.rank(at).tolist() == [int(((data[:k] & 0xC0) != 0x80).sum()) for k in at]


def test_shares_and_other_separators(spark):
    docs = spark.createDataFrame([(i, prose(i, 30) + "\nmore\n") for i in range(2000)], "doc_id long, text string")
    signs = ("<|pre|>", "<|suf|>", "<|mid|>")
    done = swar_fim.with_fim(docs, percent=60, spm_percent=20, signs=signs, seed=1)
    back = swar_fim.restored(F.col("fim.form"), F.col("fim.output"), signs)
    rows = done.select("text", "fim.form", back.alias("back")).collect()
    assert all(r.text == r.back for r in rows)
    forms = Counter(r.form for r in rows)
    assert abs(forms["plain"] - 800) < 100 and abs(forms["spm"] - 240) < 60


def test_query(spark, tiny_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{tiny_dir}/documents.parquet").select("doc_id", "text").collect()}
    rows = queries.QUERIES["op11_swar_fim"](spark, tiny_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        n, form, front, middle, output = plain(r.doc_id, texts[r.doc_id])
        want = (r.doc_id, n, form, front, middle, sha(output), sha(texts[r.doc_id] or ""))
        assert tuple(r) == want


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()
