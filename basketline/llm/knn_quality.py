"""Quality by nearest labelled neighbours in a latent-semantic space.

Terms are triples of character classes (letter cases, digits, white space, each ASCII
sign), with two more for words equal to the word before and lines equal to an earlier line.
They tell how a text is written, in any language. A bounded sample of labelled texts gives
the term weights, the latent directions (a truncated singular value decomposition) and the
labelled vectors, at most ``2 * PER_CLASS`` of them, which are broadcast. Every text is then
compared with all of these in blocks of exact cosine products, and the labels of its
``NEIGHBOURS`` nearest vote, weighted by similarity.

A null text counts as empty. A text without terms has no neighbours and gets the labels'
share in the sample, as every text does when no labelled text can be found.
"""

from __future__ import annotations

import operator
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketline.llm.common import labelled_sample
from basketline.llm.worker import kept

#: Labelled texts of either class that are learned from, at most.
PER_CLASS = 2_048
#: Terms kept, by the number of sample texts that have them.
TERMS = 1_024
DIMENSIONS = 48
NEIGHBOURS = 25
#: Power of the cosine that weights a neighbour's vote.
SHARPNESS = 16
#: Weight of the two terms that are shares already.
REPEAT_WEIGHT = 2.0
#: Texts per block of cosine products.
BLOCK = 512

SIGNS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
CLASSES = 8 + len(SIGNS)
LAST_CODE = 0x3000


def _class_table() -> np.ndarray:
    """Class of each code point up to ``LAST_CODE``, which stands for all beyond."""
    out = np.empty(LAST_CODE + 1, dtype=np.int32)
    for code in range(LAST_CODE + 1):
        char = chr(code)
        if char in SIGNS:
            out[code] = 8 + SIGNS.index(char)
        elif char == "\n":
            out[code] = 1
        elif char.isspace():
            out[code] = 0
        elif char.isalpha():
            out[code] = 3 if char.isupper() else 2
        elif char.isdigit():
            out[code] = 4
        else:
            out[code] = 5 if unicodedata.category(char)[0] == "P" else 6
    out[LAST_CODE] = 7
    return out


def _triples(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32)
    c = kept("character classes", _class_table)[np.minimum(codes, LAST_CODE)]
    return (c[:-2] * CLASSES + c[1:-1]) * CLASSES + c[2:]


def _repeats(text: str) -> tuple[float, float]:
    """Share of words equal to the word before, and of lines equal to an earlier one."""
    words = text.split()
    lines = [line for line in text.split("\n") if line]
    again = sum(map(operator.eq, words, islice(words, 1, None)))
    return again / max(1, len(words)), 1 - len(set(lines)) / len(lines) if lines else 0.0


@dataclass
class Space:
    """Term weights, latent directions and the labelled vectors with their labels."""

    terms: np.ndarray
    weights: np.ndarray
    directions: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    share: float


def _weighted(counts: np.ndarray, repeats: np.ndarray, weights: np.ndarray) -> np.ndarray:
    total = np.maximum(counts.sum(axis=1, keepdims=True), 1)
    rows = np.sqrt(np.hstack([counts / total, repeats])) * weights
    norms = np.linalg.norm(rows, axis=1, keepdims=True)
    return (rows / np.where(norms > 0, norms, 1)).astype(np.float32)


def _unit(rows: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(norms > 1e-9, norms, 1)


def fit(sample: DataFrame) -> Space | None:
    """The space of a bounded sample of (text, label); None when it has no term."""

    def terms_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text, label in zip(batch["text"], batch["label"], strict=True):
                ids, counts = np.unique(_triples(text), return_counts=True)
                rows.append((ids, counts, list(_repeats(text)), label))
            yield pd.DataFrame(rows, columns=["ids", "counts", "repeats", "label"])

    schema = "ids array<int>, counts array<long>, repeats array<double>, label int"
    found = sample.mapInPandas(terms_of, schema).collect()
    # The order of rows depends on the cluster; sorted, the sums below do not.
    found.sort(key=lambda r: (r.label, r.ids, r.counts))
    if not any(r.ids for r in found):
        return None
    terms, texts = np.unique(np.concatenate([np.asarray(r.ids, int) for r in found]), return_counts=True)
    terms = np.sort(terms[np.lexsort((terms, -texts))[:TERMS]])
    column = np.full(CLASSES**3, len(terms))
    column[terms] = np.arange(len(terms))
    counts = np.zeros((len(found), len(terms) + 1))
    for row, r in zip(counts, found, strict=True):
        np.add.at(row, column[np.asarray(r.ids, int)], r.counts)
    counts = counts[:, :-1]
    repeats = np.array([r.repeats for r in found])
    have = (counts > 0).sum(axis=0)
    weights = np.concatenate([np.log((1 + len(found)) / (1 + have)) + 0.1, [REPEAT_WEIGHT] * 2])
    rows = _weighted(counts, repeats, weights).astype(float)
    _, vectors = np.linalg.eigh(rows.T @ rows)
    directions = vectors[:, ::-1][:, :DIMENSIONS].astype(np.float32)
    labels = np.array([r.label for r in found], dtype=np.float32)
    return Space(terms, weights, directions, _unit(rows @ directions).astype(np.float32), labels, float(labels.mean()))


def score(space: Space | None, docs: DataFrame, text: str = "text") -> Column:
    """A column with the votes for label 1, from 0 to 1."""
    if space is None:
        return F.lit(0.5)
    shared = docs.sparkSession.sparkContext.broadcast(vars(space))

    @F.pandas_udf("double")
    def votes(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        s = Space(**shared.value)
        column = np.full(CLASSES**3, len(s.terms))
        column[s.terms] = np.arange(len(s.terms))
        nearest = min(NEIGHBOURS, len(s.labels))

        def of(texts: list[str | None]) -> np.ndarray:
            counts = np.zeros((len(texts), len(s.terms)), dtype=np.float32)
            repeats = np.zeros((len(texts), 2), dtype=np.float32)
            for i, value in enumerate(texts):
                if value:
                    counts[i] = np.bincount(column[_triples(value)], minlength=len(s.terms) + 1)[:-1]
                    repeats[i] = _repeats(value)
            latent = _unit(_weighted(counts, repeats, s.weights) @ s.directions)
            cosines = np.maximum(latent @ s.vectors.T, 0)
            best = np.argpartition(cosines, -nearest, axis=1)[:, -nearest:]
            weight = np.take_along_axis(cosines, best, axis=1).astype(float) ** SHARPNESS
            total = weight.sum(axis=1)
            share = (weight * s.labels[best]).sum(axis=1) / np.where(total > 0, total, 1)
            return np.where(total > 0, share, s.share)

        for batch in batches:
            texts = list(batch)
            parts = [of(texts[i : i + BLOCK]) for i in range(0, len(texts), BLOCK)]
            yield pd.Series(np.concatenate(parts) if parts else [], dtype="float64")

    return votes(F.col(text))


def learn(
    docs: DataFrame, labels: DataFrame, train: Column, label: str = "quality", per_class: int = PER_CLASS, seed: int = 9
) -> Space | None:
    """The space of a labelled sample; ``train`` says which label rows may be used."""
    return fit(labelled_sample(docs, labels, label, train, per_class, seed))
