"""Languages told apart by hyperdimensional profiles of letter triples.

Each letter has a random vector of signs, drawn from its code point alone. A triple of
letters is bound by multiplying its letters' vectors, rotated by two places, one place and
none; a text bundles (adds up) the vectors of its triples, a language those of its
training texts. A text goes to the language whose prototype has the largest cosine. All
training texts count: each task sums its own per language, so what is merged is one vector
per language and task.

Letters are the characters of ``str.isalpha``, lower-cased; anything between two words
counts as one blank. Null texts and texts without a letter are ``und`` with score 0, as is
everything if no language was learned. Equal cosines go to the first language in order.
Repeated rows count each time in a prototype and get equal answers. An empty table teaches
no language and gives an empty table.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketline.llm.worker import kept

DIMENSIONS = 1_024
SEED = 3
#: Prototypes that may be sent to every task: 8 KB each, far more than languages with text.
MAX_LANGUAGES = 10_000
#: Characters of a block of texts whose triples are counted together.
BLOCK = 200_000
#: Cells (texts times distinct triples) up to which a block's counts are a dense table.
CELLS = 4_000_000
#: Letters whose vectors a worker keeps, 1 KB each.
KEPT_LETTERS = 20_000
#: How sharply a lead in cosine turns into confidence.
SHARPNESS = 25.0

UNKNOWN = "und"
_LETTERS = re.compile(r"[^\W\d_]+")


def _words(text: str) -> list[str]:
    """Runs of letters. To the pattern, number signs such as ½ or Ⅷ are letters too; to isalpha not."""
    words = _LETTERS.findall(text)
    if all(map(str.isalpha, words)):
        return words
    return "".join(c if c.isalpha() else " " for c in text).split()


def _letter(code: int) -> np.ndarray:
    signs = np.random.default_rng([SEED, code]).integers(0, 2, DIMENSIONS, dtype=np.int8)
    return signs * 2 - 1


def _letters(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vectors of letters, rotated by two, one and no places."""
    known = kept(f"letters {SEED} {DIMENSIONS}", dict)
    if len(known) > KEPT_LETTERS:
        known.clear()
    for code in codes.tolist():
        if code not in known:
            known[code] = _letter(code)
    rows = np.array([known[code] for code in codes.tolist()], dtype=np.int8)
    return np.roll(rows, 2, axis=1), np.roll(rows, 1, axis=1), rows


def bundle(texts: list[str]) -> np.ndarray:
    """One vector per text: the sum of its triples' vectors."""
    words = [f" {' '.join(_words(t.lower()))} " for t in texts]
    codes = [np.frombuffer(w.encode("utf-32-le", "replace"), dtype=np.uint32) for w in words]
    owner = np.repeat(np.arange(len(texts)), [len(c) - 2 for c in codes])
    letters, place = np.unique(np.concatenate(codes), return_inverse=True)
    starts = np.cumsum([0, *(len(c) for c in codes)])
    size = len(letters)
    triples = np.concatenate(
        [
            (place[a : b - 2] * size + place[a + 1 : b - 1]) * size + place[a + 2 : b]
            for a, b in zip(starts[:-1], starts[1:], strict=True)
        ]
    )
    if size**3 <= 1 << 22:
        seen = np.flatnonzero(np.bincount(triples, minlength=size**3))
        column = np.empty(size**3, dtype=np.int64)
        column[seen] = np.arange(len(seen))
        columns = column[triples]
    else:
        seen, columns = np.unique(triples, return_inverse=True)
    first, second, third = _letters(letters)

    def bound(part: np.ndarray) -> np.ndarray:
        return first[part // size**2] * second[part // size % size] * third[part % size]

    out = np.zeros((len(texts), DIMENSIONS), dtype=np.float32)
    if len(texts) * len(seen) <= CELLS:
        counts = np.bincount(owner * len(seen) + columns, minlength=len(texts) * len(seen))
        counts = counts.reshape(len(texts), len(seen)).astype(np.float32)
        for at in range(0, len(seen), 4_096):
            out += counts[:, at : at + 4_096] @ bound(seen[at : at + 4_096]).astype(np.float32)
        return out
    # Many short texts of many letters: few cells are filled, so triples are added one by one.
    for at in range(0, len(triples), 4_096):
        rows = owner[at : at + 4_096]
        begins = np.flatnonzero(np.diff(rows, prepend=-1))
        out[rows[begins]] += np.add.reduceat(bound(triples[at : at + 4_096]), begins, axis=0, dtype=np.int32)
    return out


def _blocks(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``BLOCK`` characters, a longer text alone."""
    begun = size = 0
    for i, text in enumerate(texts):
        if i > begun and size + len(text) > BLOCK:
            yield begun, i
            begun, size = i, 0
        size += len(text)
    if texts:
        yield begun, len(texts)


def prototypes(docs: DataFrame, train: Column, lang: str = "lang", text: str = "text") -> dict[str, np.ndarray]:
    """The bundle of each language over all training texts."""

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(DIMENSIONS))
        for batch in batches:
            for name, texts in batch.groupby("lang")["text"]:
                texts = list(texts)
                for a, b in _blocks(texts):
                    # The texts of a block count as one: a prototype is their plain sum.
                    total[name] += bundle([" ".join(texts[a:b])])[0]
        for name, vector in total.items():
            yield pd.DataFrame({"lang": name, "place": np.arange(DIMENSIONS), "value": vector.round().astype("int64")})

    rows = docs.where(train & F.col(lang).isNotNull() & F.col(text).isNotNull())
    rows = rows.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))
    summed = rows.mapInPandas(sums, "lang string, place int, value long").groupBy("lang", "place").agg(F.sum("value").alias("value"))
    known: dict[str, np.ndarray] = {}
    for row in summed.toLocalIterator():
        known.setdefault(row.lang, np.zeros(DIMENSIONS))[row.place] = row.value
        if len(known) > MAX_LANGUAGES:
            raise ValueError(f"more than {MAX_LANGUAGES} languages: is {lang} a language column?")
    return {name: known[name] for name in sorted(known) if known[name].any()}


def identify(known: dict[str, np.ndarray], docs: DataFrame, text: str = "text") -> Column:
    """A column (lang_pred, score); the score is the confidence in the first language."""
    if not known:
        return F.struct(F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    names = np.array([*known, UNKNOWN], dtype=object)
    rows = np.array(list(known.values()))
    unit = (rows / np.linalg.norm(rows, axis=1, keepdims=True)).astype(np.float32)
    shared = docs.sparkSession.sparkContext.broadcast(unit)

    @F.pandas_udf("lang_pred string, score double")
    def nearest(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            pred = np.full(len(batch), len(names) - 1)
            score = np.zeros(len(batch))
            at = [i for i, t in enumerate(batch) if t and any(map(str.isalpha, t))]
            texts = [batch.iloc[i] for i in at]
            for a, b in _blocks(texts):
                vectors = bundle(texts[a:b])
                norms = np.linalg.norm(vectors, axis=1, keepdims=True)
                cosines = (vectors / np.where(norms > 0, norms, 1)) @ shared.value.T
                best = cosines.argmax(axis=1)
                lead = cosines - cosines.max(axis=1, keepdims=True)
                pred[at[a:b]] = best
                score[at[a:b]] = 1 / np.exp(SHARPNESS * lead.astype(float)).sum(axis=1)
            yield pd.DataFrame({"lang_pred": names[pred], "score": score})

    return nearest(F.col(text))
