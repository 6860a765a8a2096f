"""Toxic spans by a linear-chain conditional random field; documents by its marginals.

Tokens are runs of letters with two states, clean and toxic. What a token shows the model is
its lower-case word and the word's beginnings, since insults are inflected. Documents have
labels, tokens do not, so token labels come from them: a token of a toxic text is toxic if
one of its features is many times as common in toxic texts as in clean ones. The field is
then fitted to these labels by gradient ascent on the exact likelihood.

Forward and backward sums give each token's probability of being toxic. Most tokens have
none of the learned features and all look alike, so runs of them are crossed by a power of
one 2 x 2 matrix: exact, and as cheap for long texts as for short ones. Spans are runs of
tokens with probability 0.5 or more; a document's score is a logistic function of its
largest and its summed probability, at the share of toxic labels in the training rows.

It learns from at most ``2 * PER_CLASS`` labelled texts, chosen by a hash of their ids, and
scores every text whole. A null text counts as empty; a text without a learned feature gets
the score of its length; without toxic or clean training texts all scores are 0. Equal
texts get equal scores and spans. An empty table gives an empty table.
"""

from __future__ import annotations

import heapq
import math
import re
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketline.llm.common import labelled_sample
from basketline.llm.worker import kept
from basketline.staging import stage

#: Labelled texts of either class that are learned from, at most.
PER_CLASS = 3_000
#: Lengths of the word beginnings that are features.
BEGINNINGS = (3, 4, 5, 6)
#: Features kept, and what they need: toxic texts that have them, and how many times as
#: common they are there; the second ratio makes a token of a toxic text a toxic one.
FEATURES = 4_000
MIN_TEXTS = 4
MIN_RATIO = 4.0
TOKEN_RATIO = 25.0
#: Windows of tokens to fit the field to: tokens around a feature, length, number per text,
#: chosen by a hash from those of the whole text.
MARGIN, WINDOW, WINDOWS, SEED = 6, 48, 12, 5
STEPS, RATE, PENALTY = 120, 0.15, 0.02
#: Words that a worker keeps the potentials of, and letters of such a word.
CACHE_SIZE = 800_000
CACHED_CHARS = 40

_WORD = re.compile(r"[^\W\d_]+")
SPANS = "array<struct<start: int, end: int, probability: double>>"


def features(word: str) -> list[str]:
    """The word, marked as whole, and its beginnings."""
    word = word.lower()
    return [f"{word} ", *(word[:n] for n in BEGINNINGS if len(word) >= n)]


@dataclass
class Field:
    """Learned potentials; the clean state's are 0, as is that of staying clean."""

    weights: dict[str, float]
    bias: float
    enter: float
    leave: float
    stay: float
    #: Of the document score: largest probability, summed probability, length, constant.
    document: tuple[float, float, float, float] = (0.0, 0.0, 0.0, -20.0)


class Chain:
    """Exact marginals of texts under a field."""

    def __init__(self, field: Field):
        self.field = field
        self.step = np.exp(np.array([[0.0, field.enter], [field.leave, field.stay]]))
        plain = self.step * np.array([1.0, math.exp(field.bias)])
        self.plain = plain / np.abs(np.linalg.eigvals(plain)).max()
        self.powers: dict[int, tuple] = {}

    def across(self, gap: int) -> tuple:
        """Past ``gap`` plain tokens: the matrix up to the next token, and the row sums."""
        if gap not in self.powers:
            if len(self.powers) > 100_000:
                self.powers.clear()
            power = np.linalg.matrix_power(self.plain, gap)
            self.powers[gap] = (*(power @ self.step).ravel().tolist(), *power.sum(axis=1).tolist())
        return self.powers[gap]

    def marginals(self, tokens: list[tuple[int, float]], n: int) -> list[float]:
        """Probability of the toxic state at (place, potential) tokens of a text of ``n``."""
        before, clean, toxic, last = [], 1.0, 0.0, -1
        for place, potential in tokens:
            cc, ct, tc, tt, _, _ = self.across(place - last - 1)
            up = math.exp(min(potential, 50.0))
            clean, toxic = clean * cc + toxic * tc, (clean * ct + toxic * tt) * up
            total = clean + toxic
            clean, toxic, last = clean / total, toxic / total, place
            before.append((clean, toxic))
        *_, after_clean, after_toxic = self.across(n - last - 1)
        out = [0.0] * len(tokens)
        for k in range(len(tokens) - 1, -1, -1):
            clean, toxic = before[k][0] * after_clean, before[k][1] * after_toxic
            out[k] = toxic / (clean + toxic)
            if k:
                place, potential = tokens[k]
                cc, ct, tc, tt, _, _ = self.across(place - tokens[k - 1][0] - 1)
                up = after_toxic * math.exp(min(potential, 50.0))
                after_clean, after_toxic = cc * after_clean + ct * up, tc * after_clean + tt * up
                total = after_clean + after_toxic
                after_clean, after_toxic = after_clean / total, after_toxic / total
        return out


class _Potentials(dict):
    """Potential of each word seen; plain words share the bias."""

    def __init__(self, field: Field):
        super().__init__()
        self.field = field

    def __missing__(self, word: str) -> float:
        weights = self.field.weights
        own = [weights[f] for f in features(word) if f in weights]
        value = self.field.bias + sum(own) if own else None
        if len(word) <= CACHED_CHARS:
            if len(self) >= CACHE_SIZE:
                self.clear()
            self[word] = value
        return value


def _feature_table(sample: DataFrame) -> dict[str, float]:
    """Features of toxic texts with the ratio of their shares in toxic and clean texts."""

    def texts_with(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: dict[int, Counter[str]] = {0: Counter(), 1: Counter()}
        for batch in batches:
            for text, label in zip(batch["text"], batch["label"], strict=True):
                counts[label].update({f for word in set(_WORD.findall(text)) for f in features(word)})
        rows = [(feature, label, n) for label, found in counts.items() for feature, n in found.items()]
        for at in range(0, len(rows), 100_000):
            yield pd.DataFrame(rows[at : at + 100_000], columns=["feature", "label", "n"])

    size = {r.label: r.n for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if not size.get(0) or not size.get(1):
        return {}
    partial = sample.mapInPandas(texts_with, "feature string, label int, n long")
    counted = partial.groupBy("feature").agg(
        F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).alias("toxic"),
        F.sum(F.when(F.col("label") == 0, F.col("n")).otherwise(0)).alias("clean"),
    )
    ratio = (F.col("toxic") / size[1]) / ((F.col("clean") + 0.5) / size[0])
    kept_ = (
        counted.where(F.col("toxic") >= MIN_TEXTS)
        .withColumn("ratio", ratio)
        .where(F.col("ratio") >= MIN_RATIO)
        .orderBy(F.desc(F.col("toxic") * F.log("ratio")), "feature")
        .limit(FEATURES)
    )
    return {r.feature: r.ratio for r in kept_.select("feature", "ratio").collect()}


def _windows(sample: DataFrame, ratios: dict[str, float]) -> list:
    """Token windows: for each token that has features, its place, them and its label."""
    shared = sample.sparkSession.sparkContext.broadcast(ratios)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = shared.value
        for batch in batches:
            rows = []
            for text, label in zip(batch["text"], batch["label"], strict=True):
                words = _WORD.findall(text)
                found = [(i, fs) for i, w in enumerate(words) if (fs := [f for f in features(w) if f in table])]
                begins: list[int] = []
                for at, _ in [*found, (len(words) // 2, [])]:
                    end = begins[-1] + WINDOW if begins else 0
                    if at >= end:
                        begins.append(max(end, at - MARGIN))
                if len(begins) > WINDOWS:
                    begins = heapq.nsmallest(WINDOWS, begins, key=lambda b: zlib.crc32(f"{SEED}:{len(words)}:{b}".encode()))
                for begin in begins:
                    end = begin + WINDOW
                    inside = found[bisect_left(found, (begin,)) : bisect_left(found, (end,))]
                    own = [(i - begin, fs) for i, fs in inside]
                    toxic = [bool(label) and max(map(table.get, fs)) >= TOKEN_RATIO for _, fs in own]
                    rows.append((min(end, len(words)) - begin, [i for i, _ in own], [fs for _, fs in own], toxic))
            if rows:
                yield pd.DataFrame(rows, columns=["n", "places", "features", "toxic"])

    schema = "n int, places array<int>, features array<array<string>>, toxic array<boolean>"
    rows = sample.mapInPandas(cut, schema).collect()
    return sorted((tuple(r) for r in rows if r.n > 0), key=repr)


def _fit_field(windows: list, names: list[str]) -> Field:
    """Ascent on the likelihood of all windows at once; padding takes no part."""
    index = {name: k for k, name in enumerate(names)}
    n = np.array([w[0] for w in windows])
    cell, feature, truth = [], [], np.zeros((len(windows), WINDOW))
    for row, (_, places, lists, toxic) in enumerate(windows):
        for place, fs, is_toxic in zip(places, lists, toxic, strict=True):
            truth[row, place] = is_toxic
            cell += [row * WINDOW + place] * len(fs)
            feature += [index[f] for f in fs]
    cell, feature = np.array(cell, dtype=np.int64), np.array(feature, dtype=np.int64)
    inside = np.arange(WINDOW) < n[:, None]
    follows = inside[:, 1:]
    was = np.hstack([np.zeros((len(windows), 1)), truth[:, :-1]])
    # Parameters: the weights of the features, then bias, enter, leave, stay.
    size = len(names)
    theta = np.concatenate([np.zeros(size), [-3.0, 0.0, 0.0, 0.0]])
    moment, square = np.zeros_like(theta), np.zeros_like(theta)

    def observed() -> np.ndarray:
        own = np.bincount(feature, truth.ravel()[cell], size)
        pairs = [(1 - was) * truth, was * (1 - truth), was * truth]
        return np.concatenate([own, [truth[inside].sum()], [p[inside].sum() for p in pairs]])

    def expected() -> np.ndarray:
        up = np.bincount(cell, theta[feature], inside.size).reshape(inside.shape) + theta[size]
        up = np.exp(np.clip(up, -30, 30))
        step = np.exp(np.array([[0.0, theta[size + 1]], [theta[size + 2], theta[size + 3]]]))
        forward, backward = np.zeros((WINDOW, len(n), 2)), np.ones((WINDOW, len(n), 2))
        state = np.tile([1.0, 0.0], (len(n), 1))
        for t in range(WINDOW):
            state = state @ step
            state[:, 1] *= up[:, t]
            state /= state.sum(axis=1, keepdims=True)
            forward[t] = state
        for t in range(WINDOW - 2, -1, -1):
            ahead = backward[t + 1].copy()
            ahead[:, 1] *= up[:, t + 1]
            state = ahead @ step.T
            state /= state.sum(axis=1, keepdims=True)
            backward[t] = np.where(follows[:, t, None], state, 1.0)
        both = forward * backward
        toxic = (both[..., 1] / both.sum(axis=2)).T * inside
        pairs = np.zeros((2, 2))
        first = np.stack([np.ones(len(n)), step[0, 1] / step[0, 0] * up[:, 0]], axis=1) * backward[0]
        pairs[0] += (first / first.sum(axis=1, keepdims=True))[inside[:, 0]].sum(axis=0)
        for t in range(1, WINDOW):
            ahead = backward[t].copy()
            ahead[:, 1] *= up[:, t]
            joint = forward[t - 1][:, :, None] * step * ahead[:, None, :]
            joint /= joint.sum(axis=(1, 2), keepdims=True)
            pairs += joint[inside[:, t]].sum(axis=0)
        own = np.bincount(feature, toxic.ravel()[cell], size)
        return np.concatenate([own, [toxic.sum()], [pairs[0, 1], pairs[1, 0], pairs[1, 1]]])

    target = observed()
    scale = np.sqrt(len(windows))
    for k in range(1, STEPS + 1):
        gradient = (target - expected() - PENALTY * theta) / scale
        moment = 0.9 * moment + 0.1 * gradient
        square = 0.98 * square + 0.02 * gradient**2
        theta = theta + RATE * (moment / (1 - 0.9**k)) / (np.sqrt(square / (1 - 0.98**k)) + 1e-8)
    weights = {name: float(theta[k]) for name, k in index.items() if abs(theta[k]) > 1e-3}
    return Field(weights, *map(float, theta[size:]))


def _document_parts(shared, text: Column) -> Column:
    """A column (largest, summed, n_words, spans) from the marginals of each text."""

    @F.pandas_udf(f"largest double, summed double, n_words long, spans {SPANS}")
    def parts(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        field = Field(**shared.value)
        chain = Chain(field)
        model, potentials = kept("toxic potentials", lambda: [None, None])
        if model != field:
            potentials = _Potentials(field)
            kept("toxic potentials", list)[:] = [field, potentials]
        for batch in batches:
            rows = []
            for value in batch:
                words = _WORD.findall(value) if value else []
                tokens = [(i, u) for i, u in enumerate(map(potentials.__getitem__, words)) if u is not None]
                found = chain.marginals(tokens, len(words)) if tokens else []
                spans = []
                if found and max(found) >= 0.5:
                    # Plain tokens beside these may belong to a span, so they are looked at too.
                    near = {j: field.bias for i, _ in tokens for j in (i - 1, i + 1) if 0 <= j < len(words)}
                    near |= dict(tokens)
                    order = sorted(near.items())
                    wide = chain.marginals(order, len(words))
                    where = [m.span() for m in _WORD.finditer(value)]
                    last = -2
                    for (i, _), p in zip(order, wide, strict=True):
                        if p >= 0.5:
                            if i == last + 1:
                                spans[-1] = (spans[-1][0], where[i][1], max(spans[-1][2], p))
                            else:
                                spans.append((*where[i], p))
                            last = i
                rows.append((max(found, default=0.0), sum(found), len(words), spans))
            yield pd.DataFrame(rows, columns=["largest", "summed", "n_words", "spans"])

    return parts(text)


def _columns(largest, summed, n_words) -> np.ndarray:
    lean = np.clip(largest, 1e-6, 1 - 1e-6)
    return np.stack([np.log(lean / (1 - lean)), np.log1p(summed), np.log1p(n_words), np.ones(len(lean))], axis=1)


def _fit_documents(rows: list, share: float) -> tuple[float, float, float, float]:
    """A logistic regression on the sample, moved to the share of toxic labels overall."""
    rows = sorted(rows)
    x = _columns(*np.array([r[1:] for r in rows], dtype=float).T)
    y = np.array([r[0] for r in rows], dtype=float)
    beta = np.zeros(4)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        curve = (x.T * (p * (1 - p) + 1e-6)) @ x + 1e-2 * np.eye(4)
        beta = beta + np.linalg.solve(curve, x.T @ (y - p) - 1e-2 * beta)
    mean = y.mean()
    beta[3] += math.log(share / (1 - share)) - math.log(mean / (1 - mean))
    return tuple(beta.tolist())


def learn(
    docs: DataFrame, labels: DataFrame, train: Column, label: str = "toxic", per_class: int = PER_CLASS, seed: int = 1
) -> Field | None:
    """The field of a labelled sample; ``train`` says which label rows may be used."""
    sample = stage(labelled_sample(docs, labels, label, train, per_class, seed), "toxic-sample")
    ratios = _feature_table(sample)
    if not ratios:
        return None
    windows = _windows(sample, ratios)
    if not windows:
        return None
    field = _fit_field(windows, sorted(ratios))
    shared = sample.sparkSession.sparkContext.broadcast(vars(field))
    parts = sample.select("label", _document_parts(shared, F.col("text")).alias("p"))
    rows = [tuple(r) for r in parts.select("label", "p.largest", "p.summed", "p.n_words").collect()]
    share = labels.where(train & F.col(label).isin(0, 1)).agg(F.avg(label)).first()[0]
    field.document = _fit_documents(rows, min(max(share, 1e-3), 1 - 1e-3))
    return field


def tag(field: Field | None, docs: DataFrame, text: str = "text") -> Column:
    """A column (score, spans): 0 to 1, and the character ranges of toxic spans."""
    if field is None:
        return F.struct(F.lit(0.0).alias("score"), F.array().cast(SPANS).alias("spans"))
    shared = docs.sparkSession.sparkContext.broadcast(vars(field))
    parts = _document_parts(shared, F.col(text))
    a, b, c, d = field.document
    lean = F.greatest(F.least(parts["largest"], F.lit(1 - 1e-6)), F.lit(1e-6))
    logit = a * F.log(lean / (1 - lean)) + b * F.log1p(parts["summed"]) + c * F.log1p(parts["n_words"]) + d
    return F.struct((1 / (1 + F.exp(-logit))).alias("score"), parts["spans"].alias("spans"))
