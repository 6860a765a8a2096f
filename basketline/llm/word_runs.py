"""Periodic runs of words in texts, by seeds on diagonals that are extended.

A run of period q is a stretch in which words q apart are equal, and that no neighbouring word
extends. On the diagonal of lag q (word i against word i + q) it is a row of matches. A run of at
least ``POWER * q`` and ``LEAST`` words has a guaranteed overlap with itself of at least
max(LEAST, POWER * q) - q matches. So k-grams with k no larger than that overlap are seeds: every
run holds one at both i and i + q.

Seeds of one length would be too weak for long periods and too strong for short ones. Lags are
therefore taken in bands: the k-grams of a band are as long as the overlap guaranteed for its
smallest lag, and its largest lag is k. Inside a run whose smallest period is q <= k, a k-gram
comes again after exactly q words and never sooner. So the occurrence pairs that matter are those
of neighbouring occurrences, which are as many as the words, however often a word is repeated.
K-grams have exact names, made by joining the names of shorter ones, not hashes. A text without a
repeated k-gram is left out of the longer bands.

A seed is extended to both sides along its diagonal. A table holds, for each lag, how far its
diagonals have been covered; seeds in the covered part are dropped, so no stretch is extended
twice. Stretches shorter than the run's least length are no runs.

Null texts and texts without a word have no run. Equal rows give equal rows, ids play no part. A
task holds a block of texts, or one longer text. An empty table gives an empty table; other columns
are kept, except the struct's own name, which is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A run has at least so many words, and so many periods.
LEAST, POWER = 6, 4
#: Bytes of text that are searched at a time, if a single text has no more.
BLOCK_BYTES = 4 << 20
#: Words compared at first when a seed is extended; doubled as long as they match.
STRIDE = 32

RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
RUNS = pa.struct([("n_words", pa.int64()), ("runs", pa.list_(RUN)), ("strongest", RUN), ("collapsed", pa.string())])
_RUN_TYPE = "struct<start: long, length: long, period: long>"
RUNS_TYPE = f"n_words long, runs array<{_RUN_TYPE}>, strongest {_RUN_TYPE}, collapsed string"

Run = tuple[int, int, int]


def overlap(lag: int) -> int:
    """Matches on the diagonal of ``lag`` that a run of that period has at least."""
    return max(LEAST, POWER * lag) - lag


def bands(n: int) -> Iterator[tuple[int, int, int]]:
    """(k, smallest lag, largest lag) of each band that a text of ``n`` words can need."""
    low = 1
    while low + overlap(low) <= n:
        k = overlap(low)
        yield k, low, k
        low = k + 1


def _joined(names: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Names of pairs of names: equal for equal pairs only."""
    _, out = np.unique(names * (int(other.max(initial=0)) + 1) + other, return_inverse=True)
    return out


def _neighbours(names: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions whose name comes again in the same text, and where it does so next."""
    order = np.argsort(names, kind="stable")
    a, b = order[:-1], order[1:]
    again = (names[a] == names[b]) & (texts[a] == texts[b])
    return a[again], b[again]


def _reach(words: np.ndarray, at: int, lag: int, step: int, room: int) -> int:
    """How many words from ``at`` on, in direction ``step``, match those ``lag`` further."""
    found, stride = 0, STRIDE
    while found < room:
        width = min(stride, room - found)
        first = at + step * found
        here = words[first : first + width] if step > 0 else words[first - width + 1 : first + 1][::-1]
        there = words[first + lag : first + lag + width] if step > 0 else words[first + lag - width + 1 : first + lag + 1][::-1]
        apart = here != there
        if apart.any():
            return found + int(apart.argmax())
        found, stride = found + width, stride * 2
    return found


def find_runs(words: np.ndarray, bounds: np.ndarray) -> list[list[Run]]:
    """The runs (start, length, period) of each text, by start and period.

    ``words`` holds the word numbers, from zero, of texts one behind the other; text j has
    those from ``bounds[j]`` to ``bounds[j + 1]``.
    """
    runs: list[list[Run]] = [[] for _ in range(len(bounds) - 1)]
    texts = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    # ``here`` are the positions that still count; ``names[p]`` names the k-gram at here[p].
    here, k, names = np.arange(len(words)), 1, words
    longest = int(np.diff(bounds).max(initial=0))
    covered: dict[int, int] = {}
    for wanted, low, high in bands(longest):
        while k < wanted and len(here):
            # A k-gram is joined with the one that begins so much later, in the same text.
            shift = min(k, wanted - k)
            fits = here + shift + k <= bounds[texts[here] + 1]
            place = np.searchsorted(here, here[fits] + shift)
            names = _joined(names[fits], names[place])
            here, k = here[fits], k + shift
        if not len(here):
            break
        first, then = _neighbours(names, texts[here])
        lags = here[then] - here[first]
        seeds = np.flatnonzero((lags >= low) & (lags <= high))
        seeds = seeds[np.argsort(here[first[seeds]])]
        for at, lag in zip(here[first[seeds]].tolist(), lags[seeds].tolist(), strict=True):
            if at < covered.get(lag, -1):
                continue
            text = texts[at]
            begin, end = int(bounds[text]), int(bounds[text + 1])
            left = _reach(words, at - 1, lag, -1, at - begin)
            right = _reach(words, at + k, lag, 1, end - lag - at - k)
            covered[lag] = at + k + right
            length = left + k + right + lag
            if length >= max(LEAST, POWER * lag):
                runs[text].append((at - left - begin, length, lag))
        # Only texts with a repeated k-gram can hold longer repeats; they stay whole.
        kept = np.zeros(len(bounds) - 1, dtype=bool)
        kept[texts[here[first]]] = True
        stays = kept[texts[here]]
        here, names = here[stays], names[stays]
    return [sorted(r, key=lambda run: (run[0], run[2])) for r in runs]


def strongest(runs: list[Run]) -> Run | None:
    """The run of the greatest length over period; of equals, the first one's, then the smallest period's."""
    best = None
    for run in runs:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def kept_words(n: int, runs: list[Run]) -> np.ndarray:
    """True for the words that no run holds behind its first period."""
    steps = np.zeros(n + 1, dtype=np.int64)
    for start, length, period in runs:
        steps[start + period] += 1
        steps[start + length] -= 1
    return np.cumsum(steps[:n]) == 0


def _found(texts: list[bytes]) -> pa.Array:
    split = [text.split() for text in texts]
    number: dict[bytes, int] = {}
    words = np.array([number.setdefault(w, len(number)) for text in split for w in text], dtype=np.int64)
    bounds = np.cumsum([0, *map(len, split)])
    runs = find_runs(words, bounds)
    collapsed = []
    for text, found in zip(split, runs, strict=True):
        if found:
            kept = kept_words(len(text), found)
            text = [text[i] for i in np.flatnonzero(kept).tolist()]
        collapsed.append(b" ".join(text))
    ends = pa.array(np.cumsum([0, *map(len, runs)]), pa.int32())
    flat = np.array([run for found in runs for run in found], dtype=np.int64).reshape(-1, 3)
    items = pa.StructArray.from_arrays([pa.array(flat[:, i]) for i in range(3)], fields=list(RUN))
    best = [strongest(found) for found in runs]
    parts = [pa.array([b and b[i] for b in best], pa.int64()) for i in range(3)]
    none = pa.array([b is None for b in best], pa.bool_())
    data = pa.array(collapsed, pa.binary())
    columns = [
        pa.array(np.diff(bounds), pa.int64()),
        pa.ListArray.from_arrays(ends, items),
        pa.StructArray.from_arrays(parts, fields=list(RUN), mask=none),
        # Words are cut at ASCII white space, so their bytes are UTF-8 again.
        pa.Array.from_buffers(pa.string(), len(data), data.buffers()),
    ]
    return pa.StructArray.from_arrays(columns, fields=list(RUNS))


def periodic_runs(text: str = "text") -> Column:
    """A struct of n_words, runs, the strongest run and the collapsed text, for each text.

    ``collapsed`` has the words that no run holds behind its first period, with one space
    between them.
    """

    @F.arrow_udf(RUNS_TYPE)
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            parts, block, size = [], [], 0
            for value in batch.cast(pa.large_binary()):
                data = value.as_py() or b""
                if block and size + len(data) > BLOCK_BYTES:
                    parts.append(_found(block))
                    block, size = [], 0
                block.append(data)
                size += len(data)
            parts.append(_found(block))
            yield pa.concat_arrays(parts)

    return found(F.col(text))


def with_runs(docs: DataFrame, name: str = "periodic", text: str = "text") -> DataFrame:
    """``docs`` with the struct of ``periodic_runs`` as a column."""
    return docs.withColumn(name, periodic_runs(text))
