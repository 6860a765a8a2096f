"""Fill-in-middle rearrangement of texts at unit ends, found in 64-bit words.

A unit is a line with its line feed, or what stands behind the last one. The UTF-8 bytes of
many texts are seen as little-endian 64-bit words. Arithmetic inside a word marks the bytes
that end a unit, eight at a time and without a branch; ``bitwise_count`` counts the marks of a
word, and a running sum over words tells how many come before each. The end of unit k is then
the k-th mark: a search in the running sums finds its word, and byte sums inside that word its
byte. Code points are counted the same way, by marking the bytes that begin one. No text is
decoded or split.

Texts without a unit, those that hold one of the separators and the share ``1 - rate`` stay plain.
Null and empty texts are plain and give an empty text. A null id draws as an empty id does, and
equal rows draw alike, so they give equal rows. One very long text is a block of its own. An empty
table gives an empty table; other columns are kept, except ``fim`` itself, which is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of text that are marked at a time, if a single text has no more.
BLOCK_BYTES = 4 << 20
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN, PSM, SPM = "plain", "psm", "spm"

_ONES = np.uint64(0x0101010101010101)
_HIGH = np.uint64(0x8080808080808080)
_LOW = np.uint64(0x7F7F7F7F7F7F7F7F)
_ONE, _EIGHT = np.uint64(1), np.uint64(8)

FIM = pa.struct(
    [
        ("n", pa.int64()),
        ("form", pa.string()),
        ("prefix_chars", pa.int64()),
        ("middle_chars", pa.int64()),
        ("output", pa.string()),
    ]
)
FIM_TYPE = "n long, form string, prefix_chars long, middle_chars long, output string"


def as_words(data: np.ndarray) -> np.ndarray:
    """The bytes as 64-bit words, with zeros behind them up to one whole word more."""
    padded = np.zeros((len(data) // 8 + 1) * 8, dtype=np.uint8)
    padded[: len(data)] = data
    return padded.view("<u8")


def equal_marks(words: np.ndarray, byte: int) -> np.ndarray:
    """The high bit of every byte that equals ``byte``; no carry leaves a byte."""
    apart = words ^ (_ONES * np.uint64(byte))
    return ~(((apart & _LOW) + _LOW) | apart) & _HIGH


def point_marks(words: np.ndarray) -> np.ndarray:
    """The high bit of every byte that begins a code point: all but those of the form 10xxxxxx."""
    return ~(words & ~(words << _ONE)) & _HIGH


class Marks:
    """Rank and select over marked bytes."""

    def __init__(self, marks: np.ndarray):
        self.marks = marks
        self.before = np.zeros(len(marks) + 1, dtype=np.int64)
        np.cumsum(np.bitwise_count(marks), out=self.before[1:])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Marks before each byte."""
        word, inside = at >> 3, (at & 7).astype(np.uint64)
        below = (_ONE << (inside * _EIGHT)) - _ONE
        return self.before[word] + np.bitwise_count(self.marks[word] & below)

    def select(self, k: np.ndarray) -> np.ndarray:
        """The byte of the ``k``-th mark, counted from 1."""
        word = np.searchsorted(self.before[1:], k)
        wanted = (k - self.before[word]).astype(np.uint64)
        # Byte i of the product is the number of marks in bytes 0 to i.
        sums = (self.marks[word] >> np.uint64(7)) * _ONES
        reached = ((sums | _HIGH) - wanted * _ONES) & _HIGH
        return word * 8 + 8 - np.bitwise_count(reached).astype(np.int64)


def unit_cuts(
    data: np.ndarray, starts: np.ndarray, ends: np.ndarray, draws: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Units of each text, the bytes where its prefix and middle end, and their code points.

    ``data`` holds texts one behind the other; the first two rows of ``draws`` choose the cuts.
    """
    words = as_words(data)
    marks = equal_marks(words, 0x0A)
    last = ends[ends > starts] - 1
    np.bitwise_or.at(marks, last >> 3, np.uint64(0x80) << ((last & 7).astype(np.uint64) * _EIGHT))
    units = Marks(marks)
    before = units.rank(starts)
    n = units.rank(ends) - before
    first, second = draws[0] % (n + 1), draws[1] % (n + 1)

    def end_of(k: np.ndarray) -> np.ndarray:
        at = starts.copy()
        some = k > 0
        at[some] = units.select((before + k)[some]) + 1
        return at

    a, b = end_of(np.minimum(first, second)), end_of(np.maximum(first, second))
    points = Marks(point_marks(words))
    at_a = points.rank(a)
    return n, a, b, at_a - points.rank(starts), points.rank(b) - at_a


def _blocks(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of texts of at most ``BLOCK_BYTES``, or one longer text."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + BLOCK_BYTES, "right")) - 1
        to = min(max(to, at + 1), n)
        yield at, to
        at = to


def _rearranged(texts: pa.Array, draws: np.ndarray, percent: int, spm_percent: int, signs: list[bytes]) -> pa.Array:
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, dtype=np.uint8)
    prefix, suffix, middle = signs
    columns: list[list] = [[], [], [], [], []]
    for i, j in _blocks(offsets):
        at = offsets[i : j + 1] - offsets[i]
        held = data[offsets[i] : offsets[j]]
        n, a, b, before, inside = unit_cuts(held, at[:-1], at[1:], draws[:, i:j])
        raw = held.tobytes()
        spm = draws[3, i:j] % 100 < spm_percent
        plain = (n == 0) | (draws[2, i:j] % 100 >= percent)
        bounds = zip(at[:-1].tolist(), a.tolist(), b.tolist(), at[1:].tolist(), strict=True)
        for k, (start, cut, other, end) in enumerate(bounds):
            text = raw[start:end]
            if plain[k] or any(sign in text for sign in signs):
                row = (n[k], PLAIN, None, None, text)
            else:
                front, mid, rest = raw[start:cut], raw[cut:other], raw[other:end]
                if spm[k]:
                    out = b"".join((suffix, rest, prefix, front, middle, mid))
                else:
                    out = b"".join((prefix, front, suffix, rest, middle, mid))
                row = (n[k], SPM if spm[k] else PSM, before[k], inside[k], out)
            for column, value in zip(columns, row, strict=True):
                column.append(value)
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
    arrays = [pa.array(c, type=t) for c, t in zip(columns, kinds, strict=True)]
    # The parts were cut between code points, so their bytes are UTF-8 again.
    arrays[4] = pa.Array.from_buffers(pa.string(), len(arrays[4]), arrays[4].buffers())
    return pa.StructArray.from_arrays(arrays, fields=list(FIM))


def draws(doc_id: str, seed: int) -> list[Column]:
    """Four numbers of 32 bits from the hash of ``seed`` and the id."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")))
    digest = F.sha2(key.cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def rearranged(
    doc_id: str = "doc_id",
    text: str = "text",
    seed: int = 7,
    percent: int = 100,
    spm_percent: int = 50,
    signs: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE),
) -> Column:
    """A struct of n (units), form, prefix_chars, middle_chars and output for each text.

    ``percent`` of the texts are rearranged, ``spm_percent`` of these with the suffix first.
    The three separators must be different, none inside another, and no end of one the
    beginning of one, so that ``restored`` finds them again.
    """
    raw = [sign.encode() for sign in signs]

    @F.arrow_udf(FIM_TYPE)
    def found(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for texts, *numbers in batches:
            drawn = np.stack([x.to_numpy(zero_copy_only=False) for x in numbers])
            yield _rearranged(texts, drawn, percent, spm_percent, raw)

    return found(F.col(text), *draws(doc_id, seed))


def with_fim(docs: DataFrame, name: str = "fim", **options) -> DataFrame:
    """``docs`` with the struct of ``rearranged`` as a column."""
    return docs.withColumn(name, rearranged(**options))


def restored(form: Column, output: Column, signs: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE)) -> Column:
    """The text that gave ``output``, from the output and its form alone."""
    prefix, suffix, middle = signs

    def halves(text: Column, sign: str) -> tuple[Column, Column]:
        at = F.instr(text, sign)
        # substring counts from 1; instr finds the first place.
        return F.substring(text, F.lit(1), at - 1), F.substring(text, at + len(sign), F.length(text))

    front, rest = halves(F.substring(output, F.lit(len(prefix) + 1), F.length(output)), suffix)
    psm_suffix, psm_middle = halves(rest, middle)
    spm_suffix, others = halves(F.substring(output, F.lit(len(suffix) + 1), F.length(output)), prefix)
    spm_prefix, spm_middle = halves(others, middle)
    return (
        F.when(form == PSM, F.concat(front, psm_middle, psm_suffix))
        .when(form == SPM, F.concat(spm_prefix, spm_middle, spm_suffix))
        .otherwise(output)
    )
