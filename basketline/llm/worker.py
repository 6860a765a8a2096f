"""What a Python worker keeps from one task to the next, and which texts split plainly."""

from __future__ import annotations

import os
import re
import sys
import types
from collections.abc import Callable
from typing import Any

#: Characters whose class is the same in every Unicode version and regular expression
#: library, and whose lower case is one character wherever it stands: ASCII, precomposed
#: Latin, Greek and Cyrillic letters, kana, Han and Hangul, and common punctuation.
_OTHER = re.compile(
    "[^\t\n\r -~\u00c0-\u012f\u0131-\u024f\u0391-\u03a1\u03a4-\u03a9\u03b1-\u03c9\u0400-\u0481\u048a-\u052f"
    "\u2013\u2014\u2018\u2019\u201c\u201d\u2026\u3001\u3002\u300c\u300d\u3041-\u3096\u30a1-\u30fa\u30fc"
    "\u4e00-\u9fa5\uac00-\ud7a3\uff01\uff0c\uff1f]"
)


def splits_plainly(text: str) -> bool:
    """Whether Python's own splitting sees what a tokenizer's would; else the library splits."""
    return "<|" not in text and _OTHER.search(text) is None


def kept(key: Any, make: Callable[[], Any]) -> Any:
    """``make()``, done once in this worker process and kept for its later tasks."""
    home = sys.modules.setdefault("_basketline_worker", types.ModuleType("_basketline_worker"))
    if key not in home.__dict__:
        home.__dict__[key] = make()
    return home.__dict__[key]


def tokenizer(path: str):
    """The library's tokenizer, without threads of its own: Spark has one task per core."""

    def load():
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        return Tokenizer.from_file(path)

    return kept(f"tokenizer {path}", load)


def byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write for bytes: printable bytes stand for
    themselves, the others for the code points from 256 on, in order."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


#: Longer pieces are left to the library, whose merging stays fast for them.
LONG_PIECE = 200
#: Stands behind the last byte of a pre-token where the vocabulary marks word ends; no UTF-8 has it.
_END = b"\xff"


def piece_encoder(path: str) -> Callable[[str], list[int]]:
    """Ids of one pre-token by the vocabulary's ranks, several times faster than a library call.

    A byte-pair vocabulary whose ids are the order of its merges is a table of ranks. A
    suffix at word ends becomes a byte of its own, whose merges come first since the ids of
    single letters precede all merges.
    """

    def load():
        import json

        import tiktoken

        library = tokenizer(path)
        model = json.loads(library.to_str())["model"]
        suffix, letters = model["end_of_word_suffix"] or "", byte_letters()
        special = {t.content for t in library.get_added_tokens_decoder().values()}
        ranks = {}
        for token, i in model["vocab"].items():
            if token not in special:
                last = bool(suffix) and token.endswith(suffix)
                word = token.removesuffix(suffix) if last else token
                ranks[bytes(letters[c] for c in word) + (_END if last else b"")] = i
        encoding = tiktoken.Encoding(path, pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})
        encode, end = encoding._core_bpe.encode_single_piece, _END if suffix else b""

        def ids(piece: str) -> list[int]:
            if len(piece) > LONG_PIECE:
                return library.encode_batch_fast([piece], add_special_tokens=False)[0].ids
            return encode(piece.encode() + end)

        return ids

    return kept(f"pieces {path}", load)
