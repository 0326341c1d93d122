"""Exact token ids of the tokenizers library, by a quicker library where both must agree.

A byte-level vocabulary whose ids are its merge ranks is also a rank table, which a second library runs
about three times as fast. Texts on which the two could differ go to the first: characters outside a
plainly classified range, added-token strings, and very long blanks.
"""

from __future__ import annotations

import os
from functools import lru_cache

import numpy as np
import regex

PLAIN = regex.compile(r"[\t\n\r\x20-\x7e¡-¬®-ſ]*")
LONG_BLANKS = (" " * 4096, "\n" * 4096, "\t" * 4096)


class ExactBpe:
    """``ids(text)`` as little-endian unsigned 32-bit bytes, ``count(text)`` as a number."""

    def __init__(self, path: str, pattern: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.quick = self._ranked(path, pattern)

    @staticmethod
    def _ranked(path: str, pattern: str):
        """The same merges in a quicker library, if ids are merge ranks; None otherwise.

        A byte-level vocabulary spells bytes as printable characters: the printable ones of Latin-1 stand
        for themselves, the others follow from U+0100 on in order.
        """
        import json

        import tiktoken

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        others = [b for b in range(256) if b not in plain]
        byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}
        vocabulary = model["vocab"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        if any(vocabulary.get(a + b) != 256 + i for i, (a, b) in enumerate(pairs)):
            return None
        ranks = {bytes(byte[c] for c in w): i for w, i in vocabulary.items() if i < 256 + len(pairs)}
        return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def ids(self, text: str) -> bytes:
        if (self.quick is None or PLAIN.fullmatch(text) is None or any(a in text for a in self.added)
                or any(b in text for b in LONG_BLANKS)):
            return np.asarray(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return np.asarray(self.quick(text), "<u4").tobytes()

    def count(self, text: str) -> int:
        return len(self.ids(text)) // 4


@lru_cache(maxsize=2)
def cached_bpe(path: str, pattern: str) -> ExactBpe:
    """One tokenizer per worker process."""
    return ExactBpe(path, pattern)
