"""Token ids of a byte-level BPE vocabulary, as the tokenizers library gives them."""

from __future__ import annotations

import base64
import re
from functools import cached_property, lru_cache

import numpy as np

#: Texts of only these characters are split alike by both libraries; the rest goes to tokenizers itself.
_OTHER = re.compile("[^\n\r\t -~¡-ɏ]|<\\|")


@lru_cache(maxsize=2)
def encoder(vocabulary: str, ranks: str | None = None, pattern: str | None = None) -> "Encoder":
    return Encoder(vocabulary, ranks, pattern)


class Encoder:
    """ids(text): the ids of tokenizers with add_special_tokens=False.

    `ranks` is the same vocabulary as a tiktoken rank file. With it, texts of Latin letters
    and ASCII signs take tiktoken's faster merge loop, which gives the same ids (tests hold
    the two against each other); texts with any other character, or with the start of a
    special token, go through tokenizers.
    """

    def __init__(self, vocabulary: str, ranks: str | None = None, pattern: str | None = None) -> None:
        self.vocabulary, self.fast = vocabulary, None
        if ranks and pattern:
            import tiktoken

            with open(ranks, "rb") as f:
                merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=merges, special_tokens={})

    @cached_property
    def slow(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.vocabulary)

    def ids(self, text: str) -> np.ndarray:
        if self.fast is not None and not _OTHER.search(text):
            try:
                return self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u4")
            except ValueError:  # pragma: no cover - an encoder's own limit
                pass
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, "<u4")
