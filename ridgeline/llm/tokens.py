"""Token ids of the byte-level vocabulary, for use inside tasks.

The ids are those of the ``tokenizers`` file.  Plain text goes through the rank form of the same
vocabulary, which is several times faster; texts that hold a special token's string, or white space
too long for its pattern engine, go through the tokenizer file itself.
"""

from __future__ import annotations

import base64
import re
from functools import lru_cache

import numpy as np

_SPECIAL = "<|endoftext|>"
_RUN, _SAMPLED_RUN = re.compile(r"\s{500}"), re.compile(r"\s{4}")


def odd(text: str) -> bool:
    """Whether a text needs the tokenizer file; a run of 500 holds four of every 125th character, so most texts need no full search."""
    return _SPECIAL in text or (_SAMPLED_RUN.search(text[::125]) is not None and _RUN.search(text) is not None)


def default_files() -> tuple[str, str]:
    import public_tokenizers as P

    return P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken")


@lru_cache(maxsize=2)
def encoder(json_path: str, ranks_path: str):
    """Function from a text to its ids (a list); one per Python worker."""
    import public_tokenizers as P
    import tiktoken
    from tokenizers import Tokenizer

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    whole = Tokenizer.from_file(json_path)

    def encode(text: str) -> list[int]:
        if odd(text):
            return whole.encode(text, add_special_tokens=False).ids
        return fast.encode_ordinary(text)

    return encode


def document_ids(encode, text: str | None, end: int) -> np.ndarray:
    """Ids of a document with the end id; null text is empty."""
    return np.array([*encode(text or ""), end], dtype="<u4")


def pieces(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids: the first takes the remainder, all others are full."""
    first = n % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]
