"""Token ids of texts by a public tokenizer, computed inside tasks."""

from __future__ import annotations

import base64
import re

import numpy as np
import public_tokenizers
import tiktoken
from tokenizers import Tokenizer

TOKENIZER = "byte_bpe_50k.json"
END_ID = 2

# The rank file holds the vocabulary of the JSON file and is read by the faster library. Both
# libraries agree on these characters; a text with any other goes to the tokenizers library.
_RANKS = {"byte_bpe_50k.json": "byte_bpe_50k.tiktoken"}
_SAME = r"[^\t\n\r\x20-\x7e\xa1-ſ]"


def encoder(name: str = TOKENIZER):
    """A function from a text to its ids as a uint32 array, without special tokens."""
    exact = Tokenizer.from_file(public_tokenizers.path(name))
    exact.encode_special_tokens = True  # their strings in a text are ordinary text

    def slow(text: str) -> np.ndarray:
        return np.array(exact.encode(text, add_special_tokens=False).ids, dtype="<u4")

    if name not in _RANKS:
        return slow
    with open(public_tokenizers.path(_RANKS[name]), "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    fast = tiktoken.Encoding(
        name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
    )
    odd = re.compile(_SAME).search

    def encode(text: str) -> np.ndarray:
        if odd(text):
            return slow(text)
        return np.asarray(fast.encode_to_numpy(text, disallowed_special=()), dtype="<u4")

    return encode


def with_end(ids: np.ndarray, end_id: int = END_ID) -> np.ndarray:
    return np.append(ids, np.uint32(end_id)).astype("<u4")


def pieces(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids: only the first may be shorter than ``size``."""
    if n <= size:
        return [(0, n)]
    head = n % size
    out = [(0, head)] if head else []
    return out + [(at, size) for at in range(head, n, size)]
