"""Public tokenizers, read from their vocabulary files; nothing is trained or copied."""

from __future__ import annotations

import base64
import functools
import os
from collections.abc import Callable

#: Vocabulary files are looked for here, unless a path is given.
FOLDER = os.environ.get("FOLIOMILL_TOKENIZERS", "/opt/tokenizers")
BYTE_BPE_50K = "byte_bpe_50k.tiktoken"
#: Fixed value: how the byte-level vocabularies split a text into words.
WORD_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def path_of(vocabulary: str) -> str:
    return vocabulary if os.path.isabs(vocabulary) else os.path.join(FOLDER, vocabulary)


@functools.lru_cache(maxsize=4)
def ranks(vocabulary: str = BYTE_BPE_50K) -> dict[bytes, int]:
    """Token bytes -> id (its merge rank)."""
    with open(path_of(vocabulary), "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in file if line.strip())}


@functools.lru_cache(maxsize=4)
def encoder(vocabulary: str = BYTE_BPE_50K) -> Callable[[str], list[int]]:
    """Encode a text without special tokens; a text that is no valid Unicode has its lone surrogates replaced."""
    import tiktoken

    return tiktoken.Encoding("own", pat_str=WORD_PATTERN, mergeable_ranks=ranks(vocabulary), special_tokens={}).encode_ordinary
