"""Public vocabularies inside tasks: texts to token ids."""

from __future__ import annotations

import base64
from functools import lru_cache

#: Where the vocabulary lies on every machine; a parameter of all that use it.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Fixed values of that vocabulary: the id that no text gives, and how texts are cut into pieces.
END = 50256
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=4)
def encoder(vocabulary: str):
    """The encoding of a file of ranks, read once in each worker."""
    import tiktoken

    with open(vocabulary, "rb") as lines:
        ranks = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("waxwing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def encoded(text: str | None, vocabulary: str) -> list[int]:
    """The ids of a text; null has none."""
    return encoder(vocabulary).encode_ordinary(text) if text else []
