"""Where the public tokenizers' files are."""

from __future__ import annotations

import json


def path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_level() -> tuple[str, str]:
    """Ranks and pre-tokenizer pattern of the vocabulary that is also in byte_bpe_50k.json."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def byte_level_with_added() -> tuple[str, str, tuple[tuple[str, int], ...], str]:
    """As ``byte_level``, with the added tokens of byte_bpe_50k.json, which the library matches inside texts, and that file."""
    library = path("byte_bpe_50k.json")
    with open(library, encoding="utf-8") as f:
        added = json.load(f)["added_tokens"]
    return (*byte_level(), tuple((t["content"], t["id"]) for t in added), library)
