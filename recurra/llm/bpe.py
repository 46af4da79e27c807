"""Byte-level BPE ids from a tokenizer file, one encoder per Python worker."""

from __future__ import annotations

import json
import re
from functools import lru_cache


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_of_char() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies use for bytes."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


#: White space runs from this length on go to the reference library, as the faster engine's patterns recurse over them.
LONG_BLANKS = re.compile(r"\s{2000}")


@lru_cache(maxsize=2)
def encoder(path: str | None = None):
    """Text to ids, as `tokenizers` gives them without added start or end ids.

    Strings of the file's added tokens have those tokens' ids.  The file's
    vocabulary ranks merges by id, so the faster `tiktoken` engine gives the
    same ids; the tests hold the two against each other.
    """
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    with open(path or default_path(), encoding="utf-8") as f:
        spec = json.load(f)
    added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    byte = byte_of_char()
    ranks = {bytes(byte[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in added}
    made = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)
    marks = [t for t in added if t]
    slow: list[Tokenizer] = []

    def encode(text: str) -> list[int]:
        if LONG_BLANKS.search(text):
            if not slow:
                slow.append(Tokenizer.from_file(path or default_path()))
            return slow[0].encode(text, add_special_tokens=False).ids
        if any(m in text for m in marks):
            return made.encode(text, allowed_special="all")
        return made.encode_ordinary(text)

    return encode
