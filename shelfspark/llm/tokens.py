"""Token ids of a public byte-level BPE, word by word from a memory of words."""

from __future__ import annotations

import re

from shelfspark.llm.common import worker_cache

#: Words that a worker remembers before it starts anew; random words never repeat.
REMEMBERED_WORDS = 150_000
#: Added after each document.
END_ID = 2


class Encoder:
    """``encode(text)`` gives the ids as little-endian unsigned 32-bit bytes.

    The tokenizer's pattern always cuts before a single space that a visible character
    follows, so the words between such spaces can be encoded one by one and remembered.
    Texts with other spaces (before white space, or last) are encoded in one go.
    Strings of special tokens are ordinary text.
    """

    odd_space = re.compile(r" (?:\s|\Z)")

    def __init__(self, name: str):
        import base64

        import public_tokenizers
        import tiktoken

        with open(public_tokenizers.path(name), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.whole = tiktoken.Encoding(
            "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
        )
        self.words = _Words(self)

    def encoded(self, text: str) -> bytes:
        from array import array

        return array("I", self.whole.encode_ordinary(text)).tobytes()

    def encode(self, text: str) -> bytes:
        if self.odd_space.search(text):
            return self.encoded(text)
        if len(self.words) > REMEMBERED_WORDS:
            self.words.clear()
        first, *rest = text.split(" ")
        return self.encoded(first) + b"".join(map(self.words.__getitem__, rest))


class _Words(dict):
    """Ids of a word with the space before it, encoded when first asked for."""

    def __init__(self, encoder: Encoder):
        self.encoder = encoder

    def __missing__(self, word: str) -> bytes:
        ids = self[word] = self.encoder.encoded(" " + word)
        return ids


def encoder(name: str = "byte_bpe_50k.tiktoken") -> Encoder:
    """The worker's encoder for a vocabulary file of the public tokenizers."""
    cache = worker_cache()
    if name not in cache:
        cache[name] = Encoder(name)
    return cache[name]
