"""Byte-level BPE ids of whole documents, as bytes, with a cache of the chunks already seen.

A text is cut before white space that follows something else; such chunks
encode independently, and most of them repeat. Each worker process encodes a new
chunk once and joins the ids of the rest from its cache.
"""

from __future__ import annotations

import base64
import functools
import re

import numpy as np

TOKENIZER = "byte_bpe_50k.json"
RANKS = "byte_bpe_50k.tiktoken"
SPECIAL = "<|endoftext|>"
SEPARATOR = 0
#: Bytes that a process's cache takes at most, about; when full it starts again. Chunks over LONG characters are not kept.
CACHE_BYTES, LONG = 48 << 20, 64
#: What a cached chunk costs besides its characters and ids (two objects and their place).
ENTRY = 200

_chunks = re.compile(r"\s*\S+|\s+").findall
#: White space to Python's re but not to the tokenizer, and everything outside Latin scripts.
_odd = re.compile("[\x1c-\x1f\u0250-\u1dff\u1f00-\u1fff\u2070-\U0010ffff]").search


class Encoder:
    """ids(texts) -> little-endian uint32 ids of each text, equal to tokenizers' encode(add_special_tokens=False)."""

    def __init__(self, tokenizer: str = TOKENIZER, ranks: str = RANKS):
        import public_tokenizers
        import tiktoken

        self.path = public_tokenizers.path(tokenizer)
        with open(public_tokenizers.path(ranks), "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.plain = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
        self.length = np.zeros(max(table.values()) + 1, np.int64)
        for piece, i in table.items():
            self.length[i] = len(piece)
        self.cache: dict[str, bytes] = {}
        self.held = 0
        self.whole = None

    def exact(self, text: str) -> bytes:
        """The tokenizers library itself, for texts with special tokens or unusual characters."""
        if self.whole is None:
            from tokenizers import Tokenizer

            self.whole = Tokenizer.from_file(self.path)
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def learn(self, new: list[str]) -> None:
        """Encode chunks that start with white space in one call: joined, each still encodes on its own."""
        ids = np.array(self.plain.encode_ordinary("".join(new)), "<u4")
        ends = np.cumsum(np.fromiter((len(x.encode()) for x in new), np.int64, len(new)))
        cuts = (np.searchsorted(np.cumsum(self.length[ids]), ends, side="left") + 1) * 4
        raw, start = ids.tobytes(), 0
        for chunk, end in zip(new, cuts.tolist(), strict=True):
            self.cache[chunk] = raw[start:end]
            start = end

    def ids(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = [b""] * len(texts)
        cut = [(i, _chunks(t)) for i, t in enumerate(texts) if t and not self.simple(i, t, out)]
        cache = self.cache
        if self.held > CACHE_BYTES:
            cache.clear()
            self.held = 0
        new = list(set().union(*(c for _, c in cut)).difference(cache))
        self.learn([x for x in new if x[0].isspace() and not x[-1].isspace()])
        for x in new:
            if x not in cache:
                cache[x] = np.array(self.plain.encode_ordinary(x), "<u4").tobytes()
        get = cache.__getitem__
        for i, chunks in cut:
            out[i] = b"".join(map(get, chunks))
        for x in new:
            if len(x) > LONG:
                del cache[x]
            else:
                self.held += ENTRY + len(x) + len(cache[x])
        return out

    def simple(self, i: int, text: str, out: list[bytes]) -> bool:
        """Encode text at once if it can't be cut into chunks; say whether it was."""
        if SPECIAL in text or _odd(text):
            out[i] = self.exact(text)
            return True
        return False


@functools.cache
def encoder(tokenizer: str = TOKENIZER, ranks: str = RANKS) -> Encoder:
    """The process's one encoder: reused workers keep one vocabulary and one bounded cache, however many tasks they run."""
    return Encoder(tokenizer, ranks)


def id_dtype() -> np.dtype:
    return np.dtype("<u4")
