"""Byte-pair encoding with a pair occurrence index, and its decoding.

A task gathers the words it has not met, lays their symbols out in one array and
indexes every pair by its merge's rank: rank -> all positions. Active ranks are
applied in ascending order, each to all its positions at once; the merged
symbols' new neighbours go to the lists of their own ranks. No merge makes a
pair of a lower rank than its own, as a merge's parts exist before it.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import re
import unicodedata

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

TOKENIZER = "word_bpe_49k.json"
#: Bytes that a process's caches take at most, about; when full they start again. Chunks and words over LONG characters are not kept.
CACHE_BYTES, LONG = 48 << 20, 64
#: What a cached string costs besides its characters and ids (two objects and their place).
ENTRY = 200
WORD_END = "</w>"

#: Fixed values of the tokenizer's file: its pre-tokenizer's pattern. Chunks hold no white space.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SPACES = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def byte_symbols() -> list[str]:
    """The character that stands for each byte: itself if printable in Latin-1, else one from U+0100 on, in order."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class PairIndex:
    """The merges as sorted arrays, and their application to many words together."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]]):
        self.span = max(vocab.values()) + 1
        left = np.array([vocab[a] for a, _ in merges], np.int64)
        right = np.array([vocab[b] for _, b in merges], np.int64)
        self.code = left * self.span + right
        self.made = np.array([vocab[a + b] for a, b in merges], np.int32)
        self.order = np.argsort(self.code, kind="stable")
        self.sorted = self.code[self.order]
        symbols = byte_symbols()
        self.inside = np.array([vocab[s] for s in symbols], np.int32)
        self.last = np.array([vocab[s + WORD_END] for s in symbols], np.int32)

    def ranks(self, code: np.ndarray) -> np.ndarray:
        """The rank of each pair code, -1 without a merge."""
        if not len(self.sorted):
            return np.full(len(code), -1)
        at = np.minimum(np.searchsorted(self.sorted, code), len(self.sorted) - 1)
        return np.where(self.sorted[at] == code, self.order[at], -1)

    def encode(self, words: list[bytes]) -> list[bytes]:
        """Little-endian uint32 ids of each word; words are not empty."""
        if not words:
            return []
        length = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(length)
        raw = np.frombuffer(b"".join(words), np.uint8)
        symbol = self.inside[raw]
        symbol[ends - 1] = self.last[raw[ends - 1]]
        n = len(symbol)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[ends - 1] = -1
        before[ends - length] = -1
        alive = np.ones(n, bool)
        lists: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def index(at: np.ndarray) -> None:
            at = at[after[at] >= 0]
            rank = self.ranks(symbol[at] * np.int64(self.span) + symbol[after[at]])
            at, rank = at[rank >= 0], rank[rank >= 0]
            order = np.argsort(rank, kind="stable")
            at, rank = at[order], rank[order]
            if not len(rank):
                return
            cuts = np.flatnonzero(np.r_[True, rank[1:] != rank[:-1]])
            for a, b in zip(cuts, [*cuts[1:], len(rank)], strict=True):
                r = int(rank[a])
                if r not in lists:
                    lists[r] = []
                    heapq.heappush(active, r)
                lists[r].append(at[a:b])

        index(np.arange(n))
        while active:
            rank = heapq.heappop(active)
            at = np.unique(np.concatenate(lists.pop(rank)))
            at = at[alive[at] & (after[at] >= 0)]
            at = at[symbol[at] * np.int64(self.span) + symbol[after[at]] == self.code[rank]]
            if not len(at):
                continue
            follows = np.r_[False, at[1:] == after[at[:-1]]]
            if follows.any():  # aaa: the first two merge
                begin = np.maximum.accumulate(np.where(follows, 0, np.arange(len(at))))
                at = at[(np.arange(len(at)) - begin) % 2 == 0]
            gone = after[at]
            symbol[at] = self.made[rank]
            alive[gone] = False
            after[at] = after[gone]
            follower = after[at]
            before[follower[follower >= 0]] = at[follower >= 0]
            leader = before[at]
            index(np.concatenate([at, leader[leader >= 0]]))
        ids = symbol[alive].astype("<u4").tobytes()
        cuts = (np.cumsum(np.add.reduceat(alive, ends - length)) * 4).tolist()
        return [ids[a:b] for a, b in zip([0, *cuts], cuts, strict=False)]


class Codec:
    """encode(texts) and decode(ids) as the tokenizer's file says; one per process, by codec()."""

    def __init__(self, tokenizer: str = TOKENIZER):
        import public_tokenizers
        import regex

        with open(public_tokenizers.path(tokenizer), encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        self.index = PairIndex(vocab, [tuple(m) for m in spec["model"]["merges"]])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        names = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        self.names = [names.get(i, "").encode() for i in range(max(names) + 1)]
        self.split_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")").split
        self.words_of = regex.compile(PATTERN).findall
        self.strict = re.compile(f"[^{SPACES}]+").findall
        self.odd = re.compile("[\x1c-\x1f]").search
        self.chunks: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.held = 0

    def cut(self, text: str) -> list[str]:
        """Normalized text (NFC, each character lowered by itself) without its white space."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        text = text.lower()
        return self.strict(text) if self.odd(text) else text.split()

    def learn(self, chunks: set[str]) -> tuple[list[str], list[str]]:
        """Encode the chunks not met yet; returns these and their new words."""
        if self.held > CACHE_BYTES:
            self.chunks.clear()
            self.words.clear()
            self.held = 0
        chunks = chunks.difference(self.chunks)
        parts = {c: [c] if c.isalpha() else self.words_of(c) for c in chunks}
        new = list({w for p in parts.values() for w in p}.difference(self.words))
        self.words.update(zip(new, self.index.encode([w.encode("utf-8", "surrogatepass") for w in new]), strict=True))
        words = self.words
        for chunk, p in parts.items():
            self.chunks[chunk] = words[p[0]] if len(p) == 1 else b"".join([words[w] for w in p])
        return list(parts), new

    def forget(self, new: list[str], cache: dict[str, bytes]) -> None:
        """Drop long strings from a cache, and count the bytes of the others."""
        for x in new:
            if len(x) > LONG:
                del cache[x]
            else:
                self.held += ENTRY + len(x) + len(cache[x])

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian uint32 ids of each text."""
        cuts: list[list] = []
        for text in texts:
            if "<|" in text and len(pieces := self.split_special(text)) > 1:
                cuts.append([x for k, piece in enumerate(pieces) for x in ([self.special[piece]] if k % 2 else self.cut(piece))])
            else:
                cuts.append(self.cut(text))
        chunks, words = self.learn({x for x in set().union(*cuts) if isinstance(x, str)})
        get = self.chunks.__getitem__
        out = []
        for cut in cuts:
            try:
                out.append(b"".join(map(get, cut)))
            except KeyError:
                out.append(b"".join(get(x) if isinstance(x, str) else np.uint32(x).astype("<u4").tobytes() for x in cut))
        self.forget(chunks, self.chunks)
        self.forget(words, self.words)
        return out

    def decode(self, ids: bytes) -> str:
        """The ids' names joined by spaces: the file names no decoder."""
        return b" ".join(map(self.names.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8")


@functools.cache
def codec(tokenizer: str = TOKENIZER) -> Codec:
    """The process's one codec: reused workers keep one vocabulary and bounded caches, however many tasks they run."""
    return Codec(tokenizer)


SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def encode_decode(docs: DataFrame, tokenizer: str = TOKENIZER, with_ids: bool = False) -> DataFrame:
    """One row per row of docs: the number of ids, digests of the ids and of their decoded text; with_ids adds both.

    Null and empty texts have no ids and decode to nothing. Null ids of
    documents stay null; repeated rows stay; other columns are not carried.
    """

    def make():
        own = codec(tokenizer)
        sha = lambda b: hashlib.sha256(b).hexdigest()

        def step(c):
            ids = own.encode(c["text"])
            texts = [own.decode(x) for x in ids]
            out = {"doc_id": c["doc_id"], "n_tokens": [len(x) // 4 for x in ids], "ids_sha256": list(map(sha, ids)), "decoded_sha256": [sha(t.encode()) for t in texts]}
            return out | ({"ids": ids, "decoded": texts} if with_ids else {})

        return step

    slim = docs.select(F.col("doc_id").cast("long"), common.text_column(docs).alias("text"))
    return common.map_batches(slim, SCHEMA + ", ids binary, decoded string" * with_ids, make)


def op8_bpe(spark, sf_dir: str) -> DataFrame:
    """encode_decode() of all documents, nulls, empty texts and repeats as it says."""
    return encode_decode(spark.read.parquet(f"{sf_dir}/documents.parquet"))
