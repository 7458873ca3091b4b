"""SimHash fingerprints and a Gray-order hierarchical index over them.

Fingerprints within a few bits share a whole block of bits, so rows meet by
the masked pattern of a block. Inside such a group the index sorts
fingerprints by Gray rank, so that neighbours differ in few bits, and builds a
tree over runs of neighbours. A node holds the masked pattern that all its
fingerprints share: the bits set in all of them and the bits set in none. A join
of the index with itself goes down pair by pair of nodes; the differing bits of
their patterns, which only grow on the way down, bound those of all pairs below, and a pair
of whole groups goes as soon as they are too many.
Groups that are too large for a task are keyed by further blocks, again
without losing a pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .components import components, local_stars

SEED = 42
#: Fingerprints of a group that one task joins; larger groups are split by further blocks.
GROUP = 20_000
#: Rows of whole groups that a task joins at once, and node pairs it looks at together.
BATCH, PAIRS = 50_000, 500_000
#: Neighbours in Gray order that a node of the index takes together.
FANOUT = 8


def shingle_hashes(text: str, words: int) -> np.ndarray:
    """XXH64 of every run of `words` words (ASCII white space, A-Z lowered), repeats included."""
    import xxhash

    parts = text.encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.empty(0, np.uint64)
    joined, digest = b" ".join(parts), xxhash.xxh64_intdigest
    if len(parts) <= words:
        return np.array([digest(joined, SEED)], np.uint64)
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    spans = zip(starts[: len(parts) - words + 1].tolist(), ends[words - 1 :].tolist(), strict=True)
    return np.array([digest(joined[a:b], SEED) for a, b in spans], np.uint64)


def majority_bits(hashes: np.ndarray) -> int:
    """Bit i is 1 if it is set in over half the hashes; no hashes: 0."""
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 8192):
        block = hashes[i : i + 8192].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(block, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def remix(hashes: np.ndarray, lane: int) -> np.ndarray:
    """Another hash of the same shingles for each lane; lane 0 is the hash itself."""
    if not lane:
        return hashes
    with np.errstate(over="ignore"):
        x = (hashes ^ np.uint64(0x9E3779B97F4A7C15 * lane % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(32))


def fingerprints(docs: DataFrame, words: int = 3, lanes: int = 1) -> DataFrame:
    """doc_id and code_0 ... code_{lanes-1}: signed longs with the fingerprints' bits. Null and empty texts: zeros."""

    def make():
        def step(c):
            hashed = [shingle_hashes(t, words) for t in c["text"]]
            codes = np.array([[majority_bits(remix(h, k)) for k in range(lanes)] for h in hashed], np.uint64).reshape(-1, lanes).view(np.int64)
            return {"doc_id": c["doc_id"]} | {f"code_{k}": codes[:, k] for k in range(lanes)}

        return step

    slim = docs.select(F.col("doc_id").cast("long"), common.text_column(docs).alias("text"))
    return common.map_batches(slim, "doc_id long, " + ", ".join(f"code_{k} long" for k in range(lanes)), make)


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """The place of each code in the reflected Gray sequence (the prefix sums of its bits, modulo 2)."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def shared_patterns(group: np.ndarray, codes: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The index, rows first: per level (first node below each, with an end mark; bits set in all its codes; bits set in none).

    Rows are in order of group and Gray rank; no node crosses a group, and on the last level each group is one node.
    """
    n = len(codes)
    levels = [(np.arange(n + 1), codes, ~codes)]
    while True:
        _, ones, zeros = levels[-1]
        new = np.r_[True, group[1:] != group[:-1]]
        begin = np.flatnonzero(new)
        if len(begin) == len(group):
            return levels
        place = np.arange(len(group)) - np.repeat(begin, np.diff(np.r_[begin, len(group)]))
        first = np.flatnonzero(place % FANOUT == 0)
        levels.append((np.append(first, len(group)), np.bitwise_and.reduceat(ones, first), np.bitwise_and.reduceat(zeros, first)))
        group = group[first]


def index_pairs(group: np.ndarray, codes: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Parts (i, j, differing bits) of all pairs of positions whose codes are of the same group and differ in at most `radius` bits.

    Rows are in order of group and Gray rank. A part holds PAIRS pairs or the pairs of two
    nodes at most, so a caller that folds parts as they come needs no more memory however dense a group is.
    """
    if not len(codes):
        return
    levels = shared_patterns(group, codes)
    roots = np.arange(len(levels[-1][1]))
    stack = [(len(levels) - 1, roots, roots)]
    while stack:
        level, a, b = stack.pop()
        if level == 0:
            apart = a != b
            a, b = a[apart], b[apart]
            if len(a):
                yield a, b, np.bitwise_count(codes[a] ^ codes[b]).astype(np.int64)
            continue
        first = levels[level][0]
        na, nb = first[a + 1] - first[a], first[b + 1] - first[b]
        size = na * nb
        total = np.cumsum(size)
        if len(a) > 1 and total[-1] > PAIRS:
            half = max(1, int(np.searchsorted(total, total[-1] // 2)))
            stack += [(level, a[half:], b[half:]), (level, a[:half], b[:half])]
            continue
        if not len(a):
            continue
        pair = np.repeat(np.arange(len(a)), size)
        at = np.arange(total[-1]) - np.repeat(total - size, size)
        x, y = first[a[pair]] + at // nb[pair], first[b[pair]] + at % nb[pair]
        kept = (a != b)[pair] | (x <= y)
        x, y = x[kept], y[kept]
        _, ones, zeros = levels[level - 1]
        differ = np.bitwise_count((ones[x] & zeros[y]) | (zeros[x] & ones[y]))
        near = differ <= radius
        stack.append((level - 1, x[near], y[near]))


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int = BATCH, most: int = 32 << 20) -> Iterator[pa.Table]:
    """Tables of about `rows` rows or `most` bytes, or one group if that is larger, that end where a group of `keys` ends."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(b.num_rows for b in held) < rows and sum(b.nbytes for b in held) < most:
            continue
        table = pa.Table.from_batches(held)
        last = np.ones(table.num_rows, bool)
        for k in keys:
            column = table.column(k).to_numpy()
            last &= column == column[-1]
        cut = int(np.flatnonzero(~last)[-1]) + 1 if not last.all() else 0
        if cut:
            yield table.slice(0, cut)
            held = table.slice(cut).to_batches()
    if held:
        yield pa.Table.from_batches(held)


def _blocks(free: int, parts: int) -> list[int]:
    """The set bits of `free` in `parts` runs of nearly equal number, as masks."""
    bits = [i for i in range(64) if free >> i & 1]
    cuts = [round(len(bits) * k / parts) for k in range(parts + 1)]
    return [sum(1 << i for i in bits[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def hamming_links(codes: DataFrame, radius: int = 2, group: int = GROUP) -> DataFrame:
    """(a, b): links whose components are those of all pairs of codes within `radius` bits.

    `codes` has one column, `code`, distinct longs. Of radius + 1 blocks of
    bits, a near pair shares one; rows meet in the group of its pattern. A
    group of more than `group` codes is keyed by its remaining bits' blocks
    instead, until 2^bits itself is no more than `group` (at least 4).
    """
    full = (1 << 64) - 1
    masks = _blocks(full, radius + 1)
    rows = codes.select("code", F.explode(F.array(*[F.lit(_signed(m)) for m in masks])).alias("mask"))
    links = None

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["mask", "key"]):
            mask, key, code = (table.column(c).to_numpy() for c in ("mask", "key", "code"))
            code = code.view(np.uint64)
            order = np.lexsort((gray_rank(code), key, mask))
            mask, key, code = mask[order], key[order], code[order]
            number = np.cumsum(np.r_[0, (mask[1:] != mask[:-1]) | (key[1:] != key[:-1])])
            a = b = np.zeros(0, np.int64)
            for i, j, _ in index_pairs(number, code, radius):
                a, b = local_stars(np.r_[a, i], np.r_[b, j], len(code))
            signed = code.view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(signed[a]), pa.array(signed[b])], names=["a", "b"])

    while True:
        rows = rows.withColumn("key", F.col("code").bitwiseAND(F.col("mask")))
        counts = common.staged(rows.groupBy("mask", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "patterns")
        ready = rows.join(counts.where(F.col("n") <= group), ["mask", "key"]).select("mask", "key", "code")
        found = ready.repartition("mask", "key").sortWithinPartitions("mask", "key").mapInArrow(join, "a long, b long")
        links = found if links is None else links.union(found)
        crowded = {r["mask"] for r in counts.where(F.col("n") > group).select("mask").distinct().collect()}  # of the few masks in use
        if not crowded:
            return links
        hot = rows.join(counts.where(F.col("n") > group).select("mask", "key"), ["mask", "key"])
        deeper = {m: [m | x for x in _blocks(full & ~m, radius + 1)] for m in masks if _signed(m) in crowded}
        masks = list(dict.fromkeys(x for v in deeper.values() for x in v))
        table = F.create_map(*[F.lit(y) for m, v in deeper.items() for y in (_signed(m), [_signed(x) for x in v])])
        # two ways lead to some masks; a code counts once in each
        rows = common.staged(hot.select("code", F.explode(table[F.col("mask")]).alias("mask")).distinct(), "patterns")


def near_components(docs: DataFrame, words: int = 3, radius: int = 2) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, one row per row of docs.

    Two rows are linked if their fingerprints differ in at most `radius` bits;
    component_id is the smallest doc_id reachable. Null and empty texts have
    fingerprint zero and are linked like any other. Null ids keep their row and
    don't count as smallest (a component of null ids only has a null
    component_id). Repeated rows stay; other columns are not carried.
    """
    prints = common.staged(fingerprints(docs, words).withColumnRenamed("code_0", "code"), "fingerprints")
    first = common.staged(prints.groupBy("code").agg(F.min("doc_id").alias("first")), "codes")
    roots = components(hamming_links(first.select("code"), radius))
    member = first.join(roots, first["code"] == roots["node"], "left").select("code", "first", F.coalesce("root", "code").alias("root"))
    least = member.groupBy("root").agg(F.min("first").alias("component_id"))
    named = member.join(least, "root").select("code", "component_id")
    return prints.join(named, "code").select("doc_id", F.lower(F.lpad(F.hex("code"), 16, "0")).alias("fingerprint"), "component_id")


def op2_simhash(spark, sf_dir: str) -> DataFrame:
    """near_components() of all documents, nulls, empty texts and repeats as it says."""
    return near_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
