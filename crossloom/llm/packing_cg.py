"""Packing by cutting-stock column generation over the histogram of piece lengths.

Documents are cut into full sequences and a rest. The rests' lengths form a
histogram of at most `capacity` counts, and only that reaches the driver. A linear
program over patterns (which lengths share a sequence) is solved by a revised
simplex whose entering columns a knapsack dynamic program prices. Rounded
down, the patterns take runs of the pieces ranked within each length; what
rounding leaves is packed longest first. Pieces then find their sequence by
their rank alone.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, tokens

CAPACITY = 1024
#: Classes are at most STEP lengths wide, and an eighth of the length or so.
STEP, SHARE = 16, 8
#: Columns are priced until the use is within this share of the bound, or so many were tried.
GAP, MOST_COLUMNS = 5e-4, 400
#: Pieces of one length that a task numbers, about; a common length is dealt over as many tasks as that takes.
NUMBERED = 50_000

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def classes_of(lengths: np.ndarray) -> np.ndarray:
    """The length that stands for each: the next multiple of a power of two, about an eighth of it and STEP at most."""
    step = np.minimum(STEP, 2 ** np.maximum(0, np.floor(np.log2(np.maximum(lengths, 1) / SHARE))).astype(np.int64))
    return -(-lengths // step) * step


def knapsack(sizes: np.ndarray, values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable multiset of sizes within capacity: (value, count of each); sizes ascend."""
    best, pick = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    fitting = np.searchsorted(sizes, np.arange(capacity + 1), side="right")
    for c in range(1, capacity + 1):
        best[c], pick[c] = best[c - 1], -1
        if k := fitting[c]:
            got = values[:k] + best[c - sizes[:k]]
            j = int(got.argmax())
            if got[j] > best[c] + 1e-12:
                best[c], pick[c] = got[j], j
    counts, c = np.zeros(len(sizes)), capacity
    while c > 0:
        if pick[c] < 0:
            c -= 1
        else:
            counts[pick[c]] += 1
            c -= sizes[pick[c]]
    return float(best[capacity]), counts


def starting_basis(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """A feasible basis (a column each) and its use: the longest class left, with the fill that leaves least room.

    Each pattern uses up a class, and later patterns do without it, so the
    columns are independent.
    """
    m = len(sizes)
    basis, use, left = np.diag(capacity // sizes).astype(float), np.zeros(m), demand.astype(float)
    while (open_ := np.flatnonzero(left > 0)).size:
        longest = open_[-1]
        pattern = np.zeros(m)
        pattern[longest] = 1
        _, fill = knapsack(sizes[open_], sizes[open_].astype(float), capacity - int(sizes[longest]))
        pattern[open_] += fill
        ratio = np.where(pattern > 0, left / np.where(pattern > 0, pattern, 1), np.inf)
        gone = int(ratio.argmin())
        times = ratio[gone]
        left -= times * pattern
        left[gone] = 0
        left[left < 1e-9] = 0
        basis[:, gone], use[gone] = pattern, times
    return basis, use


def column_generation(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (a row each) and how often the linear program uses them.

    Duals are smoothed towards the best seen so far, which keeps the early
    columns useful; a column enters only if the true duals value it above 1.
    """
    basis, use = starting_basis(sizes, demand, capacity)
    inverse = np.linalg.inv(basis)
    centre, bound, smooth = sizes / capacity, float(sizes @ demand) / capacity, 0.8
    for k in range(MOST_COLUMNS):
        dual = inverse.sum(0)
        total = float(use.sum())
        if total <= bound * (1 + GAP):
            break
        trial = smooth * centre + (1 - smooth) * np.maximum(dual, 0)
        value, column = knapsack(sizes, trial, capacity)
        if float(trial @ demand) / value > bound:
            bound, centre = float(trial @ demand) / value, trial / value
        if dual @ column <= 1 + 1e-9:
            value, column = knapsack(sizes, dual, capacity)
            bound = max(bound, total / value)
            if value <= 1 + 1e-9:
                break
        step = inverse @ column
        ratio = np.where(step > 1e-9, use / np.where(step > 1e-9, step, 1), np.inf)
        out = int(ratio.argmin())
        use = use - ratio[out] * step
        use[out] = ratio[out]
        np.maximum(use, 0, out=use)
        basis[:, out] = column
        if k % 100 == 99:
            inverse = np.linalg.inv(basis)
        else:
            row = inverse[out] / step[out]
            inverse = inverse - np.outer(step, row)
            inverse[out] = row
    return basis.T.astype(np.int64), use


def longest_first(sizes: np.ndarray, left: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """Patterns for what rounding left: the longest class that still fits, again and again."""
    left, found = left.copy(), []
    while left.any():
        pattern, room = np.zeros(len(sizes), np.int64), capacity
        for j in range(len(sizes) - 1, -1, -1):
            if left[j] and sizes[j] <= room:
                pattern[j] = min(left[j], room // sizes[j])
                room -= pattern[j] * sizes[j]
        used = pattern > 0
        times = int((left[used] // pattern[used]).min())
        left -= pattern * times
        found.append((pattern, times))
    return found


@dataclass
class Run:
    """Pieces of this length with ranks from `rank` on go, one each, to `times` sequences from `sequence` on, at `offset`."""

    length: int
    rank: int
    times: int
    sequence: int
    offset: int


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[Run]:
    """Where every piece goes, by length and rank. The number of runs depends on capacity, not on the counts."""
    runs, sequence = [], 0
    if n := histogram.get(capacity, 0):
        runs.append(Run(capacity, 0, n, 0, 0))
        sequence = n
    lengths = np.array(sorted(x for x in histogram if x < capacity), np.int64)
    if not len(lengths):
        return runs
    classes = np.minimum(classes_of(lengths), capacity)
    sizes = np.unique(classes)
    demand = np.array([sum(histogram[int(x)] for x in lengths[classes == s]) for s in sizes], np.int64)
    patterns, use = column_generation(sizes, demand.astype(float), capacity)
    whole = [(p, int(np.floor(u + 1e-6))) for p, u in zip(patterns, use, strict=True)]
    chosen, left = [], demand.copy()
    for pattern, times in whole:
        used = pattern > 0
        times = min(times, int((left[used] // pattern[used]).min())) if used.any() else 0
        if times > 0:
            left -= pattern * times
            chosen.append((pattern, times))
    chosen += longest_first(sizes, left, capacity)

    queue = {int(s): [[int(x), 0, histogram[int(x)]] for x in lengths[classes == s]] for s in sizes}
    for pattern, times in chosen:
        slots = []
        for size, copies in zip(sizes, pattern, strict=True):
            for _ in range(int(copies)):
                parts, need = [], times
                while need:
                    head = queue[int(size)][0]
                    take = min(need, head[2])
                    parts.append([head[0], head[1], take])
                    head[1] += take
                    head[2] -= take
                    need -= take
                    if not head[2]:
                        queue[int(size)].pop(0)
                slots.append(parts)
        done = 0
        while done < times:
            n, offset = min(parts[0][2] for parts in slots), 0
            for parts in slots:
                length, rank, _ = parts[0]
                runs.append(Run(length, rank, n, sequence + done, offset))
                offset += length
                parts[0][1] += n
                parts[0][2] -= n
                if not parts[0][2]:
                    parts.pop(0)
            done += n
        sequence += times
    return runs


def cut(docs: DataFrame, capacity: int = CAPACITY, separator: int = tokens.SEPARATOR, with_ids: bool = False) -> DataFrame:
    """Pieces of every document's ids and its separator: full ones, then the rest."""
    width = 4 * capacity

    def make():
        encoder, tail = tokens.encoder(), np.array([separator], "<u4").tobytes()

        def step(c):
            out: dict[str, list] = {n: [] for n in names}
            for doc_id, raw in zip(c["doc_id"], encoder.ids(c["text"]), strict=True):
                raw += tail
                for at in range(0, len(raw), width):
                    piece = raw[at : at + width]
                    row = (doc_id, at // 4, len(piece) // 4, zlib.crc32(piece), len(raw) // 4, piece)
                    for n, v in zip(names, row, strict=False):
                        out[n].append(v)
            return out

        return step

    names = [x.split()[0] for x in PIECES.split(", ")] + ["ids"] * with_ids
    return common.map_batches(docs.select(F.col("doc_id").cast("long"), common.text_column(docs).alias("text")), PIECES + ", ids binary" * with_ids, make)


def pack(docs: DataFrame, capacity: int = CAPACITY, separator: int = tokens.SEPARATOR, with_ids: bool = False) -> DataFrame:
    """Pieces with their sequence_id and offset; with_ids adds each piece's ids (little-endian uint32).

    Null and empty texts are one separator, a piece like any other. Repeated
    rows and ids are packed as often as they occur; null ids stay null; other
    columns are not carried; an empty table gives no rows.
    """
    spark = docs.sparkSession
    pieces = common.staged(cut(docs, capacity, separator, with_ids), "pieces")
    histogram = {int(r["length"]): int(r["n"]) for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    runs = [(r.length, r.rank, r.rank + r.times, r.sequence, r.offset) for r in plan(histogram, capacity)]
    where = spark.createDataFrame(runs, "length long, _from long, _to long, _sequence long, _offset long")
    salt = F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(max(1, -(-max(histogram.values(), default=0) // NUMBERED))))
    placed = common.ranked(pieces, ["length"], ["doc_id", "start"], salt).alias("p")
    # `where` has a few thousand rows at most: its size follows capacity, not the table
    found = placed.join(F.broadcast(where.alias("w")), (F.col("p.length") == F.col("w.length")) & (F.col("rank") >= F.col("_from")) & (F.col("rank") < F.col("_to")))
    return found.select("p.*", (F.col("_sequence") + F.col("rank") - F.col("_from")).alias("sequence_id"), F.col("_offset").alias("offset")).drop("rank")


def op4_packing(spark, sf_dir: str) -> DataFrame:
    """pack() of all documents, nulls, empty texts and repeats as it says."""
    packed = pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
