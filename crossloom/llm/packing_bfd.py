"""Token ids packed into fixed-width rows by best-fit decreasing.

Each task encodes its documents, cuts those longer than a row into full rows
and a rest (no id is lost), and packs a block of pieces at a time: longest
first, each into the open row with the least room that still holds it. A
segment tree over the possible amounts of room finds that row in O(log width).
A row is written as a binary matrix line of little-endian uint16 or uint32 ids,
with the cumulative segment lengths and the position at which each segment
resumes.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, tokens

WIDTH = 1024
#: Ids packed at a time in a task; bounds memory. A block leaves one part-filled row or so.
BLOCK_IDS = 4_000_000


class CapacityTree:
    """A segment tree over room 0..width: the smallest room of at least `need` with an open row."""

    def __init__(self, width: int):
        self.size = 1 << width.bit_length()
        self.count = [0] * (2 * self.size)
        self.rows: list[list[int]] = [[] for _ in range(width + 1)]

    def put(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        self._add(room, 1)

    def _add(self, room: int, n: int) -> None:
        i = room + self.size
        while i:
            self.count[i] += n
            i >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """(room, row) of the tightest open row that holds `need`, removed from the tree."""
        count, i = self.count, need + self.size
        if not count[i]:
            while i > 1 and (i & 1 or not count[i + 1]):  # up until a right neighbour has open rows
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.size:
                i = 2 * i if count[2 * i] else 2 * i + 1
        room = i - self.size
        self._add(room, -1)
        return room, self.rows[room].pop()


def best_fit_decreasing(lengths: list[int], width: int) -> list[list[int]]:
    """Rows of piece numbers; no piece is longer than width."""
    tree, rows = CapacityTree(width), []
    for k in sorted(range(len(lengths)), key=lambda k: (-lengths[k], k)):
        room, row = tree.take(lengths[k]) or (width, len(rows))
        if row == len(rows):
            rows.append([])
        rows[row].append(k)
        if room > lengths[k]:
            tree.put(room - lengths[k], row)
    return rows


SCHEMA = "row_id long, n_ids int, input_ids binary, cu_seqlens array<int>, doc_ids array<long>, position_starts array<long>, ids_crc32 long"


def token_matrices(docs: DataFrame, width: int = WIDTH, separator: int = tokens.SEPARATOR, dtype: str = "<u2", block_ids: int = BLOCK_IDS) -> DataFrame:
    """Packed rows of `width` ids: every id of every document once, plus a separator per document.

    input_ids holds width ids, the tail padded with the separator; n_ids of
    them count. cu_seqlens starts with 0 and gives where segments end;
    position_starts gives the position, within its document, of each
    segment's first id (0 resets). Null and empty texts are one separator; null
    ids stay null and may repeat; other columns are not carried. An empty table
    gives no rows. row_id is unique, and the same as long as the input's files are.
    """
    width_, dtype_ = width, np.dtype(dtype)

    def run(batches):
        import pyarrow as pa

        encoder = tokens.encoder()
        if max(len(encoder.length), separator) > np.iinfo(dtype_).max + 1:
            raise ValueError(f"{dtype} can't hold every id")
        base, made = TaskContext.get().partitionId() << 33, 0
        held: list[tuple[int | None, int, np.ndarray]] = []
        size = 0

        def flush():
            nonlocal held, size, made
            rows = best_fit_decreasing([len(x[2]) for x in held], width_)
            for i in range(0, len(rows), 2000):
                cols: list[list] = [[] for _ in range(7)]
                for row in rows[i : i + 2000]:
                    parts = [held[k] for k in row]
                    ids = np.full(width_, separator, dtype_)
                    ends = np.cumsum([len(p[2]) for p in parts], dtype=np.int32)
                    ids[: ends[-1]] = np.concatenate([p[2] for p in parts])
                    raw = ids.tobytes()
                    for c, v in zip(cols, (base + made, int(ends[-1]), raw, [0, *ends.tolist()], [p[0] for p in parts], [p[1] for p in parts], zlib.crc32(raw)), strict=True):
                        c.append(v)
                    made += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64()), strict=True)], names=[x.split()[0] for x in SCHEMA.split(", ")])
            held, size = [], 0

        for part in (x for batch in batches for x in common.slices(batch)):
            ids_of = encoder.ids(part.column(1).to_pylist())
            for doc_id, raw in zip(part.column(0).to_pylist(), ids_of, strict=True):
                ids = np.append(np.frombuffer(raw, "<u4"), np.uint32(separator)).astype(dtype_)
                for start in range(0, len(ids), width_):
                    held.append((doc_id, start, ids[start : start + width_]))
                size += len(ids)
                if size >= block_ids:
                    yield from flush()
        if held:
            yield from flush()

    return docs.select(F.col("doc_id").cast("long"), common.text_column(docs).alias("text")).mapInArrow(run, SCHEMA)


def op3_token_matrices(spark, sf_dir: str) -> DataFrame:
    """The packed id matrix of all documents, row by row."""
    return token_matrices(spark.read.parquet(f"{sf_dir}/documents.parquet"))
