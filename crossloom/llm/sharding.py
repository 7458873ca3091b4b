"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Keys fall on a ring of cells. A cell belongs to the next virtual node
clockwise; rows that would fill that shard beyond its bound go on clockwise to
the next shard with room. Larger rows arrive first, so that small ones even
out the rest. Which part of a cell goes where follows from the cells' counts and
bytes alone: that table is bounded by the ring, whatever the input. Rows only
look up their part. All of it is DataFrame operations.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SHARDS = 24
#: Cells of the ring, virtual nodes of a shard, and how far a shard may exceed the mean.
CELLS, VIRTUAL_NODES, SLACK = 2048, 32, 0.0005
#: What each row costs besides its text.
ROW_BYTES = 8
SALTS = 32


def ring_owners(shards: int, cells: int = CELLS, virtual_nodes: int = VIRTUAL_NODES) -> list[list[int]]:
    """For each cell all shards in the order met clockwise; the first owns it.

    A virtual node sits on the cell of its hash; where several meet, the
    smaller hash comes first. A new shard only adds nodes.
    """
    nodes = sorted((zlib.crc32(f"shard {s} node {v}".encode()) % cells, zlib.crc32(f"{v}/{s}".encode()), s) for s in range(shards) for v in range(virtual_nodes))
    owners: list[list[int]] = [[]] * cells
    start = 0
    for cell in range(cells):
        while start < len(nodes) and nodes[start][0] < cell:
            start += 1
        owners[cell] = list(dict.fromkeys(nodes[(start + k) % len(nodes)][2] for k in range(len(nodes))))
    return owners


@dataclass
class Part:
    """Rows `first` to `last` (excluded) of a cell go to `shard`, to slots from `slot` on."""

    size_class: int
    cell: int
    first: int
    last: int
    shard: int
    slot: int


def bounded_loads(cells: list[tuple[int, int, int, int]], shards: int, owners: list[list[int]], slack: float = SLACK) -> list[Part]:
    """(size class, cell, rows, bytes) -> parts. Every row gets a shard; a shard takes no row that would exceed the bound.

    If rows fit nowhere any more (few rows, large ones), each goes to the shard with the least bytes.
    """
    bound = sum(c[3] for c in cells) / shards * (1 + slack)
    load, count = [0.0] * shards, [0] * shards
    parts: list[Part] = []

    def give(size_class: int, cell: int, at: int, n: int, each: float, shard: int) -> None:
        parts.append(Part(size_class, cell, at, at + n, shard, count[shard]))
        load[shard] += n * each
        count[shard] += n

    for size_class, cell, rows, size in sorted(cells, key=lambda c: (-c[0], c[1])):
        each, at = size / rows, 0
        for shard in owners[cell]:
            n = min(rows - at, int((bound - load[shard]) / each + 1e-9)) if each else rows - at
            if n > 0:
                give(size_class, cell, at, n, each, shard)
                at += n
            if at == rows:
                break
        while at < rows:
            shard = min(range(shards), key=lambda s: (load[s], s))
            give(size_class, cell, at, 1, each, shard)
            at += 1
    return parts


def shard_documents(docs: DataFrame, shards: int = SHARDS, cells: int = CELLS, virtual_nodes: int = VIRTUAL_NODES, slack: float = SLACK) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every row of docs.

    size: UTF-8 bytes of the text plus ROW_BYTES (null text: those alone, crc of
    no bytes). The plan fills shards up to 1 + slack times their mean by the mean sizes of its
    parts, as far as single rows allow; true sizes differ from it by how a part's own rows differ from
    their class (README has figures), and what all shards may hold above the mean the emptiest lacks. Slots run from 0 without gaps in every shard. A null id
    is a key like others; rows with equal ids are rows of their own and may part.
    Only doc_id and text are read; an empty table gives no rows.
    """
    text = F.coalesce(docs["text"].cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text).cast("long") + ROW_BYTES).alias("size"), F.crc32(text).alias("text_crc32"))
    # half octaves of size; the salt is written with the row, so a lost task finds the same one
    rows = rows.withColumn("size_class", F.floor(2 * F.log2(F.col("size").cast("double"))).cast("int"))
    rows = rows.withColumn("cell", F.pmod(F.xxhash64(F.lit("ring"), "doc_id"), F.lit(cells)).cast("int"))
    rows = common.staged(rows.withColumn("salt", F.spark_partition_id() % SALTS), "sizes")

    totals = rows.groupBy("size_class", "cell").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("b")).collect()
    parts = bounded_loads([(r["size_class"], r["cell"], r["n"], r["b"]) for r in totals], shards, ring_owners(shards, cells, virtual_nodes), slack)
    where = docs.sparkSession.createDataFrame([(p.size_class, p.cell, p.first, p.last, p.shard, p.slot) for p in parts], "size_class int, cell int, _first long, _last long, shard int, _slot long")

    placed = common.ranked(rows, ["size_class", "cell"], ["doc_id", "text_crc32", "size"], F.col("salt"))
    # `where` is bounded by the ring: cells times size classes, and a part more per full shard
    found = placed.join(F.broadcast(where), ["size_class", "cell"]).where("rank >= _first and rank < _last")
    return found.select("doc_id", "size", "text_crc32", "shard", (F.col("_slot") + F.col("rank") - F.col("_first")).alias("slot"))


def op1_sharding(spark, sf_dir: str) -> DataFrame:
    """Bounded loads keep the shards' bytes near equal; the place of a row depends on the others, so the law is `bytes`."""
    found = shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
