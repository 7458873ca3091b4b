"""Approximate nearest neighbours: a graph built by NN-descent, queries by greedy search in it.

The graph starts from cells around a bounded sample of pivots. Each round of
NN-descent joins neighbours of neighbours: a node's neighbours, forward and
reverse, meet with their vectors and offer themselves to each other. A query
keeps a beam of the best nodes met, and in each round joins the beam's new nodes with
their neighbours and those with their vectors, until nothing in the beam is
new. Equal vectors are one node, so that any number of copies costs one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .simhash import whole_groups

#: Neighbours of a node, and reverse ones that it also knows.
NEIGHBOURS, REVERSE = 20, 20
#: Pivots (a sample of this many vectors at most, by hash), the cells that a vector enters, the rows of a cell that meet.
PIVOTS, ENTERED, CELL = 4096, 4, 1000
#: Rounds of NN-descent go on until one changes at most this share of the edges; ROUNDS is the limit (each halves the distance in the graph, about).
SETTLED, ROUNDS = 0.02, 10
#: Nodes a query keeps, and expands in a round. Rounds go on until no beam has a node that is not expanded.
BEAM, EXPAND = 400, 96

EDGES = "node long, nbr long, score float"


def usable(df: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector is neither null, nor zero, nor holds nulls or non-finite numbers."""
    v = F.col(vector)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return df.where(v.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(v, lambda x: x != 0))


def matrix(table: pa.Table | pa.RecordBatch, name: str = "vector") -> np.ndarray:
    """Vectors of a batch as unit rows."""
    column = table.column(name)
    flat = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).flatten().to_numpy(zero_copy_only=False)
    x = flat.reshape(table.num_rows, -1).astype(np.float32)
    return x / np.maximum(np.linalg.norm(x.astype(np.float64), axis=1), 1e-300)[:, None].astype(np.float32)


def grouped(df: DataFrame, key: str, schema: str, step: Callable[[pa.Table], Iterator[tuple]], rows: int = 4000) -> DataFrame:
    """Deal rows by `key`; `step` gets each group as a table and yields columns. Groups must be bounded."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, [key], rows):
            keys = table.column(key).to_numpy()
            cuts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            found = [cols for a, b in zip(cuts, [*cuts[1:], len(keys)], strict=True) for cols in step(table.slice(a, b - a))]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], names=names)

    return df.repartition(key).sortWithinPartitions(key).mapInArrow(run, schema)


def best(edges: DataFrame, k: int, by: str = "node", of: str = "nbr") -> DataFrame:
    """The k best edges of each node; Spark keeps only k per node and task before it shuffles."""
    order = Window.partitionBy(by).orderBy(F.desc("score"), of)
    return edges.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= k).drop("_k")


def start_graph(vectors: DataFrame, count: int, k: int) -> DataFrame:
    """Neighbours inside the cells of the ENTERED nearest pivots; large cells are dealt into parts at random."""
    wanted = max(1, min(PIVOTS, count // 128))
    sample = vectors.orderBy(F.xxhash64(F.lit("pivot"), "node"), "node").limit(wanted).collect()  # at most PIVOTS rows
    pivots = np.array([r["vector"] for r in sample], np.float32)
    pivots /= np.linalg.norm(pivots, axis=1, keepdims=True)
    entered = min(ENTERED, len(pivots))

    def assign(batches):
        for batch in batches:
            near = matrix(batch) @ pivots.T
            cells = np.argpartition(-near, entered - 1, axis=1)[:, :entered].astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(cells.tolist(), pa.list_(pa.int64()))], names=["node", "cells"])

    placed = vectors.mapInArrow(assign, "node long, cells array<long>").select("node", F.explode("cells").alias("cell"))
    placed = common.staged(placed, "cells")
    parts = placed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / CELL).alias("parts"))
    dealt = placed.join(F.broadcast(parts), "cell")  # one row per pivot
    dealt = dealt.select("node", F.xxhash64("cell", F.pmod(F.xxhash64(F.lit("part"), "node"), "parts")).alias("part"))

    def meet(table: pa.Table) -> Iterator[tuple]:
        ids, x = table.column("node").to_numpy(), matrix(table)
        if len(ids) < 2:
            return
        n = min(k, len(ids) - 1)
        for i in range(0, len(ids), 2000):
            near = x[i : i + 2000] @ x.T
            near[np.arange(len(near)), np.arange(i, i + len(near))] = -np.inf
            at = np.argpartition(-near, n - 1, axis=1)[:, :n]
            yield np.repeat(ids[i : i + 2000], n), ids[at].ravel(), np.take_along_axis(near, at, 1).ravel()

    return best(grouped(dealt.join(vectors, "node"), "part", EDGES, meet).distinct(), k)


def both_ways(graph: DataFrame, reverse: int) -> DataFrame:
    """(node, nbr): each node's neighbours, and the nearest `reverse` of those that have it as theirs."""
    back = best(graph.select(F.col("nbr").alias("node"), F.col("node").alias("nbr"), "score"), reverse)
    return graph.select("node", "nbr").union(back.select("node", "nbr")).distinct()


def descend(graph: DataFrame, vectors: DataFrame, k: int, reverse: int) -> DataFrame:
    """One round: all neighbours of a node meet, and each takes those nearer than its farthest. `new` marks edges that graph didn't have."""
    worst = graph.groupBy("node").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).otherwise(-2.0).cast("float").alias("worst"))
    known = vectors.join(worst, "node", "left").select(F.col("node").alias("nbr"), "vector", F.coalesce("worst", F.lit(-2.0)).cast("float").alias("worst"))
    meeting = both_ways(graph, reverse).join(known, "nbr")

    def offer(table: pa.Table) -> Iterator[tuple]:
        ids, x, worst = table.column("nbr").to_numpy(), matrix(table), table.column("worst").to_numpy()
        near = x @ x.T
        np.fill_diagonal(near, -np.inf)
        a, b = np.nonzero(near > worst[:, None])
        yield ids[a], ids[b], near[a, b].astype(np.float32)

    offers = grouped(meeting, "node", EDGES, offer)
    both = graph.select("node", "nbr", "score", F.lit(False).alias("new")).union(offers.select("node", "nbr", "score", F.lit(True).alias("new")))
    return best(both.groupBy("node", "nbr").agg(F.max("score").alias("score"), F.min("new").alias("new")), k)


def build_graph(vectors: DataFrame, k: int = NEIGHBOURS, reverse: int = REVERSE, rounds: int = ROUNDS) -> DataFrame:
    """node, nbr, score: about the k nearest neighbours of every node. `vectors` has distinct nodes: node long, vector. Descends until few edges change, `rounds` times at most."""
    graph = common.staged(start_graph(vectors, vectors.count(), k), "graph")
    for _ in range(rounds):
        following = common.staged(descend(graph, vectors, k, reverse), "graph")
        common.unstage(graph)
        graph = following
        changed = graph.agg(F.avg(F.col("new").cast("double"))).first()[0]
        if changed is None or changed <= SETTLED:
            break
    return graph.select("node", "nbr", "score")


BEAMS = "q long, id long, score double, state int"
#: States in a beam: met, expanded, to be expanded next.
MET, DONE, NEXT = 0, 1, 2


def search(queries: DataFrame, graph: DataFrame, vectors: DataFrame, beam: int = BEAM, expand: int = EXPAND) -> DataFrame:
    """(q, id, score): the best nodes found for each node in `queries` (column q), itself left out; scores are cosines.

    Each round costs joins on node ids; a query's rows (vector, beam, new
    nodes) meet in one group that beam and expand bound. A round expands new nodes only, and
    beams only improve, so the search ends by itself.
    """
    links = common.staged(both_ways(graph, REVERSE).groupBy("node").agg(F.collect_list("nbr").alias("nbrs")), "links")
    asked = common.staged(queries.join(vectors, queries["q"] == vectors["node"]).select("q", "vector"), "asked")

    def follow(table: pa.Table) -> Iterator[tuple]:
        kind = table.column("kind").to_numpy()
        q = int(table.column("q")[0].as_py())
        ids, score, state = (table.column(c).to_numpy() for c in ("id", "score", "state"))
        ids, score, state = ids[kind == 1], score[kind == 1], state[kind == 1]
        state = np.where(state == NEXT, DONE, state)
        new = np.flatnonzero(kind == 2)
        new = new[~np.isin(table.column("id").to_numpy()[new], [*ids, q])]
        if len(new):
            rows = table.take(pa.array(np.r_[np.flatnonzero(kind == 0)[:1], new]))
            x = matrix(rows).astype(np.float64)
            ids = np.r_[ids, rows.column("id").to_numpy()[1:]]
            score = np.r_[score, x[1:] @ x[0]]
            state = np.r_[state, np.full(len(new), MET, state.dtype)]
        order = np.lexsort((ids, -score))[:beam]
        ids, score, state = ids[order], score[order], state[order].astype(np.int32)
        state[np.flatnonzero(state == MET)[:expand]] = NEXT
        if len(ids):
            yield np.full(len(ids), q), ids, score, state

    none = F.lit(None)
    question = asked.select("q", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("id"), F.lit(0.0).alias("score"), F.lit(0).alias("state"), "vector")
    empty = vectors.schema["vector"].dataType
    beams = None
    while True:
        at = asked.select("q", F.col("q").alias("id")) if beams is None else beams.where(F.col("state") == NEXT).select("q", "id")
        reached = at.join(links, at["id"] == links["node"]).select("q", F.explode("nbrs").alias("id")).distinct()
        reached = reached.join(vectors, reached["id"] == vectors["node"])
        rows = question.union(reached.select("q", F.lit(2).alias("kind"), "id", F.lit(0.0).alias("score"), F.lit(0).alias("state"), "vector"))
        if beams is not None:
            rows = rows.union(beams.select("q", F.lit(1).alias("kind"), "id", "score", "state", none.cast(empty).alias("vector")))
        following = common.staged(grouped(rows, "q", BEAMS, follow), "beams")
        if beams is not None:
            common.unstage(beams)
        beams = following
        if beams.where(F.col("state") == NEXT).isEmpty():
            break
    return beams.select("q", "id", "score")


def nearest(table: DataFrame, is_query, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", **search_options) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows found for each row where `is_query` holds.

    Score is the cosine in double precision of the original vectors; ties go
    to the smaller id; a row is no candidate of its own (rows with its id). Rows whose vector is
    null, zero, or holds nulls or non-finite numbers take no part, nor do rows
    with a null id, or with another number of dimensions than most. Of equal
    vectors, the k + 1 smallest ids stand for all in a result, which is exact.
    Other columns are not read. A table with one usable row gives no rows.
    """
    # a table of doubles keeps them for the exact score; the search itself works on floats
    kind = "double" if table.schema[vector_col].dataType.simpleString() == "array<double>" else "float"
    rows = usable(table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast(f"array<{kind}>").alias("vector"), F.coalesce(is_query, F.lit(False)).alias("asks")), "vector").where("vec_id is not null")
    size = rows.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if size is None:
        return table.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = rows.where(F.size("vector") == size["d"])
    nodes = common.staged(rows.groupBy("vector").agg(F.min("vec_id").alias("node"), F.max("asks").alias("asks")).select("node", "vector", "asks"), "nodes")
    vectors = nodes.select("node", "vector")
    member = common.staged(rows.join(nodes.select("node", "vector"), "vector").select("node", "vec_id", "asks").distinct(), "members")

    graph = build_graph(vectors)
    asking = nodes.where("asks").select(F.col("node").alias("q"))
    found = search(asking, graph, vectors, **search_options)
    close = best(found, 3 * k, "q", "id").select("q", "id").union(asking.select("q", F.col("q").alias("id")))

    query_vectors = vectors.select(F.col("node").alias("q"), F.col("vector").alias("a"))
    pairs = close.join(query_vectors, "q").join(vectors.select(F.col("node").alias("id"), F.col("vector").alias("b")), "id")
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda s, t: s.cast("double") * t.cast("double")), F.lit(0.0), lambda acc, v: acc + v)
    exact = pairs.select("q", "id", (dot(F.col("a"), F.col("b")) / (F.sqrt(dot(F.col("a"), F.col("a"))) * F.sqrt(dot(F.col("b"), F.col("b"))))).alias("score"))
    smallest = member.withColumn("_k", F.row_number().over(Window.partitionBy("node").orderBy("vec_id"))).where(F.col("_k") <= k + 1).select(F.col("node").alias("id"), "vec_id")
    offered = exact.join(smallest, "id")
    ordered = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    top = offered.withColumn("_k", F.row_number().over(ordered)).where(F.col("_k") <= k + 1)
    lists = top.groupBy("q").agg(F.sort_array(F.collect_list(F.struct("_k", "vec_id", "score"))).alias("near"))  # k + 1 at most
    queries = member.where("asks").select(F.col("node").alias("q"), F.col("vec_id").alias("query_id")).distinct()
    others = F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    answered = queries.join(lists, "q").select("query_id", F.posexplode(others).alias("at", "near"))
    return answered.select("query_id", (F.col("at") + 1).alias("rank"), "near.vec_id", "near.score")


def op6_nearest_neighbours(spark, sf_dir: str) -> DataFrame:
    """nearest() in the embeddings, for the ids divisible by 50; unusable vectors and repeats as it says."""
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(table, F.col("vec_id") % 50 == 0)
