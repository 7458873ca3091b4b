"""Fitting on a bounded sample of labelled documents, scoring all documents in one pass."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Most labelled rows that a fit looks at, taken by the hash of their id. The only bound here; scoring covers every row.
FIT_ROWS = 12_000


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int = FIT_ROWS) -> DataFrame:
    """At most `rows` labelled texts outside the held-out fold: doc_id, text, label, part (0 to 99).

    Labels are taken in the order of a hash of the id, so the sample is the
    same in every run. Null ids and null labels take no part; of repeated ids
    the least label and the least text are used. Texts are whole, however long.
    """
    picked = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
        .where(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & ~common.held_out(F.col("doc_id")))
        .withColumn("_h", F.xxhash64(F.lit("fit"), "doc_id"))
        .groupBy("doc_id", "_h")
        .agg(F.min("label").alias("label"))
        .orderBy("_h", "doc_id")
        .limit(rows)
        .withColumn("part", F.pmod("_h", F.lit(100)).cast("int"))
        .drop("_h")
    )
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_column(docs).alias("text"))
    # picked holds `rows` narrow rows at most, whatever the input
    least = texts.join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(F.min_by("text", F.struct(F.xxhash64("text"), F.col("text"))).alias("text"), F.first("label").alias("label"), F.first("part").alias("part"))
    return common.staged(least, "labelled")


def feature_matrix(sample: DataFrame, features: Callable[[str], list[float]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, label, part) of a bounded sample, ordered by id."""

    def make():
        return lambda c: {"doc_id": c["doc_id"], "label": c["label"], "part": c["part"], "x": [features(t) for t in c["text"]]}

    rows = common.map_batches(sample, "doc_id long, label int, part int, x array<double>", make).orderBy("doc_id").collect()
    width = len(features(""))
    x = np.array([r["x"] for r in rows], np.float64).reshape(len(rows), width)
    return x, np.array([r["label"] for r in rows], np.float64), np.array([r["part"] for r in rows], np.int64)


def score_all(docs: DataFrame, features: Callable[[str], list[float]], predict: Callable[[np.ndarray], np.ndarray], out: str = "score") -> DataFrame:
    """docs with a column `out` appended (it replaces one of that name); one pass, no shuffle, no row lost."""
    names = [c for c in docs.columns if c != out]
    schema = docs.select(*[F.col(f"`{c}`") for c in names]).withColumn(out, F.lit(0.0)).schema
    where = names.index("text")

    def run(batches):
        for batch in batches:
            for part in common.slices(batch):
                x = np.array([features(t or "") for t in part.column(where).to_pylist()], np.float64)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.clip(predict(x), 0, 1))], names=[*part.schema.names, out])
        common.give_back()

    return docs.select(*[F.col(f"`{c}`") for c in names]).mapInArrow(run, schema)
