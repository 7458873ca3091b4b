"""What the corpus operators share: staged tables, ranks without hot tasks, text batches."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator, Sequence
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Used only where the session names no checkpoint folder (tests, notebooks).
LOCAL_CHECKPOINTS = "/tmp/checkpoints"
#: Spark's setting by which a finished query's shuffle files are deleted at once.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: While a staged table is written: shuffle files go at once, batches that go to Python hold a few MB, and a writer's row group takes little of the heap.
WRITING, ROW_GROUP = {CLEANUP: "true", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}, 32 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the cluster names it. Without one, only a local session has a folder of its own."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named is None and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir names no folder that the executors share")
    return named or f"file://{LOCAL_CHECKPOINTS}"


def ship(spark: SparkSession) -> None:
    """Give the session's executors this package, once: functions in tasks import it. To be called before such a function enters a plan.

    A package that comes from an archive is on the executors' path already.
    """
    root, name = Path(__file__).parents[2], __package__.partition(".")[0]
    if not root.is_dir() or any(f.endswith(f"/{name}.zip") for f in spark.sparkContext.listFiles):
        return
    path = f"{tempfile.mkdtemp()}/{name}.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as archive:
        for p in sorted((root / name).rglob("*.py")):
            archive.write(p, p.relative_to(root))
    spark.sparkContext.addPyFile(path)


def staged(df: DataFrame, what: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back.

    The result no longer depends on df's lineage: a lost executor costs a file
    read, not the plan. Columns keep their types and order. The job's shuffle files go with it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/staged-{what}-{uuid.uuid4().hex}"
    before = {k: spark.conf.get(k) for k in WRITING}
    for k, v in WRITING.items():
        spark.conf.set(k, v)
    try:
        df.write.option("parquet.block.size", ROW_GROUP).parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    return spark.read.schema(df.schema).parquet(path)


def unstage(df: DataFrame) -> None:
    """Delete the files behind a staged table that nothing needs any more."""
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()
    for folder in {f.rpartition("/")[0] for f in df.inputFiles() if "/staged-" in f}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def ranked(df: DataFrame, by: Sequence[str], order: Sequence[str], salt: Column, out: str = "rank") -> DataFrame:
    """Add `out`: 0, 1, 2, ... within each group of `by`, with no task per group.

    Rows of a group are dealt over the values of `salt` (few, and fixed for a
    row), numbered inside each, and shifted by the counts of the smaller salts.
    The order across salts is arbitrary, the numbers are gapless.
    """
    df = df.withColumn("_salt", salt)
    keys = [*by, "_salt"]
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*by).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0).cast("long"))).drop("_n")
    inside = Window.partitionBy(*keys).orderBy(*order)
    numbered = df.withColumn("_inside", F.row_number().over(inside) - 1)
    return numbered.join(counts, keys).withColumn(out, F.col("_before") + F.col("_inside")).drop("_salt", "_before", "_inside")


def text_column(df: DataFrame, text: str = "text") -> Column:
    """The text as a string; null counts as empty."""
    return F.coalesce(df[text].cast("string"), F.lit(""))


def held_out(doc_id: Column) -> Column:
    """Rows whose crc32 of the id as text leaves 0 modulo 5; a null id counts as empty text (crc 0)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def give_back() -> None:
    """Return a task's freed memory to the system, so that workers that wait for another task hold little."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except OSError:
        pass  # another C library: its own business


#: Text bytes that a Python step handles at once; a longer text is handled alone, and whole.
SLICE = 2 << 20


def slices(batch: pa.RecordBatch, most: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The batch's rows in order, cut so that a part's strings and binaries take about `most` bytes."""
    held = np.zeros(batch.num_rows, np.int64)
    for c in batch.columns:
        if pa.types.is_string(c.type) or pa.types.is_binary(c.type) or pa.types.is_large_string(c.type) or pa.types.is_large_binary(c.type):
            held += pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = np.cumsum(held) // most
    cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)


def map_batches(df: DataFrame, schema: str | T.StructType, make: Callable[[], Callable[[dict[str, list]], dict[str, object]]]) -> DataFrame:
    """mapInArrow with a function from columns (lists) to columns; `make` runs once per task.

    The result's columns are cast to `schema`. A step sees SLICE bytes of text or
    one text, so a task's memory does not follow the batch size.
    """
    out = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    fields = [(f.name, f.dataType) for f in out.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        types = {n: to_arrow_type(t) for n, t in fields}
        step = make()
        for batch in batches:
            for part in slices(batch):
                cols = step({n: c.to_pylist() for n, c in zip(part.schema.names, part.columns, strict=True)})
                yield pa.RecordBatch.from_arrays([pa.array(cols[n], types[n]) for n, _ in fields], names=[n for n, _ in fields])
        give_back()

    return df.mapInArrow(run, out)
