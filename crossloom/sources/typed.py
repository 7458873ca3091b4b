"""Named kinds of CSV tables: their columns, readers that fill in what a file lacks, and writers by instrument."""

from __future__ import annotations

import io
from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import exists
from .versioned import Store

# The columns of each kind, in order. Text unless said otherwise.
KINDS: dict[str, tuple[str, ...]] = {
    "security_master": ("instrument", "name", "exchange", "board", "industry_sw", "industry_csrc", "is_st boolean", "listing_date date", "delisting_date date", "valid_from date", "valid_to date"),
    "company_events": ("event_id", "instrument", "event_type", "event_date date", "source", "source_url", "title", "severity", "summary", "evidence", "active_until date"),
    "announcement_evidence": (
        "event_id", "instrument", "event_type", "event_date date", "available_at date", "severity", "title", "document_title", "source", "source_tier", "official_source boolean", "source_url", "evidence_url",
        "chunk_id", "chunk_text", "keywords",
    ),
    "closes": ("instrument", "trade_date date", "close double"),
    "positions": ("instrument", "current_weight double"),
    "ledger": (
        "timestamp", "run_id", "commit", "loop", "contract", "candidate_name", "candidate_file", "candidate_hash", "status", "decision_reason", "primary_metric", "secondary_metric", "guard_metric", "rank_ic_mean_h5",
        "rank_ic_mean_h20", "neutral_rank_ic_mean_h5", "neutral_rank_ic_mean_h20", "long_short_mean_return_h20", "top_quantile_turnover_h20", "observations_h20", "complexity_score", "artifact_dir", "elapsed_sec",
    ),
}
#: Columns that close prices have in their files under other names.
RENAMED = {"closes": {"date": "trade_date", "symbol": "instrument"}}


def schema_of(kind: str) -> T.StructType:
    return T._parse_datatype_string(", ".join(c if " " in c else f"{c} string" for c in KINDS[kind]))


def scan(spark: SparkSession, paths: str | Sequence[str] | None, columns: Sequence[str], sep: str = ",", file: str | None = None, required: Sequence[str] = (), renamed: Mapping[str, str] | None = None) -> DataFrame:
    """Every CSV file at or below the paths, by its own header: `columns` as text, null where a file lacks one, and in `file` the path it came from.

    None and paths that don't exist give no rows; files without one of `required` give none either. Files are found and read by Spark and parsed in
    tasks, one file at a time, so their headers may differ; a file must fit a task (tables of one header in large files: tables.read_csv).
    Empty fields are null. Quoted fields may hold line ends.
    """
    names = [*columns, *([file] if file else [])]
    schema = T.StructType([T.StructField(c, T.StringType()) for c in names])
    found = [p for p in ([paths] if isinstance(paths, str) else paths or []) if exists(spark, p)]
    if not found:
        return spark.createDataFrame([], schema)
    back = {v: k for k, v in (renamed or {}).items()}
    wanted = {c: (c, back.get(c, c)) for c in columns}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.csv as csv

        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1), strict=True):
                data = content.as_py()
                if not data or not data.strip():
                    continue
                header = csv.open_csv(io.BytesIO(data), parse_options=csv.ParseOptions(delimiter=sep, newlines_in_values=True)).schema.names
                table = csv.read_csv(io.BytesIO(data), parse_options=csv.ParseOptions(delimiter=sep, newlines_in_values=True), convert_options=csv.ConvertOptions(column_types=dict.fromkeys(header, pa.string()), strings_can_be_null=True, null_values=[""], quoted_strings_can_be_null=True))
                at = {c: next((n for n in options if n in header), None) for c, options in wanted.items()}
                if any(at.get(c) is None for c in required):
                    continue
                for part in table.to_batches():
                    values = [part.column(header.index(at[c])) if at[c] else pa.nulls(part.num_rows, pa.string()) for c in columns]
                    yield pa.RecordBatch.from_arrays([*values, *([pa.repeat(path, part.num_rows).cast(pa.string())] if file else [])], names=names)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.[ct]sv").load(list(found))
    return files.select("path", "content").mapInArrow(run, schema)


def read_kind(spark: SparkSession, kind: str, paths: str | Sequence[str] | None, sep: str = ",", file: str | None = None) -> DataFrame:
    """Rows of a named kind with its columns and types; what can't be read as its type is null. Other columns are left out."""
    schema = schema_of(kind)
    need = schema.names if kind == "closes" else ()
    df = scan(spark, paths, schema.names, sep, file, need, RENAMED.get(kind))
    typed = [F.col(f.name).try_cast(f.dataType).alias(f.name) if not isinstance(f.dataType, T.StringType) else F.col(f.name) for f in schema.fields]
    return df.select(*typed, *([file] if file else []))


def read_closes(spark: SparkSession, folders: Sequence[str]) -> DataFrame:
    """Close prices of all files below the folders, one per instrument and date: that of the last file by folder (as listed), then by path."""
    parts = [read_kind(spark, "closes", f, file="_file").withColumn("_folder", F.lit(i)) for i, f in enumerate(folders)]
    if not parts:
        return spark.createDataFrame([], schema_of("closes"))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows.groupBy("instrument", "trade_date").agg(F.max_by("close", F.struct("_folder", "_file", "close")).alias("close"))


def write_by_instrument(df: DataFrame, path: str, columns: Sequence[str] | None = None) -> None:
    """One folder per instrument, CSV with a header and fixed columns; only the folders of instruments that df has are replaced.

    A filter on the instrument reads that folder alone.
    """
    if columns is not None:
        df = df.select("instrument", *[F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns if c != "instrument"])
    df.repartition("instrument").sortWithinPartitions("instrument").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("instrument").csv(path, header=True)


def read_by_instrument(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What write_by_instrument() wrote; schema names the other columns in their order."""
    return spark.read.schema(f"{schema}, instrument string").csv(path, header=True)


def append_ledger(store: Store, df: DataFrame, batch: str, name: str = "ledger") -> int:
    """Add runs to the ledger, once per batch name, with the ledger's columns only."""
    text = df.select(*[F.col(c).cast("string").alias(c) for c in df.columns])
    return store.append(name, text, batch, KINDS["ledger"])
