"""Event streams: tumbling counts behind a watermark, and the last row of each key kept in a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.tables import upsert_to
from ..sources.versioned import Store


def counted_windows(events: DataFrame, width: str, late: str, at: str = "ts", kind: str = "event_type", key: str = "event_id") -> DataFrame:
    """Distinct events by window and kind. Rows later than `late` are dropped by the watermark, repeats within it count once; works on batches too."""
    known = events.withWatermark(at, late)
    once = known.dropDuplicatesWithinWatermark([key]) if events.isStreaming else known.dropDuplicates([key])
    counted = once.groupBy(F.window(at, width).alias("w"), kind).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), kind, "n")


def upsert_stream(events: DataFrame, path: str, keys: list[str], checkpoint: str) -> StreamingQuery:
    """Keep the last row of each key in a small Parquet table, written anew by each micro-batch; a repeated one changes nothing. For tables that grow: upsert_store()."""

    def apply(batch: DataFrame, _: int) -> None:
        upsert_to(batch.sparkSession, batch, path, keys)

    return events.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def upsert_store(events: DataFrame, store: Store, table: str, keys: list[str], checkpoint: str) -> StreamingQuery:
    """Keep the last row of each key in a versioned table: a micro-batch rewrites only the parts that it touches, and readers see whole versions. A repeated one changes nothing."""

    def apply(batch: DataFrame, _: int) -> None:
        Store(batch.sparkSession, store.root).upsert({table: (batch, keys)})

    return events.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
