"""Announcements as dated chunks of text, and an index of their letters that a search reads instead of the texts."""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.typed import KINDS
from .disclosures import NOTICE, classify_notices
from .domains import event_id, pieces
from .masters import blank, source_tier

# Words that mark a chunk's subject, in their order.
KEYWORDS = ("减持", "增持", "回购", "质押", "解禁", "业绩", "问询", "监管", "处罚", "担保", "诉讼", "现金流", "订单", "减值")
#: Parts of an index by the hash of its letter pairs.
BUCKETS = 64
#: Chunks that an index tells apart by no pair.
BLOCK = 256


def clean(c: Column) -> Column:
    """White space collapsed and trimmed; null counts as empty."""
    return F.trim(F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"[ \t\n\r\f\x0B]+", " "))


def with_kinds(events: DataFrame) -> DataFrame:
    """Events without a kind of their own (or plain announcements) take the one that their title and category show, and its severity if they had none or info."""
    have = {c: F.col(c).cast("string") if c in events.columns else F.lit(None).cast("string") for c in ("event_type", "severity", "title")}
    category = F.coalesce(*[blank(F.col(c).cast("string")) for c in ("category", "event_category") if c in events.columns], F.lit(""))
    df = events.withColumns({**have, "_category": category, "_kind": have["event_type"], "_severity": have["severity"]})
    df = classify_notices(df, "title", "_category", None)
    inferred = F.trim(F.coalesce("_kind", F.lit(""))).isin("", NOTICE[0]) & (F.col("event_type") != NOTICE[0])
    weak = F.trim(F.coalesce("_severity", F.lit(""))).isin("", "info")
    kind, severity = F.when(inferred, F.col("event_type")).otherwise(F.col("_kind")), F.when(inferred & weak, F.col("severity")).otherwise(F.col("_severity"))
    return df.withColumns({"event_type": kind, "severity": severity}).drop("_category", "_kind", "_severity")


def evidence(events: DataFrame, as_of: Column, size: int = 220, lookback: int | None = None) -> DataFrame:
    """Chunks of `size` characters of each event's title, summary and evidence, with the columns of announcement evidence.

    An event counts from the first of available_at, announce_date and event_date that it has (else as_of); later ones than as_of, those
    before its last `lookback` days and those without text are left out. An event without an id gets one from its content.
    """
    dates = [F.col(c).cast("string").try_cast("date") for c in ("available_at", "announce_date", "event_date") if c in events.columns]
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in events.columns else F.lit("")
    df = with_kinds(events.withColumn("_at", F.coalesce(*dates, as_of))).where(F.col("_at") <= as_of)
    df = df.where(F.col("_at") >= F.date_sub(as_of, lookback)) if lookback is not None else df
    title = clean(F.col("title"))
    whole = F.array_join(F.filter(F.array(title, *[clean(text(c)) for c in ("summary", "evidence")]), lambda t: t != ""), " ")
    own = F.coalesce(blank(text("event_id")), F.concat(F.lit("event_"), event_id(text("instrument"), text("event_date"), whole)))
    df = df.withColumns({"_text": whole, "_id": own, "_title": title, "_tier": source_tier(F.trim(text("source")), F.trim(text("source_url")))})
    # words are looked for and slices cut once a text; the rows of its slices don't carry it
    words = F.array_join(F.array_compact(F.array(*[F.when(F.contains("_text", F.lit(w)), w) for w in KEYWORDS])), ",")
    df = df.withColumn("_words", words).drop("chunk_id", "chunk_text").select("*", F.posexplode(pieces(F.col("_text"), size)).alias("chunk_id", "chunk_text"))
    event_date = F.col("event_date").cast("string").try_cast("date") if "event_date" in events.columns else F.lit(None).cast("date")
    made = {
        "event_id": F.col("_id"), "instrument": text("instrument"), "event_type": F.coalesce("event_type", F.lit("")), "event_date": event_date, "available_at": F.col("_at"), "severity": F.coalesce("severity", F.lit("")), "title": F.col("_title"),
        "document_title": F.col("_title"), "source": F.trim(text("source")), "source_tier": F.col("_tier"), "official_source": F.col("_tier") == "official", "source_url": F.trim(text("source_url")), "evidence_url": F.trim(text("source_url")),
        "chunk_id": F.concat("_id", F.lit("_"), F.when(F.col("chunk_id") < 1000, F.lpad(F.col("chunk_id").cast("string"), 3, "0")).otherwise(F.col("chunk_id").cast("string"))), "chunk_text": F.col("chunk_text"), "keywords": F.col("_words"),
    }
    return df.select(*[made[c.split()[0]].alias(c.split()[0]) for c in KINDS["announcement_evidence"]])


def haystack() -> Column:
    """What a keyword is looked for in: title, text and keywords, in lower case."""
    return F.lower(F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in ("title", "chunk_text", "keywords")]))


def found_in(df: DataFrame, keyword: str | None = None, instruments: Sequence[str] = (), types: Sequence[str] = (), severities: Sequence[str] = (), as_of: Column | None = None, lookback: int | None = None) -> DataFrame:
    """Rows of evidence that pass every filter given."""
    for c, values in (("instrument", instruments), ("event_type", types), ("severity", severities)):
        df = df.where(F.col(c).isin(*values)) if values else df
    if as_of is not None:
        df = df.where(F.col("available_at") <= as_of)
        df = df.where(F.col("available_at") >= F.date_sub(as_of, lookback)) if lookback is not None else df
    word = (keyword or "").strip().lower()
    return df.where(F.contains(haystack(), F.lit(word))) if word else df


def newest(df: DataFrame, limit: int = 200) -> DataFrame:
    return df.orderBy(F.desc("available_at"), F.desc("event_date"), "instrument", "chunk_id").limit(limit)


def pairs_of_blocks(rows: DataFrame) -> DataFrame:
    """(month, block, gram): the pairs of neighbouring letters of the lower-case `text` of each block. A pair comes once for each batch with rows of its block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            month, block = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy()
            begin = np.flatnonzero(np.r_[True, (block[1:] != block[:-1]) | (month[1:] != month[:-1])])
            texts = batch.column(2).to_pylist()
            for a, b in zip(begin, [*begin[1:], len(block)], strict=True):
                codes = [np.frombuffer(t.encode("utf-32-le"), np.uint32).astype(np.int64) for t in texts[a:b]]
                found = np.unique(np.concatenate([(c[:-1] << 21) | c[1:] for c in codes]))
                grams = [chr(x >> 21) + chr(x & 0x1FFFFF) for x in found.tolist()]
                yield pa.RecordBatch.from_arrays([pa.array([month[a]] * len(grams), pa.string()), pa.array(np.full(len(grams), block[a])), pa.array(grams, pa.string())], names=["month", "block", "gram"])

    return rows.select("month", "block", "text").mapInArrow(run, "month string, block long, gram string")


class EvidenceIndex:
    """Evidence kept by month in blocks of BLOCK chunks, and beside it the pairs of neighbouring letters of each block, by month and hash of the pair.

    A search for a keyword of two letters or more reads the folders of its pairs and months only: a block with a chunk that holds the keyword has
    all its pairs. The blocks so found are read and searched, so the result is that of a scan. A keyword of one letter is a scan.
    A block has each pair once, so the index has a few rows per chunk instead of one for each of its letters.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def build(self, rows: DataFrame) -> EvidenceIndex:
        rows = rows.withColumn("month", F.coalesce(F.date_format("available_at", "yyyyMM"), F.lit("none"))).hint("rebalance", "month")
        # numbers of a task's rows in the order of months: a block of BLOCK rows is of few months
        rows = rows.sortWithinPartitions("month").withColumn("block", F.floor(F.monotonically_increasing_id() / BLOCK))
        rows.write.mode("overwrite").partitionBy("month").parquet(f"{self.path}/chunks")
        grams = pairs_of_blocks(self.chunks().withColumn("text", haystack())).withColumn("bucket", (F.crc32(F.col("gram").cast("binary")) % BUCKETS).cast("int"))
        # a pair in a third of all blocks makes one large part, which is split; the order lets a reader skip row groups
        grams.hint("rebalance", "month", "bucket").sortWithinPartitions("month", "bucket", "gram").write.mode("overwrite").partitionBy("month", "bucket").parquet(f"{self.path}/grams")
        return self

    def chunks(self) -> DataFrame:
        kinds = ", ".join(c if " " in c else f"{c} string" for c in KINDS["announcement_evidence"])
        return self.spark.read.schema(f"{kinds}, block long, month string").parquet(f"{self.path}/chunks")

    def postings(self, keyword: str) -> DataFrame:
        """(month, block) of blocks that have every pair of the keyword."""
        word = keyword.strip().lower()
        grams = sorted({word[i : i + 2] for i in range(len(word) - 1)})
        places = sorted({zlib.crc32(g.encode()) % BUCKETS for g in grams})
        df = self.spark.read.schema("block long, gram string, month string, bucket int").parquet(f"{self.path}/grams")
        hits = df.where(F.col("bucket").isin(*places) & F.col("gram").isin(*grams))
        return hits.groupBy("month", "block").agg(F.count_distinct("gram").alias("n")).where(F.col("n") >= len(grams)).select("month", "block")

    def search(self, keyword: str | None = None, as_of: str | None = None, lookback: int | None = None, limit: int = 200, **filters: Sequence[str]) -> DataFrame:
        """The newest `limit` chunks that pass all filters; as_of is a date as text, so that months are known before anything is read."""
        until = F.lit(as_of).cast("date") if as_of else None
        df, word = self.chunks(), (keyword or "").strip()
        months = F.lit(True)
        if as_of:
            months = F.col("month") <= as_of[:7].replace("-", "")
            if lookback is not None:
                import datetime as dt

                months = months & (F.col("month") >= f"{dt.date.fromisoformat(as_of) - dt.timedelta(lookback):%Y%m}")
        df = df.where(months)
        if len(word) > 1:
            df = df.join(self.postings(word).where(months), ["month", "block"], "left_semi")
        return newest(found_in(df, word, as_of=until, lookback=lookback, **filters).drop("block", "month"), limit)
