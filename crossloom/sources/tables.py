"""Panels and fact tables derived from the star schema, and tolerant readers and writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import div


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def month(c: Column) -> Column:
    return F.trunc(F.to_date(c), "month")


def _bars(lines: DataFrame, instrument) -> DataFrame:
    price = div(F.col("l_extendedprice"), F.col("l_quantity"))
    rounded = lambda c, n=8: F.round(c, n)
    return lines.groupBy(instrument.alias("instrument"), month(F.col("l_shipdate")).alias("datetime")).agg(
        rounded(F.avg(price)).alias("open"),
        rounded(F.max(price)).alias("high"),
        rounded(F.min(price)).alias("low"),
        rounded(div(F.sum("l_extendedprice"), F.sum("l_quantity"))).alias("close"),
        rounded(F.sum("l_quantity"), 2).alias("volume"),
        rounded(F.sum("l_extendedprice"), 2).alias("amount"),
    )


def brand_bars(spark: SparkSession, sf_dir: str, names: DataFrame | None = None) -> DataFrame:
    """Monthly bars of each brand, or of those in `names` (instrument) only: other parts then never meet the lines. `part` is a dimension table: Spark broadcasts it when it is small."""
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_shipdate", "l_quantity", "l_extendedprice")
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    if names is not None:
        parts = parts.join(names.select(F.col("instrument").alias("p_brand")), "p_brand", "left_semi")
    return _bars(lines.join(parts, "l_partkey"), F.col("p_brand"))


def supplier_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly bars of each supplier: many more instruments than brands."""
    return _bars(table(spark, sf_dir, "lineitem").select("l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice"), F.col("l_suppkey").cast("string"))


def nation_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of each nation and quarter: report_period (quarter end), available_at, revenue, orders."""
    orders, customers = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    quarter = F.last_day(F.add_months(F.trunc(F.to_date("o_orderdate"), "quarter"), 2))
    facts = (
        orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .groupBy(F.col("c_nationkey").cast("string").alias("instrument"), quarter.alias("report_period"))
        .agg(F.round(F.sum("o_totalprice"), 2).alias("revenue"), F.count(F.lit(1)).alias("orders"))
    )
    return facts.withColumn("available_at", announced_by(F.col("report_period")))


def announced_by(period: Column) -> Column:
    """The last day by which a report of that period is out: Q1 30 April, H1 31 August, Q3 31 October, year 30 April after; else 120 days."""
    year, day = F.year(period), F.date_format(period, "MM-dd")
    on = lambda y, m, d: F.make_date(y, F.lit(m), F.lit(d))
    return F.when(day == "03-31", on(year, 4, 30)).when(day == "06-30", on(year, 8, 31)).when(day == "09-30", on(year, 10, 31)).when(day == "12-31", on(year + 1, 4, 30)).otherwise(F.date_add(period, 120))


def company_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as dated risk rows of an instrument (the user)."""
    events = table(spark, sf_dir, "events")
    severity = F.when(F.col("event_type") == "error", "block").when(F.col("event_type") == "purchase", "watch").when(F.col("event_type") == "signup", "risk").otherwise("info")
    return events.select(F.col("user_id").cast("string").alias("instrument"), F.col("event_id").cast("string").alias("event_id"), "event_type", severity.alias("severity"), F.to_date("ts").alias("event_date"), "value")


# Readers that treat a missing file as an empty table, and writers.


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(p)


def read_csv(spark: SparkSession, path: str, schema: str | T.StructType, sep: str = ",") -> DataFrame:
    """CSV with a header; a missing path gives no rows, a missing column nulls."""
    wanted = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    if not exists(spark, path):
        return spark.createDataFrame([], wanted)
    found = spark.read.csv(path, header=True, sep=sep, recursiveFileLookup=True)
    return found.select(*[(F.expr(f"try_cast(`{f.name}` AS {f.dataType.simpleString()})") if f.name in found.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in wanted.fields])


def read_jsonl(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    wanted = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    return spark.read.schema(wanted).json(path) if exists(spark, path) else spark.createDataFrame([], wanted)


def write(df: DataFrame, path: str, kind: str = "parquet", partition_by: str | None = None, mode: str = "overwrite") -> None:
    """Parquet, JSON lines, CSV or TSV with a header; one folder per value of `partition_by`."""
    w = df.write.mode(mode)
    w = w.partitionBy(partition_by) if partition_by else w
    match kind:
        case "parquet":
            w.parquet(path)
        case "json":
            w.json(path)
        case "csv" | "tsv":
            w.csv(path, header=True, sep="\t" if kind == "tsv" else ",")
        case _:
            raise ValueError(f"unknown kind {kind}")


def upsert_to(spark: SparkSession, new: DataFrame, path: str, keys: list[str]) -> None:
    """Merge rows into a Parquet table, the last of a key wins.

    The merged table is written beside the old one, which steps aside and goes only when the new one is in its place:
    at any moment one whole table is there, and a run that finds only the one set aside puts it back.
    """
    from ..operators.upserts import keep_last

    p = spark._jvm.org.apache.hadoop.fs.Path
    fs = p(path).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    aside = f"{path.rstrip('/')}.old"
    if not exists(spark, path) and exists(spark, aside):
        fs.rename(p(aside), p(path))
    merged = keep_last(spark.read.parquet(path), new, keys) if exists(spark, path) else new
    beside = f"{path.rstrip('/')}.next"
    merged.write.mode("overwrite").parquet(beside)
    fs.delete(p(aside), True)
    if exists(spark, path) and not fs.rename(p(path), p(aside)):
        raise OSError(f"could not set {path} aside")
    if not fs.rename(p(beside), p(path)):
        raise OSError(f"could not put {beside} in the place of {path}")
    fs.delete(p(aside), True)
