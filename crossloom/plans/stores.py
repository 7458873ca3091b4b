"""Tables written to the shared folder and read again: close prices in files, a keyed store, a ledger; with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.upserts import merge_domains
from ..sources import typed
from ..sources.shared import scratch
from ..sources.tables import brand_bars, nation_facts
from ..sources.versioned import Store
from .facts import FACTS
from .factors import BARS, rounded
from .masters import LEDGER, ledger


def source_closes(spark, sf_dir):
    """Bars in two nested folders of CSV files with headers of their own order; the second folder's years win."""
    bars = brand_bars(spark, sf_dir).select(F.col("instrument").alias("symbol"), F.col("datetime").alias("date"), "close", F.substring("instrument", 7, 2).alias("folder"))
    first, second = scratch(spark, "closes"), scratch(spark, "closes")
    bars.withColumn("open", F.lit(1)).repartition("folder").write.partitionBy("folder").csv(first, header=True)
    later = bars.where("year(date) >= 1997 and month(date) % 2 = 0").select("close", "folder", "date", "symbol").withColumn("close", F.col("close") + 1)
    later.repartition("folder").write.partitionBy("folder").csv(second, header=True)
    return rounded(typed.read_closes(spark, [first, second, f"{second}-missing"]), ["trade_date"], 4)


CLOSES = f"WITH {BARS} SELECT instrument, datetime AS trade_date, round(close + CASE WHEN year(datetime) >= 1997 AND month(datetime) % 2 = 0 THEN 1 ELSE 0 END, 4) AS close FROM bars"


def store_domains(spark, sf_dir):
    """Facts and bars kept as one version each: a first load, a correction of some keys with a new column, and a change that names one table only."""
    store = Store(spark, scratch(spark, "store"))
    facts = nation_facts(spark, sf_dir).select("instrument", "report_period", "revenue")
    bars = brand_bars(spark, sf_dir).select("instrument", "datetime", "close")
    merge_domains(store, {"facts": (facts.where("year(report_period) < 1997"), ["instrument", "report_period"])}, {"bars": (bars, ["instrument", "datetime"])})
    fixed = facts.where("month(report_period) = 6").withColumns({"revenue": F.col("revenue") + 0.5, "source": F.lit("fixed")})
    merge_domains(store, {"facts": (fixed, ["instrument", "report_period"])})
    return _both(store)


def _both(store: Store) -> DataFrame:
    facts = store.read("facts").select(F.lit("facts").alias("domain"), "instrument", F.col("report_period").alias("date"), F.col("revenue").alias("value"), "source")
    return rounded(facts.unionByName(store.read("bars").select(F.lit("bars").alias("domain"), "instrument", F.col("datetime").alias("date"), F.col("close").alias("value"), F.lit(None).cast("string").alias("source"))), ["date"], 4)


DOMAINS = f"""WITH {FACTS}, {BARS}
SELECT 'facts' AS domain, instrument, report_period AS date, round(revenue + CASE WHEN month(report_period) = 6 THEN 0.5 ELSE 0 END, 4) AS value, CASE WHEN month(report_period) = 6 THEN 'fixed' END AS source FROM facts WHERE year(report_period) < 1997 OR month(report_period) = 6
UNION ALL SELECT 'bars', instrument, datetime, round(close, 4), NULL FROM bars"""


def store_ledger(spark, sf_dir):
    """Runs appended in two batches, the first of them twice, and counted by status from the ledger."""
    store = Store(spark, scratch(spark, "ledger"))
    runs = ledger(spark, sf_dir).select(F.col("run").alias("run_id"), "status", "lane", F.col("time").alias("timestamp"), "primary_metric")
    early = F.col("lane") < "furniture"
    for batch, part in (("early", runs.where(early)), ("early", runs), ("late", runs.where(~early))):
        typed.append_ledger(store, part, batch)
    return store.read("ledger").groupBy("status").agg(F.count(F.lit(1)).alias("runs"), F.count_distinct("run_id").alias("names"), F.count("loop").alias("loops"))


def queries() -> dict:
    return {"source_closes": source_closes, "store_domains": store_domains, "store_ledger": store_ledger}


def oracle_sql() -> dict[str, str]:
    return {"source_closes": CLOSES, "store_domains": DOMAINS, "store_ledger": f"WITH {LEDGER} SELECT status, count(*) AS runs, count(DISTINCT run) AS names, CAST(0 AS BIGINT) AS loops FROM lg GROUP BY 1"}
