"""Queries over suppliers as securities, lines as price histories, events and documents as announcements, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import domains
from ..operators import masters as ms
from ..sources.tables import company_events, table
from .books import NEXT, TWO, target_on
from .factors import rounded

CODE = "lpad(CAST({} % 700 AS VARCHAR), 3, '0')"


def raw_days(spark, sf_dir) -> DataFrame:
    lines, k = table(spark, sf_dir, "lineitem"), F.col("l_orderkey")
    code = F.concat(F.element_at(F.array(*[F.lit(x) for x in "6095"]), (F.col("l_suppkey") % 4 + 1).cast("int")), F.lpad((F.col("l_suppkey") % 100_000).cast("string"), 5, "0"))
    order = F.concat_ws("/", *[F.lpad(F.col(c).cast("string"), 12, "0") for c in ("l_orderkey", "l_linenumber", "l_partkey")], F.format_string("%020.4f", F.col("l_extendedprice").cast("double")))
    return lines.select(code.alias("code"), F.to_date("l_shipdate").alias("date"), order.alias("order"), F.when(k % 11 != 0, F.col("l_extendedprice").cast("double")).alias("close"), F.when(k % 5 != 0, F.col("l_quantity").cast("double")).otherwise(0.0).alias("volume"), (F.col("l_extendedprice") / 10).cast("double").alias("amount"))


def master_prices(spark, sf_dir):
    days = raw_days(spark, sf_dir)
    keys = days.select("code", "date").distinct()
    factors = keys.where("day(date) % 2 = 0").withColumn("adj_factor", F.day("date") / 10)
    basics = keys.where("month(date) <= 6").withColumn("pb", F.month("date").cast("double"))
    return rounded(ms.price_history(days, factors, basics, ["pb"]), ["date"], 9)


PRICES = """WITH d AS (SELECT ['6', '0', '9', '5'][l_suppkey % 4 + 1] || lpad(CAST(l_suppkey % 100000 AS VARCHAR), 5, '0') AS code, CAST(l_shipdate AS DATE) AS date, CASE WHEN l_orderkey % 11 <> 0 THEN l_extendedprice END AS close, CASE WHEN l_orderkey % 5 <> 0 THEN l_quantity ELSE 0 END * 100 AS volume, l_extendedprice / 10 * 1000 AS amount, l_orderkey, l_linenumber, l_partkey FROM lineitem),
o AS (SELECT * FROM d WHERE close IS NOT NULL QUALIFY row_number() OVER (PARTITION BY code, date ORDER BY l_orderkey DESC, l_linenumber DESC, l_partkey DESC, close DESC) = 1)
SELECT code, date, round(CAST(close AS DOUBLE), 9) AS close, round(CAST(volume AS DOUBLE), 9) AS volume, round(CAST(amount AS DOUBLE), 9) AS amount, round(coalesce(CAST(amount AS DOUBLE) / nullif(volume, 0), close), 9) AS vwap, round(CASE WHEN day(date) % 2 = 0 THEN day(date) / 10 ELSE 1 END, 9) AS factor, CASE WHEN month(date) <= 6 THEN CAST(month(date) AS DOUBLE) END AS pb, CASE WHEN code[1] = '0' THEN 'SZ' ELSE 'SH' END || code AS instrument FROM o"""


HEADS = ("600", "688", "300", "830", "920", "000", "301", "430")


def raw_master(spark, sf_dir) -> DataFrame:
    s, k = table(spark, sf_dir, "supplier"), F.col("s_suppkey")
    head = F.element_at(F.array(*[F.lit(x) for x in HEADS]), (k % len(HEADS) + 1).cast("int"))
    name = F.when(k % 7 == 0, F.concat(F.lit("*ST "), "s_name")).when(k % 11 == 0, F.concat(F.lit(" "), "s_name", F.lit("退"))).when(k % 13 == 0, F.concat("s_name", F.lit(" est"))).otherwise(F.col("s_name"))
    return s.select(F.concat(head, F.lpad((k % 60).cast("string"), 3, "0")).alias("code"), name.alias("name"), F.when(k % 3 == 0, " ").otherwise(F.concat(F.lit("i"), (k % 9).cast("string"))).alias("industry"), "s_suppkey")


def master(spark, sf_dir) -> DataFrame:
    df = ms.snapshot(raw_master(spark, sf_dir), "s_suppkey", F.lit("1999-01-01").cast("date"))
    other = df.where("length(name) % 2 = 0 or is_st").select("instrument", F.lit("late").alias("industry"))
    return ms.enrich_industries(df, other)


def master_snapshot(spark, sf_dir):
    return rounded(master(spark, sf_dir), ["as_of"])


MASTER = f"""r AS (SELECT {list(HEADS)}[s_suppkey % {len(HEADS)} + 1] || lpad(CAST(s_suppkey % 60 AS VARCHAR), 3, '0') AS code, CASE WHEN s_suppkey % 7 = 0 THEN '*ST ' || s_name WHEN s_suppkey % 11 = 0 THEN s_name || '退' WHEN s_suppkey % 13 = 0 THEN s_name || ' est' ELSE s_name END AS name, CASE WHEN s_suppkey % 3 <> 0 THEN 'i' || (s_suppkey % 9) END AS ind, s_suppkey FROM supplier),
t AS (SELECT CASE WHEN code[1] IN ('5', '6', '9') THEN 'SH' ELSE 'SZ' END || code AS instrument, upper(name) LIKE '%ST%' OR name LIKE '%退%' AS is_st, * FROM r),
u AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY instrument ORDER BY s_suppkey DESC) = 1),
ma AS (SELECT instrument, name, CASE WHEN instrument LIKE 'SH%' THEN 'SSE' ELSE 'SZSE' END AS exchange, CASE WHEN code[1:3] IN ('688', '689') THEN 'STAR' WHEN code[1:3] IN ('300', '301') THEN 'ChiNext' WHEN code[1] IN ('8', '4') OR code[1:3] = '920' THEN 'BSE' ELSE 'main' END AS board, is_st, DATE '1999-01-01' AS as_of, CASE WHEN ind IS NOT NULL THEN 'master' WHEN length(name) % 2 = 0 OR is_st THEN 'other' ELSE '' END AS industry_source, coalesce(ind, CASE WHEN length(name) % 2 = 0 OR is_st THEN 'late' END, '') AS industry, s_suppkey FROM u)"""


def master_history(spark, sf_dir):
    """Versions by outside history, listing or first trade, beside the intervals of names."""
    base = master(spark, sf_dir).withColumn("listed", F.when(F.col("board") != "main", F.lit("1995-02-01").cast("date")))
    out = base.where("is_st").select("instrument", F.concat("name", F.lit("!")).alias("name"), F.lit("1996-01-01").cast("date").alias("valid_from"), F.lit("1997-01-01").cast("date").alias("valid_to"))
    prices = base.where("board = 'main' and exchange = 'SSE'").select("instrument", F.lit("1994-05-05").cast("date").alias("date"))
    changes = base.where("board = 'STAR'").select("instrument", F.concat(F.lit("st "), "name").alias("name"), F.lit("1998-01-01").cast("date").alias("start"), F.lit(None).cast("date").alias("end"))
    made = ms.history(base, prices, out).select("instrument", "name", "valid_from", "valid_to", "origin")
    names = ms.name_history(base, changes).select("instrument", "name", "valid_from", "valid_to", F.when(F.col("is_st"), "name_st").otherwise("name").alias("origin"))
    return rounded(made.unionByName(names), ["valid_from", "valid_to"])


HISTORY = f"""WITH {MASTER}, l AS (SELECT *, CASE WHEN board <> 'main' THEN DATE '1995-02-01' END AS listed FROM ma)
SELECT instrument, name || '!' AS name, DATE '1996-01-01' AS valid_from, DATE '1997-01-01' AS valid_to, 'history' AS origin FROM l WHERE is_st
UNION ALL SELECT instrument, name, coalesce(listed, CASE WHEN exchange = 'SSE' THEN DATE '1994-05-05' END), NULL, 'snapshot' FROM l WHERE NOT is_st
UNION ALL SELECT instrument, CASE WHEN board = 'STAR' THEN 'st ' || name ELSE name END, CASE WHEN board = 'STAR' THEN DATE '1998-01-01' ELSE listed END, NULL, CASE WHEN board = 'STAR' OR is_st THEN 'name_st' ELSE 'name' END FROM l"""


def master_industries(spark, sf_dir):
    k = F.col("s_suppkey")
    raw = table(spark, sf_dir, "supplier").select((k % 20).cast("string").alias("instrument"), F.concat(F.lit("i"), (k % 6).cast("string")).alias("industry"), F.element_at(F.array(F.lit("old"), F.lit("new"), F.lit("odd")), (k % 3 + 1).cast("int")).alias("standard"), F.date_add(F.lit("1995-01-01").cast("date"), (k % 40).cast("int")).alias("date")).where("instrument <> '7' or standard = 'odd'")
    universes = table(spark, sf_dir, "nation").select(F.concat(F.lit("u"), (F.col("n_regionkey")).cast("string")).alias("universe"), (F.col("n_nationkey") % 18).cast("string").alias("instrument"))
    return ms.in_universes(ms.preferred_industry(raw, ["new", "old"]), universes)


INDUSTRIES = """WITH r AS (SELECT CAST(s_suppkey % 20 AS VARCHAR) AS instrument, 'i' || (s_suppkey % 6) AS industry, ['old', 'new', 'odd'][s_suppkey % 3 + 1] AS standard, DATE '1995-01-01' + CAST(s_suppkey % 40 AS INT) AS date FROM supplier),
p AS (SELECT instrument, industry, standard FROM r WHERE instrument <> '7' OR standard = 'odd' QUALIFY row_number() OVER (PARTITION BY instrument ORDER BY CASE standard WHEN 'new' THEN 1 WHEN 'old' THEN 2 ELSE 3 END, date DESC, industry) = 1)
SELECT p.*, string_agg(DISTINCT 'u' || n_regionkey, ',' ORDER BY 'u' || n_regionkey) AS universes FROM p JOIN nation ON CAST(n_nationkey % 18 AS VARCHAR) = p.instrument GROUP BY ALL"""

TAXONOMY = {"purchase": ("trade", "info", "note"), "error": ("fault", "block", "block_buy")}


def event_classes(spark, sf_dir):
    e = ms.classify(company_events(spark, sf_dir).drop("severity"), TAXONOMY)
    return e.groupBy("event_type", "event_class", "severity", "action").agg(F.count(F.lit(1)).alias("n"))


def event_capital(spark, sf_dir):
    n = F.length("event_id")
    e = company_events(spark, sf_dir).withColumns({"announce_date": F.when(n % 2 == 0, F.date_add("event_date", 1)), "available_at": F.when(n % 3 == 0, F.date_add("event_date", 5)), "source": F.when(n % 2 == 1, " ").otherwise("vendor")})
    return rounded(ms.capital_events(e, ["purchase", "signup"]), ["announce_date", "available_at"])


EVENT = "ev AS (SELECT CAST(user_id AS VARCHAR) AS instrument, CAST(event_id AS VARCHAR) AS event_id, event_type, CASE event_type WHEN 'error' THEN 'block' WHEN 'purchase' THEN 'watch' WHEN 'signup' THEN 'risk' ELSE 'info' END AS severity, CAST(ts AS DATE) AS event_date FROM events)"


def event_library(spark, sf_dir):
    return rounded(ms.event_library(company_events(spark, sf_dir)), ["latest"])


def announcements(spark, sf_dir) -> DataFrame:
    """Chunks of documents as announcements."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    made = domains.chunks(docs).withColumns({"instrument": (F.col("doc_id") % 50).cast("string"), "event_id": F.col("doc_id").cast("string"), "event_date": F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 30).cast("int"))})
    return made.withColumn("source_url", F.concat(F.lit("http://"), F.when(F.col("doc_id") % 3 == 0, "www.cninfo.com.cn/").when(F.col("doc_id") % 3 == 1, "finance.eastmoney.com/").otherwise("x.org/"), "event_id"))


def text_evidence(spark, sf_dir):
    """The evidence by tier of its source: chunks, events, instruments, and money and percentages in the texts."""
    df = announcements(spark, sf_dir).withColumn("tier", ms.source_tier(F.lit(None).cast("string"), F.col("source_url")))
    total = ms.evidence_summary(df).withColumn("tier", F.lit("all"))
    parts = [ms.evidence_summary(df.where(F.col("tier") == t)).withColumn("tier", F.lit(t)) for t in ("official", "aggregator", "unknown")]
    for p in parts:
        total = total.unionByName(p)
    return total


def text_found(spark, sf_dir):
    """The newest 200 chunks of a month with a word: a top-k report."""
    found = ms.evidence_search(announcements(spark, sf_dir), "the", instruments=[str(i) for i in range(0, 50, 3)], as_of=F.lit("2024-01-20").cast("date"), lookback=10)
    return found.select("instrument", "event_date", "event_id", "chunk_id")


def text_intensity(spark, sf_dir):
    """The intensity of the money and percentages in every order's text, by the unit that the text has: Chinese, English or none."""
    k = F.col("o_orderkey")
    unit = F.element_at(F.array(*[F.lit(u) for u in ("万元", "亿", " million", "billion", "km")]), (k % 5 + 1).cast("int"))
    text = F.concat(F.lit("about "), (k % 977).cast("string"), unit, F.lit(" of 12.5万, "), (k % 13).cast("string"), F.lit(".5 %"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", ms.money_intensity(text, ms.ALL_UNITS).alias("money"), domains.percent_intensity(text).alias("percent"))
    return rounded(rows.groupBy((k % 5).alias("unit")).agg(F.sum(F.round("money", 8)).alias("money"), F.sum(F.round("percent", 8)).alias("percent")), [], 3)


def read_evidence(spark, sf_dir):
    """Cards of a month's positions with the events of users as evidence, flattened again."""
    p = target_on(spark, sf_dir, NEXT).withColumn("user", (F.col("rank") * 3).cast("string"))
    events = company_events(spark, sf_dir).join(p.select(F.col("user").alias("instrument"), F.col("instrument").alias("name")), "instrument").drop("instrument").withColumnRenamed("name", "instrument")
    evidence = ms.rolling_evidence(events, p.select("instrument"), F.lit("2024-01-20").cast("date"), 10)
    items = ms.card_items(ms.cards(p, evidence, "caution"))
    counts = evidence.select("instrument", "event_count", F.coalesce(F.try_element_at("severity_counts", F.lit("block")), F.lit(0)).alias("blocks"))
    return rounded(items.join(counts, "instrument"), ["event_date"])


EVIDENCE = f"""WITH {TWO}, {EVENT}, pe AS (SELECT tn.instrument, ev.event_id, event_type, severity, event_date FROM ev JOIN tn ON ev.instrument = CAST(tn.rank * 3 AS VARCHAR) WHERE event_date BETWEEN DATE '2024-01-10' AND DATE '2024-01-20'),
k AS (SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY event_date DESC, event_id) AS place, count(*) OVER (PARTITION BY instrument) AS event_count, count(*) FILTER (severity = 'block') OVER (PARTITION BY instrument) AS blocks FROM pe)
SELECT instrument, 'caution' AS decision, place, event_id, event_type, severity, event_date, event_count, blocks FROM k WHERE place <= 5"""


def read_health(spark, sf_dir):
    m = master(spark, sf_dir)
    e = company_events(spark, sf_dir).select(F.concat(F.lit("SH600"), F.lpad("instrument", 3, "0")).alias("instrument"))
    return rounded(ms.context_health(m, e, ["industry", "name"]), [])


def ledger(spark, sf_dir) -> DataFrame:
    k = F.col("o_orderkey")
    status = F.element_at(F.array(*[F.lit(x) for x in ("review", "discard_candidate", "crash")]), (k % 3 + 1).cast("int"))
    return table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min("o_orderkey").alias("o_orderkey")), F.col("c_custkey") == F.col("o_custkey")).select(
        F.format_string("run%06d", "c_custkey").alias("run"), F.lower("c_mktsegment").alias("lane"), F.when(F.col("c_mktsegment") == "BUILDING", "crash").otherwise(status).alias("status"), F.when(k % 3 == 1, "low;thin").when(k % 3 == 2, "thin").alias("reason"),
        F.when(k % 4 == 0, "").otherwise(F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (k % 300).cast("int")), "yyyy-MM-dd")).alias("time"), F.when(k % 7 == 0, "x").otherwise((k % 101).cast("string")).alias("primary_metric"),
    )


def research_queue(spark, sf_dir):
    return rounded(ms.queue(ledger(spark, sf_dir)).select("run", "status", "primary_metric", "place", "status_size"), [])


def research_lanes(spark, sf_dir):
    return rounded(ms.lanes(ledger(spark, sf_dir)), [])


def research_reasons(spark, sf_dir):
    return ms.value_counts(ledger(spark, sf_dir), "reason", ["status"])


LEDGER = """lg AS (SELECT printf('run%06d', c_custkey) AS run, lower(c_mktsegment) AS lane, CASE WHEN c_mktsegment = 'BUILDING' THEN 'crash' ELSE ['review', 'discard_candidate', 'crash'][k % 3 + 1] END AS status, CASE k % 3 WHEN 1 THEN 'low;thin' WHEN 2 THEN 'thin' END AS reason, CASE WHEN k % 4 <> 0 THEN DATE '2024-01-01' + CAST(k % 300 AS INT) END AS time, CASE WHEN k % 7 <> 0 THEN CAST(k % 101 AS DOUBLE) END AS m FROM customer JOIN (SELECT o_custkey, min(o_orderkey) AS k FROM orders GROUP BY 1) ON c_custkey = o_custkey)"""


def run_date(spark, sf_dir):
    days = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("date"))
    end = F.lit("1996-02-30").try_cast("date")
    until = F.coalesce(end, F.lit("1996-06-15").cast("date"))
    return ms.last_date(days, until, until).withColumn("kind", F.lit("latest")).unionByName(ms.last_date(days.where("false"), until, until).withColumn("kind", F.lit("empty")))


def queries() -> dict:
    return {
        "master_prices": master_prices, "master_snapshot": master_snapshot, "master_history": master_history, "master_industries": master_industries, "event_classes": event_classes, "event_capital": event_capital, "event_library": event_library, "text_evidence": text_evidence, "text_found": text_found,
        "text_intensity": text_intensity, "read_evidence": read_evidence, "read_health": read_health, "research_queue": research_queue, "research_lanes": research_lanes, "research_reasons": research_reasons, "run_date": run_date,
    }


def oracle_sql() -> dict[str, str]:
    from .facts import CHUNKS

    chunked = CHUNKS.partition("SELECT doc_id, chunk_id")[0]
    tier = "CASE doc_id % 3 WHEN 0 THEN 'official' WHEN 1 THEN 'aggregator' ELSE 'unknown' END"
    stats = "count(*) AS chunks, count(DISTINCT doc_id) AS events, count(DISTINCT doc_id % 50) AS instruments, count(DISTINCT doc_id) AS urls"
    return {
        "master_prices": PRICES, "master_snapshot": f"WITH {MASTER} SELECT * EXCLUDE (s_suppkey) FROM ma", "master_history": HISTORY, "master_industries": INDUSTRIES,
        "event_classes": "SELECT event_type, CASE event_type WHEN 'purchase' THEN 'trade' WHEN 'error' THEN 'fault' ELSE 'other' END AS event_class, CASE event_type WHEN 'purchase' THEN 'info' WHEN 'error' THEN 'block' ELSE 'watch' END AS severity, CASE event_type WHEN 'purchase' THEN 'note' WHEN 'error' THEN 'block_buy' ELSE 'watch_risk' END AS action, count(*) AS n FROM events GROUP BY 1",
        "event_capital": f"WITH {EVENT}, a AS (SELECT *, length(event_id) AS n, CASE WHEN length(event_id) % 2 = 0 THEN CAST(event_date + 1 AS DATE) ELSE event_date END AS announce_date FROM ev WHERE event_type IN ('purchase', 'signup')) SELECT instrument, event_id, event_type, announce_date, CASE WHEN n % 3 = 0 THEN CAST(event_date + 5 AS DATE) ELSE announce_date END AS available_at, CASE WHEN n % 2 = 1 THEN 'company_events' ELSE 'vendor' END AS source FROM a",
        "event_library": f"WITH {EVENT} SELECT 'event_type' AS kind, event_type AS value, count(*) AS events, count(DISTINCT instrument) AS instruments, max(event_date) AS latest FROM ev GROUP BY 2 UNION ALL SELECT 'severity', severity, count(*), count(DISTINCT instrument), max(event_date) FROM ev GROUP BY 2 UNION ALL SELECT 'total', 'all', count(*), count(DISTINCT instrument), max(event_date) FROM ev",
        "text_evidence": f"{chunked} SELECT 'all' AS tier, {stats} FROM c UNION ALL SELECT {tier}, {stats} FROM c GROUP BY 1",
        "text_found": f"{chunked}, x AS (SELECT CAST(doc_id % 50 AS VARCHAR) AS instrument, DATE '2024-01-01' + CAST(doc_id % 30 AS INT) AS event_date, CAST(doc_id AS VARCHAR) AS event_id, chunk_id, lower(substring(t, chunk_id * 500 + 1, 500)) AS s FROM c WHERE doc_id % 50 % 3 = 0) SELECT instrument, event_date, event_id, chunk_id FROM x WHERE event_date BETWEEN DATE '2024-01-10' AND DATE '2024-01-20' AND contains(s, 'the') ORDER BY event_date DESC, instrument DESC, chunk_id LIMIT 200",
        "text_intensity": "WITH a AS (SELECT o_orderkey % 5 AS unit, o_orderkey % 977 * [1e4, 1e8, 1e6, 1e9, 0][o_orderkey % 5 + 1] AS v, o_orderkey % 13 + 0.5 AS p FROM orders), m AS (SELECT unit, greatest(v, 125000) AS v, p FROM a) SELECT unit, round(sum(round(greatest(1, least(3, 1 + log10(v / 1e7))), 8)), 3) AS money, round(sum(round(greatest(1e0, least(3e0, 1 + p / 3)), 8)), 3) AS percent FROM m GROUP BY 1",
        "read_evidence": EVIDENCE,
        "read_health": f"WITH {MASTER} SELECT count(*) AS securities, round(avg(CASE WHEN industry <> '' THEN 1e0 ELSE 0e0 END), 6) AS industry_coverage, 1e0 AS name_coverage, round(avg(CASE WHEN instrument IN (SELECT 'SH600' || lpad(CAST(user_id AS VARCHAR), 3, '0') FROM events) THEN 1e0 ELSE 0e0 END), 6) AS event_coverage FROM ma",
        "research_queue": f"WITH {LEDGER} SELECT run, status, m AS primary_metric, row_number() OVER (ORDER BY time DESC NULLS LAST, run) AS place, count(*) OVER (PARTITION BY status) AS status_size FROM lg",
        "research_lanes": f"WITH {LEDGER}, a AS (SELECT lane, count(*) AS runs, count(*) FILTER (status = 'crash') AS crashes, arg_max(run, (m, run)) FILTER (m IS NOT NULL) AS best_run, max(m) AS best_metric FROM lg GROUP BY 1) SELECT *, CASE WHEN crashes / runs >= 0.5 THEN 'failing' WHEN best_metric IS NULL THEN 'silent' WHEN crashes > 0 THEN 'degraded' ELSE 'healthy' END AS health FROM a",
        "research_reasons": f"WITH {LEDGER} SELECT status, value, count(*) AS n FROM (SELECT status, unnest(string_split(reason, ';')) AS value FROM lg) GROUP BY 1, 2",
        "run_date": "SELECT 'latest' AS kind, max(CAST(o_orderdate AS DATE)) AS run_date FROM orders WHERE CAST(o_orderdate AS DATE) <= DATE '1996-06-15' UNION ALL SELECT 'empty', DATE '1996-06-15'",
    }
