"""Documents as announcements: evidence chunks, and searches by an index, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import evidence as ev
from ..sources.shared import scratch
from ..sources.tables import table
from .factors import rounded
from .notices import _CASE, WORDS

AS_OF, LOOKBACK = "2024-02-20", 40


def announced(spark, sf_dir) -> DataFrame:
    """Documents as events: a title with a rule's word for some, a kind for others, dates of which some are missing."""
    d, k = table(spark, sf_dir, "documents"), F.col("doc_id")
    word = F.element_at(F.array(*[F.lit(w) for w in WORDS]), (k % len(WORDS) + 1).cast("int"))
    day = F.date_add(F.lit("2024-01-01").cast("date"), (k % 60).cast("int"))
    return d.select(k.cast("string").alias("event_id"), (k % 50).cast("string").alias("instrument"), F.when(k % 4 == 0, F.concat(F.lit(" 关于 "), word)).when(k % 4 == 1, "plain").alias("title"), F.when(k % 4 == 1, "lawsuit").when(k % 8 == 0, "announcement").alias("event_type"), F.when(k % 3 == 0, "watch").when(k % 3 == 1, "info").alias("severity"),
                    F.when(k % 5 != 0, day).alias("event_date"), F.when(k % 7 == 0, F.date_add(day, 3)).alias("available_at"), "source", F.when(k % 2 == 0, " http://www.sse.com.cn/a ").alias("source_url"), F.col("text").alias("summary"), F.col("lang").alias("evidence"))


def evidence_table(spark, sf_dir):
    """Every chunk of the documents that count by a day, with its text's digest."""
    df = ev.evidence(announced(spark, sf_dir), F.lit(AS_OF).cast("date"), lookback=LOOKBACK)
    return rounded(df.select("chunk_id", "event_id", "instrument", "event_type", "severity", "event_date", "available_at", "title", "source_tier", "official_source", "source_url", "keywords", F.md5("chunk_text").alias("digest")), ["event_date", "available_at"])


EVIDENCE = rf"""e AS (SELECT CAST(doc_id AS VARCHAR) AS event_id, CAST(doc_id % 50 AS VARCHAR) AS instrument, CASE doc_id % 4 WHEN 0 THEN '关于 ' || {list(WORDS)}[doc_id % {len(WORDS)} + 1] WHEN 1 THEN 'plain' ELSE '' END AS title, CASE WHEN doc_id % 4 = 1 THEN 'lawsuit' WHEN doc_id % 8 = 0 THEN 'announcement' ELSE '' END AS kind, CASE doc_id % 3 WHEN 0 THEN 'watch' WHEN 1 THEN 'info' ELSE '' END AS sev,
  CASE WHEN doc_id % 5 <> 0 THEN DATE '2024-01-01' + CAST(doc_id % 60 AS INT) END AS event_date, CASE WHEN doc_id % 7 = 0 THEN DATE '2024-01-01' + CAST(doc_id % 60 + 3 AS INT) END AS av, CASE WHEN doc_id % 2 = 0 THEN 'http://www.sse.com.cn/a' ELSE '' END AS source_url, trim(regexp_replace(coalesce(text, ''), '[ \t\n\r\f\x0B]+', ' ', 'g')) AS b, coalesce(lang, '') AS l FROM documents),
f AS (SELECT *, title || ' ' AS t, coalesce(av, event_date, DATE '{AS_OF}') AS available_at, concat_ws(' ', nullif(title, ''), nullif(b, ''), nullif(l, '')) AS w FROM e),
r AS (SELECT *, {_CASE(1)} AS ik, {_CASE(2)} AS isv FROM f WHERE available_at <= DATE '{AS_OF}' AND available_at >= DATE '{AS_OF}' - {LOOKBACK} AND w <> ''),
k AS (SELECT *, CASE WHEN kind IN ('', 'announcement') AND ik <> 'announcement' THEN ik ELSE kind END AS event_type, CASE WHEN kind IN ('', 'announcement') AND ik <> 'announcement' AND sev IN ('', 'info') THEN isv ELSE sev END AS severity, unnest(range(0, CAST(ceil(length(w) / 220.0) AS BIGINT))) AS n FROM r),
ch AS (SELECT *, event_id || '_' || CASE WHEN n < 1000 THEN lpad(CAST(n AS VARCHAR), 3, '0') ELSE CAST(n AS VARCHAR) END AS chunk_id, substring(w, n * 220 + 1, 220) AS chunk_text, concat_ws(',', {", ".join(f"CASE WHEN contains(w, '{x}') THEN '{x}' END" for x in ev.KEYWORDS)}) AS keywords FROM k)"""


def evidence_found(spark, sf_dir):
    """The newest 200 chunks with a word, by some instruments, from the index: a top-k report."""
    index = ev.EvidenceIndex(spark, scratch(spark, "evidence")).build(ev.evidence(announced(spark, sf_dir), F.lit(AS_OF).cast("date"), lookback=LOOKBACK))
    found = index.search("The th", as_of="2024-02-10", lookback=25, instruments=[str(i) for i in range(0, 50, 3)])
    return rounded(found.select("chunk_id", "instrument", "event_date", "available_at", F.md5("chunk_text").alias("digest")), ["event_date", "available_at"])


def queries() -> dict:
    return {"evidence_table": evidence_table, "evidence_found": evidence_found}


def oracle_sql() -> dict[str, str]:
    return {
        "evidence_table": f"WITH {EVIDENCE} SELECT chunk_id, event_id, instrument, event_type, severity, event_date, available_at, title, CASE WHEN source_url <> '' THEN 'official' ELSE 'unknown' END AS source_tier, source_url <> '' AS official_source, source_url, keywords, md5(chunk_text) AS digest FROM ch",
        "evidence_found": f"WITH {EVIDENCE} SELECT chunk_id, instrument, event_date, available_at, md5(chunk_text) AS digest FROM ch WHERE contains(lower(concat_ws(' ', title, chunk_text, keywords)), 'the th') AND CAST(instrument AS INT) % 3 = 0 AND available_at BETWEEN DATE '2024-02-10' - 25 AND DATE '2024-02-10' ORDER BY available_at DESC, event_date DESC NULLS LAST, instrument, chunk_id LIMIT 200",
    }


