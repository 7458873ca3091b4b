"""Company notices: their kind by ordered rules, and dated scores of what a company has disclosed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import clip
from .domains import SEVERITY_WEIGHT, lookup, percent_intensity
from .masters import money_intensity

# What counts as good and bad news, and the rules of notices in their order.
POSITIVE = ("buyback", "shareholder_increase", "order_contract", "earnings_preannouncement_up", "equity_incentive", "performance_warning_up", "performance_warning_repair", "dividend_plan")
NEGATIVE = (
    "shareholder_reduction", "large_unlock", "regulatory_inquiry", "pledge_risk", "guarantee", "lawsuit", "disciplinary_action", "investigation", "st_risk", "delisting_risk", "nonstandard_audit",
    "major_penalty", "performance_warning_down", "impairment",
)
REPORT = "financial_report_disclosure"
NOTICES = (
    (("纪律处分", "处罚", "行政处罚"), "disciplinary_action", "block"),
    (("退市", "终止上市"), "delisting_risk", "block"),
    (("停牌",), "trading_suspension", "block"),
    (("ST", "风险警示", "退市风险警示"), "st_status", "block"),
    (("问询函", "关注函", "监管函", "监管工作函"), "regulatory_inquiry", "risk"),
    (("减持",), "shareholder_reduction", "risk"),
    (("增持", "持股计划增持"), "shareholder_increase", "watch"),
    (("回购", "股份回购"), "buyback", "watch"),
    (("股东户数", "股东人数", "股东总户数"), "holder_count_change", "info"),
    (("解禁", "限售股上市流通", "限售股份上市流通"), "large_unlock", "watch"),
    (("预增", "预盈", "扭亏为盈", "业绩上修", "向上修正"), "performance_warning_up", "watch"),
    (("减亏", "亏损收窄", "亏损同比收窄", "亏损减少", "亏损幅度收窄"), "performance_warning_repair", "info"),
    (("预亏", "首亏", "续亏", "预减", "业绩下修", "向下修正", "由盈转亏"), "performance_warning_down", "risk"),
    (("业绩预告",), "performance_warning_neutral", "info"),
    (("诉讼", "仲裁"), "lawsuit", "risk"),
    (("担保",), "guarantee", "watch"),
    (("解除质押", "质押解除"), "pledge_release", "info"),
    (("质押",), "pledge_risk", "watch"),
    (("权益变动", "股本变动", "股份变动"), "capital_structure_change", "watch"),
    (("异动", "异常波动"), "abnormal_volatility", "watch"),
)
NOTICE = ("announcement", "info")
#: Kinds that stay in force as long as a block, whatever their severity.
LASTING = ("disciplinary_action", "delisting_risk", "trading_suspension", "st_status")
NOTICE_DAYS = {"block": 90, "risk": 60, "watch": 45, "info": 30}


def first_rule(text: Column, rules: Sequence[tuple[Sequence[str], ...]]) -> Column:
    """The place (from 0) of the first rule one of whose words the text contains, else null.

    One scan of the text for all words: the pattern looks ahead from every position, so words that
    overlap are all found, and of words at one position the earliest rule's counts.
    """
    place = {w: i for i, (words, *_) in reversed(list(enumerate(rules))) for w in words}
    quoted = "|".join("".join(f"\\{c}" if c in r".^$*+?()[]{}|\-" else c for c in w) for w in sorted(place, key=lambda w: place[w]))
    found = F.regexp_extract_all(text, F.lit(f"(?=({quoted}))"), F.lit(1))
    of = F.create_map(*[F.lit(x) for kv in place.items() for x in kv])
    return F.array_min(F.transform(found, lambda w: of[w]))


def classify_notices(df: DataFrame, title: str = "title", category: str | None = "category", date: str | None = "event_date") -> DataFrame:
    """df with event_type and severity by the first rule that title and category (with a blank between) fulfil, and active_until. Null texts count as empty, a null date has no end."""
    text = F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(category, F.lit("")) if category else F.lit(""))
    at = first_rule(text, NOTICES)
    pick = lambda i: F.when(at.isNull(), NOTICE[i - 1]).otherwise(F.get(F.array(*[F.lit(r[i]) for r in NOTICES]), at))
    out = df.withColumns({"event_type": pick(1), "severity": pick(2)})
    if date is None:
        return out
    days = F.when(F.col("event_type").isin(*LASTING), NOTICE_DAYS["block"]).otherwise(lookup(F.col("severity"), NOTICE_DAYS, NOTICE_DAYS["info"]))
    return out.withColumn("active_until", F.date_add(date, days))


def direction(kind: Column, severity: Column, positive: Sequence[str] = POSITIVE, negative: Sequence[str] = NEGATIVE) -> Column:
    """1 for good news, -1 for bad news and for other news of severity risk or block, else 0."""
    kind, severity = (F.lower(F.trim(F.coalesce(c, F.lit("")))) for c in (kind, severity))
    return F.when(kind.isin(*positive), 1).when(kind.isin(*negative), -1).when(severity.isin("risk", "block"), -1).otherwise(0)


def intensity(*texts: Column) -> Column:
    """The greater of the money's and the percentages' intensity in the texts, 1 at least."""
    text = F.concat_ws(" ", *texts)
    return F.greatest(F.lit(1.0), money_intensity(text), percent_intensity(text))


def decaying_sums(rows: DataFrame, events: DataFrame, weights: Sequence[str], days: int, date: str, at: str = "event_date", by: str = "instrument") -> DataFrame:
    """Per (by, date) of rows: the sum of each weight x (1 - age / days) over the events of the last `days`, as columns of the weights' names.

    An event's part is weight x (1 - date / days) + weight x day / days, so two sums over a range of days suffice.
    Events are added up by day first (partial sums in every task), so a name with very many events costs its days; rows
    and events are never paired. The result has one row per distinct (by, date).
    """
    number = lambda c: F.datediff(F.col(c), F.lit("1970-01-01").cast("date"))
    e = events.select(F.col(by).alias("_by"), number(at).alias("_day"), *weights).where("_by is not null and _day is not null")
    e = e.groupBy("_by", "_day").agg(*[F.sum(w).alias(w) for w in weights]).withColumn("_date", F.lit(None).cast("date"))
    q = rows.select(F.col(by).alias("_by"), number(date).alias("_day"), F.col(date).cast("date").alias("_date")).where("_day is not null").distinct()
    both = e.unionByName(q, allowMissingColumns=True)
    w = Window.partitionBy("_by").orderBy("_day").rangeBetween(-days, 0)
    sums = {c: F.coalesce((1 - F.col("_day") / float(days)) * F.sum(c).over(w) + F.sum(F.col(c) * F.col("_day")).over(w) / float(days), F.lit(0.0)) for c in weights}
    return both.withColumns({f"_s_{c}": v for c, v in sums.items()}).where("_date is not null").select(F.col("_by").alias(by), F.col("_date").alias(date), *[F.col(f"_s_{c}").alias(c) for c in weights])


SCORES = ("positive_score_90d", "negative_score_90d", "event_score_90d", "positive_intensity_score_90d", "negative_intensity_score_90d", "net_intensity_score_90d")


def disclosure_fields(rows: DataFrame, events: DataFrame, date: str = "available_at", days: int = 90, fresh: int = 30, texts: Sequence[str] = ("title", "summary", "evidence"), prefix: str = "financial_disclosure_", positive: Sequence[str] = POSITIVE, negative: Sequence[str] = NEGATIVE, report: str = REPORT) -> DataFrame:
    """rows with what their instrument had disclosed by `date`: days since its last report and their recency over `fresh` days, and the decayed scores of the last `days`, plain and by intensity.

    Values already there stay. Without a date all are null; without events scores are 0 and the days null. Rows may repeat.
    """
    way = direction(F.col("event_type"), F.col("severity"), positive, negative)
    weight = lookup(F.lower(F.trim("severity")), SEVERITY_WEIGHT, SEVERITY_WEIGHT["info"])
    present = [F.col(c) for c in texts if c in events.columns]
    e = events.select("instrument", F.col("event_date").cast("date").alias("event_date"), "event_type", way.alias("_way"), weight.alias("_w"), (intensity(*present) if present else F.lit(1.0)).alias("_k"))
    plain = lambda sign: F.when(F.col("_way") == sign, F.col("_w")).otherwise(0.0)
    e = e.withColumns({"_p": plain(1), "_n": plain(-1)}).withColumns({"_pi": F.col("_p") * F.col("_k"), "_ni": F.col("_n") * F.col("_k")})
    sums = decaying_sums(rows, e, ["_p", "_n", "_pi", "_ni"], days, date)
    # the latest report on or before each date: one series of reports (one a day) and dates
    r = e.where(F.trim("event_type") == report).select("instrument", F.col("event_date").alias("_at")).distinct()
    q = rows.select("instrument", F.col(date).cast("date").alias(date)).where(F.col(date).isNotNull()).distinct()
    series = q.withColumn("_at", F.col(date)).withColumn("_r", F.lit(None).cast("date")).unionByName(r.withColumn("_r", F.col("_at")), allowMissingColumns=True)
    last = F.max("_r").over(Window.partitionBy("instrument").orderBy("_at").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    since = series.withColumn("_last", last).where(F.col(date).isNotNull()).select("instrument", date, F.datediff(date, "_last").cast("double").alias("_days"))
    found = sums.join(since, ["instrument", date])
    made = {
        "days_since": F.col("_days"), "recency_30d": clip(1 - F.col("_days") / float(fresh), 0.0, 1.0), "positive_score_90d": F.col("_p"), "negative_score_90d": F.col("_n"), "event_score_90d": F.col("_p") - F.col("_n"),
        "positive_intensity_score_90d": F.col("_pi"), "negative_intensity_score_90d": F.col("_ni"), "net_intensity_score_90d": F.col("_pi") - F.col("_ni"),
    }
    found = found.select("instrument", F.col(date).alias("_d"), *[v.alias(f"_v_{c}") for c, v in made.items()])
    own = rows.join(found, (rows["instrument"] == found["instrument"]) & (F.col(date).cast("date") == F.col("_d")), "left").drop(found["instrument"]).drop("_d")
    have = {f"{prefix}{c}": F.coalesce(F.col(f"{prefix}{c}").cast("string").try_cast("double"), F.col(f"_v_{c}")) if f"{prefix}{c}" in rows.columns else F.col(f"_v_{c}") for c in made}
    return own.withColumns(have).drop(*[f"_v_{c}" for c in made])
