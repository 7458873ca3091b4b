"""Themes and back-fill on small tables."""

import pytest

from crossloom.operators import themes as th


def test_penalty_status_and_tier(spark):
    signal = spark.createDataFrame([("a", 1.0, 1.0, True, "", "", ""), ("b", 0.5, 0.5, True, "event_blocked", "x", "high"), ("c", 0.0, 0.0, False, "", "", ""), ("d", 0.9, 0.9, True, "", "", "watch")], "instrument string, ensemble_score double, family_quality_score double, tradable boolean, risk_flags string, risk_event_types string, max_event_severity string")
    members = spark.createDataFrame([(" a ", 9.0), ("b", 5.0), ("c", 1.0), ("d", 9.0), ("e", None)], "instrument string, theme_exposure double")
    rows = {r["instrument"]: r for r in th.theme_table(signal, members).collect()}
    assert rows["a"]["research_status"] == "research_candidate" and rows["a"]["risk_penalty"] == 0
    assert rows["a"]["total_score"] == pytest.approx(0.30 + 0.20 + 0.15) and rows["a"]["tier"] == "A重点研究"
    assert rows["b"]["risk_penalty"] == 1.0 and rows["b"]["tier"] == "C风险复核"
    assert rows["c"]["research_status"] == "risk_review" and rows["c"]["theme_research_score"] == 0
    assert rows["d"]["risk_penalty"] == pytest.approx(0.2)
    assert rows["e"]["research_status"] == "watch_only" and rows["e"]["theme_exposure"] == 1.0 and rows["e"]["risk_penalty"] == pytest.approx(0.35)
    assert [r["instrument"] for r in th.theme_table(signal, members, 2).collect()] == ["a", "d"]
    assert th.theme_table(signal, members.where("false")).collect() == []
    with pytest.raises(ValueError, match="positive"):
        th.theme_table(signal, members, 0)


def test_back_fill_asks_in_order_and_only_for_what_is_missing(spark):
    signal = spark.createDataFrame([("a", 1.0)], "instrument string, s double")
    members = spark.createDataFrame([(x,) for x in ("a", "b", " c", "d", "", None)], "instrument string")
    source = {"first": [("a", -1.0), ("b", 2.0), ("z", 9.0)], "second": [("b", -2.0), ("c", 3.0), ("c", 4.0)], "third": [("d", 5.0)], "fourth": [("d", 6.0)]}
    asked = []

    def provider(name):
        def make(names):
            asked.append((name, sorted(r[0] for r in names.collect())))
            df = spark.createDataFrame(source[name], "instrument string, s double")
            return df.join(names, "instrument", "left_semi") if name != "first" else df

        return make

    got = th.back_fill(signal, members, [provider(n) for n in source])
    assert sorted(tuple(r) for r in got.collect()) == [("a", 1.0), ("b", 2.0), ("c", 3.0), ("c", 4.0), ("d", 5.0)]
    assert asked == [("first", ["b", "c", "d"]), ("second", ["c", "d"]), ("third", ["d"])]


def test_a_provider_reads_what_is_missing(spark):
    """The names reach the rows before they are summed up."""
    from crossloom.sources.tables import brand_bars

    from .conftest import SF

    names = spark.createDataFrame([("Brand#1",)], "instrument string")
    plan = brand_bars(spark, SF, names)._jdf.queryExecution().optimizedPlan().toString()
    assert 0 <= plan.index("Aggregate") < plan.index("LeftSemi")
