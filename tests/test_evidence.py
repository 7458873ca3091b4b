"""Evidence chunks and the letter index against scans."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from crossloom.operators import domains
from crossloom.operators import evidence as ev
from crossloom.operators import masters


@pytest.fixture(scope="module")
def rows(spark):
    pick = random.Random(6)
    words = ["回购", "股份", "Alpha", "beta", "gamma ", "x", "诉讼", "%_", "İ"]
    events = [(str(i) if i % 9 else None, pick.choice("abc"), f"2024-{pick.randint(1, 6):02}-{pick.randint(1, 28):02}" if i % 11 else "never", "".join(pick.choice(words) for _ in range(2)), " \n".join(pick.choice(words) for _ in range(60)) if i % 5 else None) for i in range(300)]
    return ev.evidence(spark.createDataFrame(events, "event_id string, instrument string, event_date string, title string, summary string"), F.lit("2024-06-30").cast("date"), 40).cache()


def test_chunks_rebuild_the_text(spark):
    df = spark.createDataFrame([("e", "a", "2024-01-05", " t  x ", "one\ttwo " * 300, None), ("", "a", "2024-02-01", None, None, " "), (None, "b", None, "y", None, "z")], "event_id string, instrument string, event_date string, title string, summary string, evidence string")
    got = ev.evidence(df, F.lit("2024-01-31").cast("date"), 7).orderBy("event_id", "chunk_id").collect()
    texts = {}
    for r in sorted(got, key=lambda r: int(r["chunk_id"].rpartition("_")[2])):
        texts[r["instrument"]] = texts.get(r["instrument"], "") + r["chunk_text"]
    assert texts == {"a": ("t x " + "one two " * 300).strip(), "b": "y z"}
    assert {r["available_at"].isoformat() for r in got} == {"2024-01-05", "2024-01-31"}
    assert all(r["event_id"].startswith("event_") for r in got if r["instrument"] == "b")


@pytest.mark.parametrize("keyword", ["回购", "a", "ALPHA", "beta gamma", "ta  ", "%_", "zz", None, "诉讼 诉讼"])
def test_the_index_finds_what_a_scan_finds(spark, rows, tmp_path_factory, keyword):
    path = Path(tmp_path_factory.getbasetemp()) / "index"
    index = ev.EvidenceIndex(spark, str(path))
    if not path.exists():
        index.build(rows)
    scan = ev.newest(ev.found_in(rows, keyword, as_of=F.lit("2024-05-15").cast("date"), lookback=70, instruments=["a", "c"]), 50)
    got = index.search(keyword, "2024-05-15", 70, 50, instruments=["a", "c"])
    assert [tuple(r) for r in got.collect()] == [tuple(r) for r in scan.collect()]


def test_a_search_reads_the_parts_of_its_letters(spark, rows, tmp_path):
    index = ev.EvidenceIndex(spark, str(tmp_path)).build(rows)
    plan = index.search("alpha", "2024-05-15", 20)._jdf.queryExecution().executedPlan().toString()
    assert "bucket#" in plan and "PartitionFilters" in plan
    used = {f"bucket={r[0]}" for r in spark.read.parquet(f"{tmp_path}/grams").where(F.col("gram").isin("al", "lp", "ph", "ha")).select("bucket").distinct().collect()}
    size = lambda keep: sum(f.stat().st_size for f in (tmp_path / "grams").rglob("*.parquet") if keep(f))
    read = size(lambda f: f.parent.name in used and f.parent.parent.name in ("month=202404", "month=202405"))
    assert 0 < read < size(lambda f: True) / 10


def carried(df):
    """What the rows that a text's slices become hold besides the slice."""
    lines = [x for x in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Generate" in x]
    assert len(lines) == 1
    return lines[0], df._jdf.queryExecution().executedPlan().toString()


def test_slices_do_not_carry_their_text(spark):
    """With the whole text in each row of a slice, the work grows with the square of a text's length."""
    events = spark.createDataFrame([("e", "a", "2024-01-05", "回购", "x" * 700)], "event_id string, instrument string, event_date string, title string, summary string")
    for df in (ev.evidence(events, F.lit("2024-01-31").cast("date")).select("chunk_text", "keywords"), domains.chunks(events, "summary").select("chunk_id", "chunk_text")):
        generate, whole = carried(df)
        assert "regexp_extract_all" in generate and "substring" not in whole
        assert "contains(" not in whole.partition("Generate")[0]
    assert [(len(r[0]), r[1]) for r in ev.evidence(events, F.lit("2024-01-31").cast("date")).select("chunk_text", "keywords").collect()] == [(220, "回购")] * 3 + [(43, "回购")]


def test_slices_of_unusual_characters(spark):
    text = "🙂é\u2028\u0085 日" * 50
    got = domains.chunks(spark.createDataFrame([(text, 1)], "text string, chunk_id int"), size=7).orderBy("chunk_id").collect()
    assert [r["chunk_text"] for r in got] == [text[i : i + 7] for i in range(0, len(text), 7)]


def test_the_index_has_few_rows_a_chunk(spark, tmp_path, monkeypatch):
    """A block has each of its pairs once: as many rows as letters would make the index many times the texts."""
    events = spark.range(600).select(F.col("id").cast("string").alias("event_id"), F.lit("a").alias("instrument"), F.concat(F.lit("2024-0"), (F.col("id") % 2 + 1).cast("string"), F.lit("-05")).alias("event_date"), F.lit("t").alias("title"), F.concat(F.lit("abcdefghijklmnopqrstuvwxyz" * 6), "id").alias("summary"))
    made = ev.evidence(events, F.lit("2024-03-01").cast("date")).coalesce(1)
    monkeypatch.setattr(ev, "BLOCK", 100)
    index = ev.EvidenceIndex(spark, str(tmp_path)).build(made)
    assert spark.read.parquet(f"{tmp_path}/grams").count() < 600 * 5
    assert [r["event_id"] for r in index.search("z417").collect()] == ["417"]
    assert index.postings("z417").count() < 7


def test_ties_of_a_search_have_an_order(spark):
    rows = spark.range(3000).select(F.col("id").cast("string").alias("event_id"), F.lit("9").alias("instrument"), F.lit("2024-01-20").cast("date").alias("event_date"), F.lit(0).alias("chunk_id"), F.lit("The x").alias("chunk_text"))
    got = masters.evidence_search(rows.orderBy(F.xxhash64("event_id")), "the", limit=200)
    assert [int(r["event_id"]) for r in got.collect()] == list(range(200))
