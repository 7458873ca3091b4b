"""What findings of reviews named, on small tables."""

import os
import subprocess
import sys
from pathlib import Path

from crossloom.operators import masters as ms
from crossloom.plans import masters

from .conftest import SF


def test_intensity_reads_every_unit_of_its_texts(spark, duck):
    orders = dict(duck.sql("SELECT o_orderkey % 5, count(*) FROM orders GROUP BY 1").fetchall())
    found = {r["unit"]: r["money"] for r in masters.text_intensity(spark, SF).collect()}
    assert found == {r[0]: r[1] for r in duck.sql(masters.oracle_sql()["text_intensity"]).fetchall()}
    # millions and billions count: amounts up to 976 of them, against 1 for a text of 12.5万 alone
    assert found[2] > 1.5 * orders[2] and found[3] > 2.9 * orders[3]
    assert found[4] == orders[4]


def test_units_of_money(spark):
    row = spark.sql("SELECT 'about 300 million, 2billion of 12.5万' AS t, '3亿元' AS u")
    known, plain, yuan = row.select(ms.money_intensity(row["t"], ms.ALL_UNITS), ms.money_intensity(row["t"]), ms.money_intensity(row["u"])).first()
    assert (known, plain) == (3.0, 1.0)  # the default knows the reference's units only
    assert abs(yuan - 2.4771) < 1e-4


def test_stage_of_the_pipeline_where_executors_lack_the_package(tmp_path):
    """A cluster session started elsewhere: only the driver finds the repository."""
    program = f"""
import sys
sys.path.insert(0, {str(Path(__file__).parents[1])!r})
import corpus_pipeline
from pyspark.sql import SparkSession
builder = SparkSession.builder.master("local-cluster[1,1,1024]").config("spark.executor.memory", "512m").config("spark.ui.enabled", "false").config("spark.driver.host", "127.0.0.1")
spark = builder.config("spark.checkpoint.dir", "file://{tmp_path}").config("spark.sql.shuffle.partitions", "2").getOrCreate()
docs = spark.createDataFrame([(1, "one two three four five six seven"), (2, "one two three four five six seven"), (3, "other")], "doc_id long, text string")
print("kept", sorted(r[0] for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").select("doc_id").collect()))
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", program], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "kept [1, 3]" in done.stdout, done.stderr[-2000:]
