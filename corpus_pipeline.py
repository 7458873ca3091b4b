"""From raw documents to packed sequences: toxicity, quality, near-duplicates, packing.

Each stage takes what the one before kept, as a table, and returns a
DataFrame; all but the last keep the columns of documents, whatever extra ones there are.
Null texts count as empty ones and are judged like any document; texts are judged whole, however
long; repeated rows get equal scores, and copies of one another (with equal ids too) leave one row
behind the near-duplicate stage; an empty table stays empty through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crossloom.llm import common, near_dedup, packing_cg, quality, toxicity

#: Not a name that a table of documents would have.
SCORE = "_stage_score"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model scores below its threshold."""
    common.ship(spark)
    model = toxicity.fit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, model, SCORE).where(F.col(SCORE) < toxicity.REJECT_FROM).drop(SCORE)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality model scores at its threshold or above."""
    common.ship(spark)
    model = quality.fit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score(docs, model, SCORE).where(F.col(SCORE) >= quality.KEEP_FROM).drop(SCORE)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    common.ship(spark)
    return near_dedup.keep_one(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The kept documents' pieces, with their sequence and offset."""
    common.ship(spark)
    return packing_cg.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", keep_quality),
    ("simhash_near_dedup", drop_near_duplicates),
    ("packing", pack_sequences),
]

#: Trained models, shingle hashes and tokenizers have no SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is written and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        following = common.staged(stage(spark, docs, sf_dir), name)
        if name != STAGES[0][0]:
            common.unstage(docs)
        docs = following
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
