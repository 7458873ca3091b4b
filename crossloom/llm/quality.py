"""Quality classifier: histogram gradient-boosted trees over statistics of the whole document.

The trees are flattened into arrays; a batch of documents walks down each tree
together in numpy.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import boosting, common, labelled

KEEP_FROM = 0.3

_letters = re.compile(r"[^\W\d_]").findall
_upper = re.compile(r"[A-ZÀ-ÖØ-Þ]").findall
_symbols = re.compile(r"[^\w\s.,;:!?'\"()\-]").findall
_ends = re.compile(r"[.!?](?:\s|$)").findall


def features(text: str) -> list[float]:
    """Twenty statistics; an empty text gives zeros but for the shares that count as whole."""
    words, lines = text.split(), [x for x in text.split("\n") if x.strip()]
    n, w, k = max(1, len(text)), max(1, len(words)), max(1, len(lines))
    lower = [x.lower() for x in words]
    counts, line_counts = Counter(lower), Counter(lines)
    pairs = Counter(zip(lower, lower[1:], strict=False))
    repeats = sum(a == b for a, b in zip(lower, lower[1:], strict=False))
    capital_words = sum(x.isupper() and len(x) > 1 for x in words)
    marked = sum(not x[-1].isalnum() and x[-1] not in ".,;:!?)'\"" for x in words)
    letters = len(_letters(text))
    return [
        float(np.log1p(len(text))),
        float(np.log1p(len(words))),
        sum(map(len, words)) / w,
        letters / n,
        len(_upper(text)) / max(1, letters),
        sum(c.isdigit() for c in text) / n if any(c in text for c in "0123456789") else 0.0,
        len(_symbols(text)) / n,
        text.count("|") / w,
        text.count("!") / w,
        (text.count(".") + text.count(",")) / w,
        len(_ends(text)) / w,
        len(counts) / w,
        max(counts.values(), default=0) / w,
        len(pairs) / max(1, w - 1),
        repeats / w,
        capital_words / w,
        marked / w,
        len(lines) / w,
        len(line_counts) / k,
        max(map(len, lines), default=0) / n,
    ]


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = labelled.FIT_ROWS) -> boosting.Forest:
    """Trees from at most `rows` labelled documents outside the held-out fold. Without labels every score is 0.5."""
    sample = labelled.labelled_sample(docs, labels, label, rows)
    x, y, _ = labelled.feature_matrix(sample, features)
    common.unstage(sample)
    return boosting.fit_forest(x, y)


def score(docs: DataFrame, model: boosting.Forest, out: str = "score") -> DataFrame:
    """All columns of docs and `out`: the probability of label 1.

    Null and empty texts are scored as empty documents, texts of any length whole; repeated rows get equal
    scores; ids play no part; an existing column `out` is replaced.
    """
    return labelled.score_all(docs, features, model.probability, out)


def classify(docs: DataFrame, labels: DataFrame, keep_from: float = KEEP_FROM) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scored = score(slim, fit(docs, labels)).drop("text")
    return scored.select("doc_id", common.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= keep_from).cast("int").alias("predicted"))


def op10_quality_classifier(spark, sf_dir: str) -> DataFrame:
    """classify() of all documents and labels; nulls, empty texts and repeats as score() says."""
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
