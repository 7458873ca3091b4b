"""Toxicity: gradient-boosted trees over dense features, calibrated by isotonic regression.

A lexicon of words and word beginnings is learned from one part of the labelled
sample, trees from a second, the calibration from a third, so that no part
judges what it has itself suggested. Features are the lexicon's densities, how
near its words stand to the second person, capitals, punctuation and signs of
obfuscation.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import boosting, common, labelled

REJECT_FROM = 0.5
#: Parts 0-44 of the sample make the lexicon, 45-79 the trees, 80-99 the calibration.
LEXICON_PARTS, TREE_PARTS = 45, 80
PREFIXES = (4, 5, 6)
CANDIDATES, LEXICON = 6000, 300
#: A term enters if it is this many times (e^2.5) as common among documents of label 1.
LEAST_WEIGHT = 2.5
NEAR = 4
SECOND_PERSON = frozenset("you your yours yourself u ur tu toi ton ta tes te vous votre vos du dein deine deinen dich dir ihr euch tú ti tus usted ustedes vosotros".split())

_word = re.compile(r"[^\W_]+(?:[*@$0-9]+[^\W_]+)*").findall
_mixed = re.compile(r"[^\W\d_][0-9@$*]+[^\W\d_]").search
_plain = str.maketrans("013457@$*", "oleastasi")


def terms(text: str) -> set[str]:
    """Words as `=word`, beginnings as `^begin`."""
    words = set(_word(text.lower()))
    return {f"={w}" for w in words} | {f"^{w[:k]}" for w in words for k in PREFIXES if len(w) > k}


def learn_lexicon(sample: DataFrame) -> dict[str, float]:
    """Terms much more common in label 1, with their log ratio of document frequencies.

    Counts come from grouped aggregates over the whole sample; at most
    CANDIDATES terms of the label-1 texts are looked up in the others.
    """
    part = sample.where(F.col("part") < LEXICON_PARTS)
    sizes = {r["label"]: r["n"] for r in part.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    hits = sizes.get(1, 0)
    if not hits or not sizes.get(0):
        return {}

    def term_lists(df: DataFrame, wanted: frozenset[str] | None) -> DataFrame:
        def make():
            def step(c):
                found = [sorted(terms(t) if wanted is None else terms(t) & wanted) for t in c["text"]]
                return {"label": c["label"], "terms": found}

            return step

        return common.map_batches(df, "label int, terms array<string>", make).select("label", F.explode("terms").alias("term"))

    least = max(3, math.ceil(0.02 * hits))
    common_ = term_lists(part.where("label = 1"), None).groupBy("term").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    wanted = frozenset(r["term"] for r in common_.orderBy(F.desc("n"), "term").limit(CANDIDATES).collect())
    counted = term_lists(part, wanted).groupBy("term").agg(F.sum("label").alias("a"), F.sum(1 - F.col("label")).alias("b")).collect()
    weight = {r["term"]: math.log((r["a"] + 0.5) / (hits + 1)) - math.log((r["b"] + 0.5) / (sizes[0] + 1)) for r in counted}
    count = {r["term"]: r["a"] for r in counted}
    best = sorted((t for t, v in weight.items() if v >= LEAST_WEIGHT), key=lambda t: (-weight[t] * count[t], t))
    return {t: weight[t] for t in best[:LEXICON]}


def features(text: str, lexicon: dict[str, float]) -> list[float]:
    """Seventeen densities and distances; an empty text gives zeros (and the largest distance)."""
    words = _word(text)
    n, w = max(1, len(text)), max(1, len(words))
    hits: list[int] = []
    weights: list[float] = []
    seen: set[str] = set()
    disguised = mixed = capital_hits = 0
    you: list[int] = []
    get = lexicon.get
    for i, word in enumerate(words):
        low = word.lower()
        best = max(get(f"={low}", 0.0), *(get(f"^{low[:k]}", 0.0) for k in PREFIXES if len(low) > k), 0.0)
        if not low.isalpha() and _mixed(low):
            mixed += 1
            plain = low.translate(_plain)
            if (value := get(f"={plain}", 0.0)) > best:
                best = value
                disguised += 1
        if low in SECOND_PERSON:
            you.append(i)
        if best > 0:
            hits.append(i)
            weights.append(best)
            seen.add(low)
            capital_hits += word.isupper() and len(word) > 1
    near, closest = 0, float(NEAR * 4)
    if hits and you:
        gaps = np.abs(np.array(hits)[:, None] - np.array(you)[np.clip(np.searchsorted(you, hits)[:, None] + [-1, 0], 0, len(you) - 1)]).min(1)
        near, closest = int((gaps <= NEAR).sum()), float(min(closest, gaps.min()))
    letters = max(1, sum(map(len, words)))
    capitals = sum(x.isupper() and len(x) > 1 for x in words)
    return [
        math.log1p(len(hits)),
        len(hits) / w,
        sum(weights) / w,
        max(weights, default=0.0),
        sum(weights) / max(1, len(weights)),
        float(len(seen)),
        near / w,
        closest,
        len(you) / w,
        capitals / w,
        capital_hits / w,
        text.count("!") / w,
        (text.count("?") + text.count("*") + text.count("#") + text.count("$")) / w,
        (n - letters) / n,
        mixed / w,
        float(disguised),
        math.log1p(len(words)),
    ]


@dataclass
class Model:
    lexicon: dict[str, float]
    forest: boosting.Forest
    level: boosting.Isotonic

    def features(self) -> Callable[[str], list[float]]:
        lexicon = self.lexicon
        return lambda text: features(text, lexicon)

    def predict(self, x: np.ndarray) -> np.ndarray:
        """The calibrated probability; a hundredth of the raw one keeps the order inside a calibrated step."""
        raw = self.forest.probability(x)
        return 0.99 * self.level(raw) + 0.01 * raw


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = labelled.FIT_ROWS) -> Model:
    """A model from at most `rows` labelled documents outside the held-out fold. Without labels every score is 0.5."""
    sample = labelled.labelled_sample(docs, labels, label, rows)
    lexicon = learn_lexicon(sample)
    x, y, part = labelled.feature_matrix(sample.where(F.col("part") >= LEXICON_PARTS), lambda text: features(text, lexicon))
    common.unstage(sample)
    trees = part < TREE_PARTS
    forest = boosting.fit_forest(x[trees], y[trees])
    level = boosting.fit_isotonic(forest.probability(x[~trees]), y[~trees])
    return Model(lexicon, forest, level)


def score(docs: DataFrame, model: Model, out: str = "score") -> DataFrame:
    """All columns of docs and `out`: the calibrated probability of label 1.

    Null and empty texts are scored as empty documents, texts of any length whole; repeated rows get equal
    scores; ids play no part; an existing column `out` is replaced.
    """
    return labelled.score_all(docs, model.features(), model.predict, out)


def classify(docs: DataFrame, labels: DataFrame, reject_from: float = REJECT_FROM) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scored = score(slim, fit(docs, labels)).drop("text")
    return scored.select("doc_id", common.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= reject_from).cast("int").alias("predicted"))


def op5_toxicity(spark, sf_dir: str) -> DataFrame:
    """classify() of all documents and labels; nulls, empty texts and repeats as score() says."""
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
