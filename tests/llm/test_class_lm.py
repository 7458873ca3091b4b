"""The class-based model: counts against a plain recount, scores against the definition, gains against whole likelihoods."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from crossloom.llm import class_lm

from ..conftest import SF

LOWER = {i: i + 32 for i in range(65, 91)}


def tokens(text):
    return [*re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER)), ""]


def learned(doc_id):
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 7 != 2


def by_definition(rows, classes):
    """{(doc_id, text): row} from a word's class in the final model (None: not exchanged)."""
    train = [tokens(t) for i, t in rows if learned(i)]
    n = Counter(w for t in train for w in t)
    total, once, twice = sum(n.values()), sum(c == 1 for w, c in n.items()), sum(c == 2 for w, c in n.items())

    def klass(w):
        if w == "":
            return class_lm.END
        return classes[w] if w in classes else class_lm.RARE + sum(n[w] >= b for b in class_lm.BANDS)

    pairs, size = Counter(), Counter()
    for t in train:
        for a, b in zip(["", *t], t, strict=False):
            pairs[klass(a), klass(b)] += 1
            size[klass(b)] += 1
    after = Counter()
    for (a, _), c in pairs.items():
        after[a] += c
    unknown = (once + 1) / (once + 2 * twice + 1) if once else 1.0

    def transition(a, b):
        return (pairs[a, b] + class_lm.SMOOTH * (size[b] + 1) / (total + class_lm.ALL)) / (after[a] + class_lm.SMOOTH)

    def emission(w):
        return 1.0 if w == "" else unknown if not n[w] else (1 - unknown) / once if n[w] == 1 else n[w] / size[klass(w)]

    known = [w for w in n if w != ""]
    sums = {a: sum(transition(a, klass(w)) * emission(w) for w in known) + transition(a, class_lm.END) + transition(a, class_lm.RARE) * unknown for a in after}
    out = {}
    for i, text in rows:
        t = tokens(text)
        base = sum(math.log10((n[w] + 1) / (total + 1 * (len(n) + 1))) for w in t)
        score = sum(math.log10(transition(klass(a), klass(b))) + math.log10(emission(b)) for a, b in zip(["", *t], t, strict=False))
        out[i, text] = (not learned(i), len(t), sum(n[w] > 0 for w in t), total, base, score)
    return out, sums


ROWS = [(i, f"the {a} saw a {b} and THE {b} x ran to {a} {i % 3}\x0bone{i}") for i, (a, b) in enumerate([("dog", "cat"), ("man", "dog"), ("cat", "mouse"), ("Über", "man")] * 15)]
ROWS += [(7, ROWS[7][1]), (None, "the dog"), (None, None), (100, ""), (101, None), (102, " \t\n "), (103, "word " * 30_000), (104, "never seen words here")]


@pytest.mark.parametrize(("block", "held", "spread"), [(200, 50, 3), (class_lm.BLOCK, class_lm.HELD, class_lm.SPREAD)])
def test_scores_by_definition(spark, monkeypatch, block, held, spread):
    """Small blocks and handed-on parts, and words that share places, change nothing in what is counted."""
    for name, value in (("BLOCK", block), ("HELD", held), ("SPREAD", spread)):
        monkeypatch.setattr(class_lm, name, value)
    df = spark.createDataFrame(ROWS, "doc_id long, text string").selectExpr("*", "1 AS block", "2 AS h", "3 AS n", "'x' AS class").repartition(3)
    model = class_lm.Model(class_lm.Corpus(df))
    n = Counter(w for i, t in ROWS if learned(i) for w in tokens(t))
    classes = {w: int(model.classes[zlib.crc32(w.encode()) & ((1 << class_lm.SPREAD) - 1)]) for w, c in n.items() if c >= class_lm.LEAST and w}
    assert len(classes) > 5
    assert len(set(classes.values())) > 1
    expected, sums = by_definition(ROWS, classes)
    got = model.score().collect()
    assert model.score().columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    assert len(got) == len(ROWS)
    left = Counter((i, *expected[i, t][:4], *(round(x, 6) for x in expected[i, t][4:])) for i, t in ROWS)
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in got) == left
    assert all(0.5 < s <= 1 + 1e-9 for s in sums.values())


def test_gain_is_the_change_of_likelihood():
    rng = np.random.default_rng(1)
    words = rng.integers(1, 30, 3000)
    words[rng.random(3000) < 0.1] = 7
    by = np.concatenate([[0], rng.integers(class_lm.FIRST, class_lm.FIRST + 4, 29)])

    def table(by):
        return np.bincount(by[np.concatenate([[0], words[:-1]])] * class_lm.ALL + by[words], minlength=class_lm.ALL**2).reshape(class_lm.ALL, class_lm.ALL).astype(float)

    def likelihood(by):
        t = table(by)
        x = class_lm._xlogx
        return x(t).sum() - x(t.sum(1)).sum() - x(t.sum(0)).sum()

    prev = np.concatenate([[0], words[:-1]])
    for w in (3, 7, 12):
        for to in range(class_lm.FIRST, class_lm.FIRST + 5):
            if to == by[w]:
                continue
            before = np.bincount(by[prev[words == w]], minlength=class_lm.ALL)[None].astype(float)
            after = np.bincount(by[words[prev == w]], minlength=class_lm.ALL)[None].astype(float)
            other = by.copy()
            other[w] = to
            gain = class_lm.gains(table(by), by[[w]], np.array([to]), before, after, np.array([float(((words == w) & (prev == w)).sum())]))
            assert gain[0] == pytest.approx(likelihood(other) - likelihood(by), abs=1e-6)


def test_exchange_helps_on_texts_not_learned(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    corpus = class_lm.Corpus(docs)
    mean = []
    for rounds in (0, class_lm.ROUNDS):
        r = class_lm.Model(corpus, rounds).score().where("held_out").selectExpr("sum(score) / sum(n_tokens) AS s", "sum(base_score) / sum(n_tokens) AS b", "avg(int(score > base_score)) AS better").first()
        mean.append(r.s)
    assert mean[1] > mean[0] > r.b + 0.2
    assert r.better > 0.9


def test_without_training_rows_and_without_rows(spark, empty):
    none = [(i, "a b c") for i in range(100) if not learned(i)]
    assert none
    got = class_lm.Model(class_lm.Corpus(spark.createDataFrame(none, "doc_id long, text string"))).score().collect()
    assert [(r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got] == [(True, 4, 0, 0, 0.0)] * len(none)
    assert all(math.isfinite(r.score) for r in got)
    assert class_lm.Model(class_lm.Corpus(empty)).score().collect() == []
