"""How far the term use of sources lies apart: joint count histograms, exact arithmetic.

Every pair of sources of a language is compared over all kept terms of that language. What the
comparison adds up depends on a term's two counts only, so the pair's distinct (count, count)
combinations are tallied, and the summand is taken once per combination, times its multiplicity.
Only terms that both sources use are ever paired; the combinations with a zero follow from each
source's own counts: its terms of a count, less those already tallied with the other source.

Null text, lang and source count as ''. A source without a kept term still takes part (all its
counts are zero); a language without kept terms gives value 0 to its pairs and no terms. Repeated
rows count as often as they stand there, ids don't matter, an empty table gives an empty result, and
extra columns are not read. Texts are read whole.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: A term is kept in a language from so many of its documents on.
LEAST_DOCUMENTS = 10
#: Probabilities are whole numbers of this unit, and each count gets this much more.
UNIT, ADDED = 1_000_000_000, 2
#: Terms of a source that the report lists.
TOP_TERMS = 10
#: Entries of a task's counters before they are handed on, and pairs of cells formed at once.
HELD, AT_ONCE = 300_000, 1 << 20

#: ASCII letters in lower case and all bytes of non-ASCII characters stay; every other byte parts terms.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs), several rows a term: occurrences and documents, added up by task."""
    plain = docs.select(*[F.coalesce(docs[c].cast("string"), F.lit("")).alias(c) for c in ("lang", "source")], common.text_column(docs).cast("binary").alias("text"))

    def rows(held: dict) -> pa.RecordBatch:
        flat = [(lang, source, term, n, used[term]) for (lang, source), (found, used) in held.items() for term, n in found.items()]
        lang, source, term, n, used = zip(*flat, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(source, pa.string()), pa.array(term, pa.binary()).cast(pa.string()), pa.array(n, pa.int64()), pa.array(used, pa.int64())], names=["lang", "source", "term", "n", "docs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        entries = 0
        for batch in batches:
            for part in common.slices(batch):
                for lang, source, text in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    terms = text.translate(_LETTERS).split()
                    if not terms:
                        continue
                    found, used = held.setdefault((lang, source), (Counter(), Counter()))
                    before = len(found)
                    found.update(terms)
                    used.update(set(terms))
                    entries += len(found) - before
                    if entries > HELD:
                        yield rows(held)
                        held, entries = {}, 0
        if held:
            yield rows(held)

    return plain.mapInArrow(run, "lang string, source string, term string, n long, docs long")


def kept_terms(docs: DataFrame, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """(lang, term, total, by): the kept terms and their sources' counts, an array of (source, n); one shuffle."""
    placed = term_counts(docs).repartition("lang", "term")
    sums = placed.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    return sums.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"), F.collect_list(F.struct("source", "n")).alias("by")).where(F.col("docs") >= least).drop("docs")


def _index_pairs(n: int, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All i < j below n, in parts of about `most`."""
    i = 0
    while i < n - 1:
        k, size = i, 0
        while k < n - 1 and (size == 0 or size + n - 1 - k <= most):
            size += n - 1 - k
            k += 1
        left = np.repeat(np.arange(i, k), n - 1 - np.arange(i, k))
        yield left, np.concatenate([np.arange(x + 1, n) for x in range(i, k)])
        i = k


def shared_cells(kept: DataFrame) -> DataFrame:
    """(lang, a, b, x, y, m): of sources a < b, m terms that a uses x times and b y times, x and y above zero. Tallied in each task first, summed by the caller."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column(0).to_pylist()
            lists = batch.column(1)
            flat = lists.flatten()
            size = lists.value_lengths().to_numpy(zero_copy_only=False)
            start = np.concatenate([[0], np.cumsum(size)])
            names = list(zip(np.repeat(np.array(langs, object), size).tolist(), flat.field(0).to_pylist(), strict=True))
            known = sorted(set(names))
            code = {x: i for i, x in enumerate(known)}
            source = np.fromiter(map(code.__getitem__, names), np.int64, len(names))
            level, count = np.unique(flat.field(1).to_numpy(), return_inverse=True)
            for width in np.unique(size[size > 1]).tolist():
                at = start[:-1][size == width]
                for i, j in _index_pairs(width, AT_ONCE):
                    step = max(1, AT_ONCE // len(i))
                    for k in range(0, len(at), step):
                        left, right = (at[k : k + step, None] + i).ravel(), (at[k : k + step, None] + j).ravel()
                        turned = source[left] > source[right]
                        left, right = np.where(turned, right, left), np.where(turned, left, right)
                        pair, p = np.unique(source[left] * len(known) + source[right], return_inverse=True)
                        cell, c = np.unique(count[left] * len(level) + count[right], return_inverse=True)
                        both, m = np.unique(p * len(cell) + c, return_counts=True)
                        pair, cell = pair[both // len(cell)], cell[both % len(cell)]
                        a, b = [known[x] for x in (pair // len(known)).tolist()], [known[x] for x in (pair % len(known)).tolist()]
                        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in a], pa.string()), pa.array([x[1] for x in a], pa.string()), pa.array([x[1] for x in b], pa.string()), pa.array(level[cell // len(level)]), pa.array(level[cell % len(level)]), pa.array(m.astype(np.int64))], names=["lang", "a", "b", "x", "y", "m"])

    return kept.select("lang", "by").mapInArrow(run, "lang string, a string, b string, x long, y long, m long")


def joint_histograms(kept: DataFrame, groups: DataFrame, langs: DataFrame) -> DataFrame:
    """(lang, a, b, x, y, m) of every pair of sources a < b of a language, zero cells included: m kept terms stand x times in a and y times in b.

    groups: (lang, source), each once; langs: (lang, terms). A tallied cell takes its terms out of the cells with a zero.
    """
    both = shared_cells(kept)
    moves = F.array(*[F.struct(x.alias("x"), y.alias("y"), (s * F.col("m")).alias("m")) for x, y, s in ((F.col("x"), F.col("y"), 1), (F.col("x"), F.lit(0).cast("long"), -1), (F.lit(0).cast("long"), F.col("y"), -1), (F.lit(0).cast("long"), F.lit(0).cast("long"), 1))])
    tallied = both.select("lang", "a", "b", F.explode(moves).alias("c")).select("lang", "a", "b", "c.*")
    levels = kept.select("lang", F.explode("by").alias("c")).groupBy("lang", "c.source", F.col("c.n").alias("level")).agg(F.count(F.lit(1)).alias("m"))
    used = levels.groupBy("lang", "source").agg(F.sum("m").alias("used"))
    sides = groups.join(used, ["lang", "source"], "left").select("lang", "source", F.coalesce("used", F.lit(0)).alias("used"))
    pairs = sides.select("lang", F.col("source").alias("a"), F.col("used").alias("used_a")).join(sides.select("lang", F.col("source").alias("b"), F.col("used").alias("used_b")), "lang").where("a < b")
    none = pairs.join(langs.select("lang", "terms"), "lang").select("lang", "a", "b", F.lit(0).cast("long").alias("x"), F.lit(0).cast("long").alias("y"), (F.col("terms") - F.col("used_a") - F.col("used_b")).alias("m"))
    ends = pairs.select("lang", "a", "b")
    left = ends.join(levels.withColumnRenamed("source", "a"), ["lang", "a"]).select("lang", "a", "b", F.col("level").alias("x"), F.lit(0).cast("long").alias("y"), "m")
    right = ends.join(levels.withColumnRenamed("source", "b"), ["lang", "b"]).select("lang", "a", "b", F.lit(0).cast("long").alias("x"), F.col("level").alias("y"), "m")
    cells = tallied.unionByName(none).unionByName(left).unionByName(right)
    return cells.groupBy("lang", "a", "b", "x", "y").agg(F.sum("m").alias("m")).where("m > 0")


def probability(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(UNIT * (count + ADDED) / (total + ADDED * terms)), in whole numbers that don't overflow; both sides fit 38 digits."""
    wide = F.lit(UNIT).cast("decimal(10,0)") * (count + ADDED).cast("decimal(20,0)")
    return F.lit(1).cast("long") + F.call_function("div", wide, (total + ADDED * terms).cast("decimal(20,0)"))


def distance(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)); at most UNIT squared before the division, which a long holds."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def audit(docs: DataFrame, top: int = TOP_TERMS, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """(lang, source, part, item, value, rank): each source's distance to every other one of its language, and the terms that it uses most above the language."""
    kept = common.staged(kept_terms(docs, least), "terms")
    groups = docs.select(*[F.coalesce(docs[c].cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    used = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("total").alias("all"))
    langs = groups.select("lang").distinct().join(used, "lang", "left").select("lang", F.coalesce("terms", F.lit(0)).alias("terms"), F.coalesce("all", F.lit(0)).alias("all"))
    single = kept.select("lang", "term", "total", F.explode("by").alias("c")).select("lang", "term", "total", "c.source", "c.n")
    sums = single.groupBy("lang", "source").agg(F.sum("n").alias("sum"))
    sums = common.staged(groups.join(sums, ["lang", "source"], "left").join(langs, "lang").select("lang", "source", F.coalesce("sum", F.lit(0)).alias("sum"), "terms", "all"), "sums")

    cells = joint_histograms(kept, sums.select("lang", "source"), sums.select("lang", "terms").distinct())
    cells = cells.join(sums.select("lang", F.col("source").alias("a"), F.col("sum").alias("sum_a"), "terms"), ["lang", "a"]).join(sums.select("lang", F.col("source").alias("b"), F.col("sum").alias("sum_b")), ["lang", "b"])
    f = distance(probability(F.col("x"), F.col("sum_a"), F.col("terms")), probability(F.col("y"), F.col("sum_b"), F.col("terms")))
    values = cells.groupBy("lang", "a", "b").agg(F.sum(F.col("m") * f).alias("value"))
    pairs = sums.select("lang", F.col("source").alias("a")).join(sums.select("lang", F.col("source").alias("b")), "lang").where("a < b").join(values, ["lang", "a", "b"], "left")
    turns = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    pairs = pairs.select("lang", F.coalesce("value", F.lit(0).cast("long")).alias("value"), turns.alias("c")).select("lang", "c.source", F.lit("pair").alias("part"), "c.item", "value")

    terms = single.join(sums, ["lang", "source"]).withColumns({"p": probability(F.col("n"), F.col("sum"), F.col("terms")), "q": probability(F.col("total"), F.col("all"), F.col("terms"))})
    terms = terms.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), distance(F.col("p"), F.col("q")).alias("value"))

    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = terms.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return pairs.withColumn("rank", F.row_number().over(order)).unionByName(terms)


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
t AS (SELECT id, lang, source, unnest(terms) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS total FROM t GROUP BY lang, term HAVING count(DISTINCT id) >= 10),
langs AS (SELECT l.lang, count(k.term) AS v, coalesce(sum(k.total), 0) AS n FROM (SELECT DISTINCT lang FROM d) l LEFT JOIN kept k USING (lang) GROUP BY l.lang),
c AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN kept USING (lang, term) GROUP BY ALL),
groups AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0) AS n FROM (SELECT DISTINCT lang, source FROM d) g LEFT JOIN c USING (lang, source) GROUP BY ALL),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS count, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (g.n + 2 * l.v)::HUGEINT AS p,
        1 + (1000000000::HUGEINT * (k.total + 2)) // (l.n + 2 * l.v)::HUGEINT AS q
    FROM groups g JOIN langs l USING (lang) JOIN kept k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
f AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q)) // (p + q) AS value FROM p WHERE count > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (FROM pairs UNION ALL FROM terms))
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""
