"""Classifiers on held-out rows, the URL filter, nearest neighbours and near-duplicates against brute force, and the pipeline."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from crossloom.llm import ann, boosting, near_dedup, quality, simhash, toxicity, urls
from crossloom.llm.components import components

from ..conftest import SF
from .conftest import AWKWARD


def area(score, label):
    score, label = np.array(score), np.array(label)
    order = np.argsort(score)
    ranks = np.empty(len(score))
    for v in np.unique(score):
        at = np.sort(score)
        ranks[score == v] = (np.searchsorted(at, v) + np.searchsorted(at, v, side="right") + 1) / 2
    n = label.sum()
    assert len(order) and 0 < n < len(label)
    return (ranks[label == 1].sum() - n * (n + 1) / 2) / (n * (len(label) - n))


def test_trees_learn_and_constant_labels_do_not_break():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 5))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 0)).astype(float)
    f = boosting.fit_forest(x[:1500], y[:1500])
    assert area(f.probability(x[1500:]), y[1500:]) > 0.97
    assert boosting.fit_forest(x[:0], y[:0]).probability(x[:3]).tolist() == [0.5] * 3
    assert (boosting.fit_forest(x[:10], np.ones(10)).probability(x) > 0.9).all()


def test_isotonic_rises_and_averages():
    p, y = np.array([0.1, 0.2, 0.2, 0.4, 0.5]), np.array([0, 1, 0, 0, 1.0])
    level = boosting.fit_isotonic(p, y)
    assert (np.diff(level(np.linspace(0, 1, 50))) >= 0).all() and level(np.array([0.5]))[0] == 1
    assert boosting.fit_isotonic(p[:0], y[:0])(p).tolist() == p.tolist()


@pytest.mark.parametrize("module, label, least", [(toxicity, "toxic", 0.9), (quality, "quality", 0.95)])
def test_classifiers_on_the_held_out_fold(spark, awkward, empty, module, label, least):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    out = module.classify(docs, labels)
    rows = out.join(labels, "doc_id").where("held_out").collect()
    assert area([r["score"] for r in rows], [r[label] for r in rows]) > least
    assert out.count() == docs.count()
    model = module.fit(docs, labels)
    scored = module.score(awkward, model, "mine_too")
    assert scored.columns == [*awkward.columns, "mine_too"] and scored.count() == len(AWKWARD)
    assert scored.where("mine_too < 0 or mine_too > 1 or mine_too is null or score <> 'mine'").count() == 0
    assert module.score(empty, model).count() == 0
    assert {r["score"] for r in module.classify(docs.limit(5), labels.where("false")).collect()} == {0.5}


def test_urls_parts_rules_and_nulls(spark):
    rows = [(1, "HTTP://WWW.Example.ORG/es/1?x#y"), (2, None), (3, "no scheme"), (4, "http://a.com/fr/"), (5, "x://com/de/9#z"), (6, "https://xcom/fr/"), (7, "http://example.org?x"), (8, "http://m.example.org/en/12"), (9, "http://"), (9, "a://b://c/d")]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("score", F.lit(1))
    model = urls.fit(urls.default_labelled_urls(spark))
    got = {(r["page_id"], r["host"]): r for r in urls.filter_urls(pages, model).collect()}
    assert len(got) == 10
    ask = lambda i, h: (got[(i, h)]["path"], got[(i, h)]["rule"], got[(i, h)]["verdict"])
    assert ask(1, "www.example.org") == ("/es/1", "example.org/es/", "block")
    assert got[(2, "")]["path"] == "" and got[(3, "")]["rule"] is None
    assert ask(4, "a.com")[1:] == ("com/fr/", "allow") and ask(5, "com")[1:] == ("com/de/", "block")
    assert got[(6, "xcom")]["rule"] is None and got[(7, "example.org")]["rule"] is None and got[(7, "example.org")]["path"] == ""
    assert ask(8, "m.example.org") == ("/en/12", "example.org/en/1", "block")
    assert ask(9, "") == ("", None, got[(9, "")]["verdict"]) and got[(9, "b:")]["path"] == "//c/d"
    assert urls.filter_urls(pages.where("false"), model).count() == 0


def test_url_trees_on_families_not_fitted(spark):
    labelled = urls.default_labelled_urls(spark).withColumn("fold", F.pmod(F.xxhash64(F.lit(1), "family"), F.lit(4)))
    model = urls.fit(labelled.where("fold > 0"))
    rows = model.score(labelled.where("fold = 0").select("url", "label")).collect()
    assert area([r["score"] for r in rows], [r["label"] for r in rows]) > 0.85
    shares = sorted(model.importances().values(), reverse=True)
    assert shares[0] <= 0.5 and sum(x >= 0.03 for x in shares) >= 5
    alone = [(1, "https://river-garden.org/en/12"), (2, "https://museum.com/"), (3, "http://prizedealclick77.top/a/b/c/d/9f86d081884c7d65?ref=x&id=7"), (4, "http://library.net/?page=2")]
    frame = spark.createDataFrame(alone, "page_id long, url string").withColumns({"depth": F.lit("mine"), "probability": F.lit("mine")})
    got = {r["page_id"]: r for r in model.score(frame).collect()}
    assert all(r["depth"] == r["probability"] == "mine" for r in got.values())
    assert got[1]["score"] < 0.5 and got[2]["score"] < 0.5 and got[4]["score"] < 0.5  # a hyphen alone blocks nothing
    assert got[3]["score"] >= 0.5  # no hyphen, unwanted by its other features


def test_url_parts_against_sql(spark, duck):
    model = urls.fit(urls.default_labelled_urls(spark, 600))
    got = {r["page_id"]: (r["host"], r["path"], r["rule"]) for r in urls.filter_urls(spark.read.parquet(f"{SF}/pages.parquet"), model).collect()}
    sql = """
    WITH a AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS x FROM pages),
    p AS (SELECT page_id, lower(regexp_extract(x, '^[^/?#]*')) AS host, regexp_extract(x, '^[^/?#]*([^?#]*)', 1) AS path FROM a),
    rules(rule) AS (VALUES ('org/'), ('example.org/es/'), ('example.org/en/1'), ('com/fr/'), ('com/de/')),
    fits AS (SELECT page_id, arg_max(rule, length(rule)) AS rule FROM p, rules
      WHERE starts_with(path, substr(rule, strpos(rule, '/'))) AND ends_with('.' || host, '.' || split_part(rule, '/', 1)) GROUP BY page_id)
    SELECT page_id, coalesce(host, ''), coalesce(path, ''), rule FROM p LEFT JOIN fits USING (page_id)"""
    assert got == {i: (h, p, r) for i, h, p, r in duck.sql(sql).fetchall()}


def test_index_finds_every_near_pair():
    rng = np.random.default_rng(0)
    for n in (0, 1, 50, 2000):
        base = rng.integers(0, 2**63, max(1, n // 5), dtype=np.uint64)
        flip = lambda: np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64)
        codes = np.unique(base[rng.integers(0, len(base), n)] ^ flip() ^ flip()) if n else base[:0]
        group = rng.integers(0, 3, len(codes))
        order = np.lexsort((simhash.gray_rank(codes), group))
        codes, group = codes[order], group[order]
        parts = [*simhash.index_pairs(group, codes, 2), (np.zeros(0, np.int64),) * 3]
        a, b, bits = (np.concatenate(x) for x in zip(*parts, strict=True))
        assert (bits == np.bitwise_count(codes[a] ^ codes[b])).all()
        near = (np.bitwise_count(codes[:, None] ^ codes[None, :]) <= 2) & (group[:, None] == group[None, :])
        wanted = {(i, j) for i, j in np.argwhere(near).tolist() if i < j}
        assert {tuple(sorted(p)) for p in zip(a.tolist(), b.tolist(), strict=True)} == wanted and len(a) == len(wanted)


def reach(near):
    label = np.arange(len(near))
    while True:
        new = np.array([label[row].min() for row in near])
        if (new == label).all():
            return label
        label = new


def test_components_of_dense_and_long_groups_with_small_blocks(spark):
    """A ball of codes around one, with groups so small that they are keyed again and again."""
    rng = np.random.default_rng(3)
    ball = np.unique(np.concatenate([np.uint64(12345) ^ (rng.integers(0, 2**9, 300).astype(np.uint64) << np.uint64(20)), rng.integers(0, 2**63, 60, dtype=np.uint64)]))
    df = spark.createDataFrame([(int(x),) for x in ball.view(np.int64)], "code long")
    got = {r["node"]: r["root"] for r in components(simhash.hamming_links(df, 2, group=40)).collect()}
    label = reach(np.bitwise_count(ball[:, None] ^ ball[None, :]) <= 2)
    signed = ball.view(np.int64)
    for k in range(len(ball)):
        members = signed[label == label[k]]
        assert got.get(int(signed[k]), int(signed[k])) == int(members.min())


def test_components_of_a_path(spark):
    edges = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).union(spark.createDataFrame([(500, 500), (None, 3)], "a long, b long"))
    got = {r["node"]: r["root"] for r in components(edges).collect()}
    assert got == {i: 0 for i in range(201)}


def test_simhash_components(spark, awkward, empty):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 400").collect()
    codes = np.array([simhash.majority_bits(simhash.shingle_hashes(r["text"], 3)) for r in docs], np.uint64)
    label = reach(np.bitwise_count(codes[:, None] ^ codes[None, :]) <= 2)
    got = {r["doc_id"]: r for r in simhash.near_components(spark.createDataFrame(docs)).collect()}
    for k, r in enumerate(docs):
        assert got[r["doc_id"]]["fingerprint"] == f"{int(codes[k]):016x}"
        assert got[r["doc_id"]]["component_id"] == min(docs[i]["doc_id"] for i in np.flatnonzero(label == label[k]))
    rows = simhash.near_components(awkward).collect()
    assert len(rows) == len(AWKWARD)
    none = [r for r in rows if r["fingerprint"] == "0" * 16]
    assert len(none) == 4 and {r["component_id"] for r in none} == {2}
    assert simhash.near_components(empty).count() == 0


def test_near_duplicates_by_similarity(spark, awkward, empty):
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(4000)]
    rows, group = [], []
    for g in range(60):
        base = rng.choice(words, 200).tolist()
        for c in range(int(rng.integers(1, 5))):
            text = base.copy()
            for at in rng.choice(200, c, replace=False):
                text[at] = str(rng.integers(10**6))
            rows.append((len(rows), " ".join(text)))
            group.append(g)
    sets = [set(simhash.shingle_hashes(t, 5).tolist()) for _, t in rows]
    near = np.array([[len(a & b) >= 0.8 * len(a | b) for b in sets] for a in sets])
    label = reach(near)
    kept = {r["doc_id"] for r in near_dedup.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    wanted = {int(x) for x in np.unique(label)}
    assert kept == wanted
    out = near_dedup.keep_one(awkward)
    assert out.columns == awkward.columns
    # one of the copies (1, 1 and 7 differ in case only), one of the texts without words; the null id has words
    assert sorted((r["doc_id"] or 0, r["text"]) for r in out.collect()) == sorted((r[0] or 0, r[1]) for r in (AWKWARD[k] for k in (0, 2, 4, 7, 8)))
    assert near_dedup.keep_one(empty).count() == 0


def test_index_is_pruned_whole_groups_at_a_time():
    """Shared patterns of upper nodes tell two far families apart without a look at their pairs; Gray order keeps families together."""
    rng = np.random.default_rng(3)
    one = np.uint64(1)
    family = lambda base: np.uint64(base) ^ (one << rng.integers(0, 8, 64).astype(np.uint64)) ^ (one << rng.integers(0, 8, 64).astype(np.uint64))
    codes = np.unique(np.r_[family(0), family(0xFFFF000000000000)])
    codes = codes[np.argsort(simhash.gray_rank(codes))]
    levels = simhash.shared_patterns(np.zeros(len(codes), np.int64), codes)
    assert [len(x[1]) for x in levels][-1] == 1 and all((x[1] & x[2] == 0).all() for x in levels)
    _, ones, zeros = levels[1]
    assert np.median(np.bitwise_count(ones | zeros)) >= 56  # of nodes of one family; in any other order nodes would mix both
    far = np.bitwise_count((ones[0] & zeros[-1]) | (zeros[0] & ones[-1]))
    assert far >= 16


def test_forest_spans():
    a, b, bits = np.array([0, 0, 1, 2, 4]), np.array([1, 2, 2, 3, 5]), np.array([1, 9, 2, 3, 1])
    keep = near_dedup.spanning_forest(a, b, bits, 7)
    assert sorted(keep.tolist()) == [0, 2, 3, 4]


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1500, 16)).astype(np.float32)
    x[10:40] = x[10]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5000, None), (5050, [0.0] * 16), (5100, [None] + [1.0] * 15), (5150, [float("nan")] + [1.0] * 15), (5200, [1.0, 2.0]), (None, [1.0] * 16)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("mine"))
    got = ann.nearest(table, F.col("vec_id") % 50 == 0).collect()
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    hits = total = 0
    for q in range(0, 1500, 50):
        score = unit @ unit[q]
        score[q] = -2
        best = np.lexsort((np.arange(1500), -np.round(score, 12)))[:5]
        mine = sorted([r for r in got if r["query_id"] == q], key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == [1, 2, 3, 4, 5]
        assert all(abs(r["score"] - score[r["vec_id"]]) < 1e-12 for r in mine)
        hits, total = hits + len({r["vec_id"] for r in mine} & set(best.tolist())), total + 5
    assert hits / total >= 0.9 and len(got) == 150
    few = spark.createDataFrame([(0, [1.0, 0.0]), (50, [1.0, 0.0]), (1, [0.0, 1.0])], "vec_id long, embedding array<float>")
    assert sorted((r["query_id"], r["rank"], r["vec_id"]) for r in ann.nearest(few, F.col("vec_id") % 50 == 0).collect()) == [(0, 1, 50), (0, 2, 1), (50, 1, 0), (50, 2, 1)]
    assert ann.nearest(few.where("false"), F.lit(True)).count() == 0
    assert ann.nearest(few.where("vec_id = 0"), F.lit(True)).count() == 0


def test_pipeline_stages_on_awkward_rows(spark, awkward, empty):
    """Every stage takes nulls, empty and very long texts, repeats, ties and clashing names, and an empty table."""
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, awkward, SF)
        if name != "packing":
            assert out.columns == awkward.columns
            left = [r.asDict() for r in out.collect()]
            rows = [r.asDict() for r in awkward.collect()]
            assert all(r in rows for r in left) and len(left) <= len(rows)
            # equal texts share one fate in the classifying stages
            if name in ("toxicity", "quality"):
                texts = {r["text"] or "" for r in left}
                assert len(left) == sum((r["text"] or "") in texts for r in rows)
        else:
            pieces = out.collect()
            assert sum(r["length"] for r in pieces) == sum(r["doc_tokens"] for r in pieces if r["start"] == 0)
            assert sum(r["start"] == 0 for r in pieces) == awkward.count()
        assert stage(spark, empty, SF).count() == 0


def test_search_with_a_small_beam(spark):
    """Recall on the whole table of embeddings, with a beam far smaller than the table, against brute force; doubles keep their precision."""
    table = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    rows = table.where("embedding is not null").collect()
    x, ids = np.array([r["embedding"] for r in rows]), np.array([r["vec_id"] for r in rows])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    got = ann.nearest(table, F.col("vec_id") % 50 == 0, beam=40, expand=10).collect()
    hits = total = 0
    for q in np.flatnonzero(ids % 50 == 0):
        score = unit @ unit[q]
        score[q] = -2
        fifth = np.sort(score)[-5]
        mine = [r for r in got if r["query_id"] == ids[q]]
        assert all(abs(r["score"] - score[np.flatnonzero(ids == r["vec_id"])[0]]) < 1e-12 for r in mine)
        hits, total = hits + sum(r["score"] >= fifth - 1e-12 for r in mine), total + 5
    assert hits / total >= 0.9


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "simhash_near_dedup", "packing"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, SF)
        assert kept.columns == docs.columns and 0 < kept.count() < docs.count()
    packed = corpus_pipeline.run(spark, SF)
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 1024").count() == 0
