"""Near-duplicates of the pipeline: cases that a search by fingerprints alone gets wrong."""

import numpy as np
from pyspark.sql import functions as F

from crossloom.llm import near_dedup


def words(start, n):
    return " ".join(f"w{i}" for i in range(start, start + n))


def kept(spark, texts, **options):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r["doc_id"] for r in near_dedup.keep_one(docs, **options).collect()}


LINE = " all rights reserved by the owner "


def test_copies_that_differ_in_the_repeats_of_a_line(spark):
    body = words(0, 200)
    assert kept(spark, [body + LINE, body + LINE * 20, body + LINE * 50, words(1000, 200) + LINE * 50]) == {0, 3}


def test_equal_fingerprints_do_not_join_unlike_texts(spark, monkeypatch):
    assert kept(spark, [LINE * 300 + words(0, 100), LINE * 300 + words(500, 100)]) == {0, 1}
    # all fingerprints equal: nothing but the exact comparison tells texts apart
    monkeypatch.setattr(near_dedup, "majority_bits", lambda hashes: 7)
    assert kept(spark, [words(0, 50), words(0, 50), words(90, 50), words(0, 49)]) == {0, 2}


def test_no_pair_of_few_words_at_the_limit_is_missed(spark):
    """Sets of 5 and 4 shingles, similarity 0.8: fingerprints differ in more bits than those of long texts."""
    texts = [words(100 * i, n) for i in range(150) for n in (9, 8)]
    assert kept(spark, texts) == set(range(0, 300, 2))


def test_pairs_that_the_index_does_not_find_are_compared(spark, monkeypatch):
    """No pair counts as near: sizes and places alone must lead to every pair."""
    monkeypatch.setattr(near_dedup, "NEAR", -1)
    shared = words(0, 100)
    assert kept(spark, [f"{shared} {words(500, 8)}", f"{shared} {words(600, 45)}", f"{shared} {words(700, 8)}", shared]) == {0, 1}


def test_links_that_a_forest_leaves_out_are_compared(spark, monkeypatch):
    """The only link that the index gives fails; 0 and 2 are alike all the same."""
    shared = words(0, 100)
    monkeypatch.setattr(near_dedup, "nearest_links", lambda links: links.sparkSession.createDataFrame([(0, 1), (1, 2)], "a long, b long"))
    docs = spark.createDataFrame([(0, f"{shared} {words(500, 8)}"), (1, f"{shared} {words(600, 45)}"), (2, f"{shared} {words(700, 8)}")], "doc_id long, text string").coalesce(1)
    assert {r["doc_id"] for r in near_dedup.keep_one(docs).collect()} == {0, 1}


def test_blocks_and_crowds(spark, monkeypatch):
    """A family larger than a block, with members that are alike only in a chain."""
    monkeypatch.setattr(near_dedup, "GROUP", 5)
    texts = [words(0, 200) + f" x{i} " + words(200, 100) for i in range(30)] + [words(40 * i, 300) for i in range(1, 5)]
    assert kept(spark, texts) == {0, *range(30, 34)} - ({30} if jaccard(texts[0], texts[30]) >= 0.8 else set())


def jaccard(x, y):
    a, b = ({tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in (x.split(), y.split()))
    return len(a & b) / len(a | b)


def test_every_pair_of_a_large_group_meets(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "GROUP", 7)
    met = spark.range(40).select(F.lit(1).cast("long").alias("key"), F.col("id").alias("node"), F.lit(10).alias("size"), F.lit(0).alias("place"), (F.col("id") % 20).alias("root"))
    monkeypatch.setattr(near_dedup, "PAIRS", 50)
    got = sorted((r["a"], r["b"]) for r in near_dedup.remaining_links(met, 0.8).collect())
    assert got == [(a, b) for a in range(40) for b in range(a + 1, 40) if a % 20 != b % 20]


def test_pairs_are_compared_where_they_meet(spark, monkeypatch):
    """A family whose members are unlike gives no row for its pairs; those alike give a forest."""
    monkeypatch.setattr(near_dedup, "GROUP", 7)
    rows = [(1, n, 10, 0, n) for n in range(40)] + [(2, n, 10, 0, n) for n in range(30, 32)]
    met = spark.createDataFrame(rows, "key long, node long, size int, place int, root long")
    # nodes 0 to 3 share 9 of 10 shingles, all others 5
    sets = [(n, np.array([*range(9 if n < 4 else 5), *range(100 * n + 100, 100 * n + (101 if n < 4 else 105))], "<u8").tobytes()) for n in range(40)]
    got = {(r["a"], r["b"]) for r in near_dedup.remaining_links(met, 0.8, spark.createDataFrame(sets, "node long, own binary")).collect()}
    assert got <= {(a, b) for a in range(4) for b in range(a + 1, 4)} and len(got) <= 3 * 6
    nodes, roots = near_dedup.local_stars(*np.array(sorted(got)).T, 4)
    assert nodes.tolist() == [1, 2, 3] and set(roots.tolist()) == {0}
    assert near_dedup.alike_pairs(np.zeros(0, np.int64), np.zeros(0, np.int64), [np.zeros(0, np.uint64)], 0.8).tolist() == []


def test_sets_go_only_where_histograms_leave_a_pair(spark, monkeypatch):
    """Each text shares a line with the next: they meet, but no set need be moved for them. The one pair of like texts needs two."""
    monkeypatch.setattr(near_dedup, "NEAR", -1)
    made, staged = {}, near_dedup.common.staged

    def counted(df, what):
        out = staged(df, what)
        made[what] = made.get(what, 0) + out.count()
        return out

    monkeypatch.setattr(near_dedup.common, "staged", counted)
    texts = [f"{words(1000 * i, 90)} {words(1000 * i + 500, 12)} {words(1000 * i + 1500, 12)}" for i in range(40)]
    assert kept(spark, [*texts, f"{words(7000, 300)} a", f"{words(7000, 300)} b"]) == set(range(41))
    assert made["places"] > 40 and made["sets"] == 2


def test_histograms_leave_every_pair_that_is_alike():
    rng = np.random.default_rng(1)
    for small, large in [(8, 10), (100, 120), (900, 1100), (2000, 2400)]:
        whole = [np.unique(rng.integers(0, 2**63, large, dtype=np.uint64)) for _ in range(6)]
        sets = [*whole, *(np.sort(rng.choice(s, small, replace=False)) for s in whole), np.repeat(whole[0][:1], 300)]
        bounds = near_dedup.Bounds([near_dedup.histogram(s) for s in sets], np.array([len(s) for s in sets]))
        x = np.arange(6)
        assert bounds.allow(x, x + 6, 0.8).all()
        assert bounds.allow(x, np.full(6, 12), 0.8).all()  # a full bucket says nothing
        if small >= 100:
            assert not bounds.allow(x, (x + 1) % 6 + 6, 0.8).any()


def test_narrowed_seats_lose_no_link(spark, monkeypatch):
    """With and without histograms the same components come out, for sets of many sizes in blocks and several places."""
    monkeypatch.setattr(near_dedup, "GROUP", 6)
    rng = np.random.default_rng(2)
    families = [np.unique(rng.integers(0, 2**62, n, dtype=np.uint64)) for n in (20, 60, 150)]
    sets = [np.sort(rng.choice(f, int(len(f) * part), replace=False)) for f in families for part in rng.uniform(0.7, 1, 12)]
    met = spark.createDataFrame([(k, n, len(s), 0, n) for n, s in enumerate(sets) for k in (1, 2 + n % 3)], "key long, node long, size int, place int, root long")
    own = spark.createDataFrame([(n, s.tobytes(), near_dedup.histogram(s)) for n, s in enumerate(sets)], "node long, own binary, buckets binary")
    brute = [(a, b) for a in range(36) for b in range(a + 1, 36) if len(np.intersect1d(sets[a], sets[b])) >= 0.8 * len(np.union1d(sets[a], sets[b]))]

    def stars(links):
        links = np.array(sorted(links)).T
        return [x.tolist() for x in near_dedup.local_stars(*links, 36)]

    given = own.select("node", "own")
    for narrowed in ({}, {"buckets": own.select("node", "buckets")}):
        for how in (given, lambda nodes: given.join(nodes, "node", "left_semi")):
            got = {(r["a"], r["b"]) for r in near_dedup.remaining_links(met, 0.8, how, **narrowed).collect()}
            assert got and stars(got) == stars(brute)
