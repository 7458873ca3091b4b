"""Near-duplicates by similarity: rows meet by shingles, a Gray-order SimHash index finds their near pairs, exact Jaccard similarity confirms links.

Sets of a similarity of at least s share one of the first n - ceil(s n) + 1 of
their n shingles, in whatever common order (prefix filter). So rows meet by these
shingles and no pair is missed, whatever the number of rows. The order is rare
shingles first, by the counts of a sample, so that few unlike rows meet. Groups stand in Gray order
of their fingerprints. First each row is compared with its nearest neighbour before it in that order, shingle by shingle:
one link a row, which makes most of a family one component however large it is. Then, in groups that
still hold several components, the index of simhash.py gives the near pairs, and of these a minimum spanning forest is compared.
Then every other pair of different components that can be similar enough, by their sizes and
the shared shingle's places, is compared too, inside the task where it meets: histograms first, then the sets of those rows that have a pair left; only links become rows. Fingerprints find most links early and cheaply, and lose none.
Without the index the groups would be the same; it only saves comparisons.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .components import components, local_stars
from .simhash import PAIRS, gray_rank, index_pairs, majority_bits, shingle_hashes, whole_groups

WORDS, SIMILARITY = 5, 0.8
#: Differing bits up to which the index looks: about three deviations above the mean of a pair at the limit.
NEAR = 18
#: Rows whose shingles are counted, the least count of a frequent shingle, and the most of these (an array in every task). They set the order only.
SAMPLE, OFTEN, MOST = 8_000, 3, 1 << 18
#: Rows of a group that meet at once; larger groups are dealt into parts of about so many, and compared block by block.
GROUP = 4_000
#: Rows of groups with a common first node that one task compares, about.
TOGETHER = 200_000
#: Shingles of a block of rows whose pairs are compared in a task, about; one row may have more.
SHINGLES = 2_000_000

#: Shingles per bucket of a set's histogram, at most and about; buckets are a power of two, BUCKETS at least.
PER_BUCKET, BUCKETS = 16, 64

#: The Gray rank of the fingerprint.
GRAY = "gray"
#: 128 bits that stand for a text's set of shingles.
DIGEST = ["set_0", "set_1"]


def frequent(docs: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Shingles that occur often in a sample of rows, ascending, their counts, and how many rows one of the sample stands for.

    They only set an order and how groups are dealt; any are right.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch):
                sets = [np.unique(shingle_hashes(t or "", words)) for t in part.column(0).to_pylist()]
                shingles, n = np.unique(np.concatenate(sets), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(shingles.view(np.int64)), pa.array(n)], names=["shingle", "n"])

    rows = docs.count()
    sample = docs.where(F.pmod(F.xxhash64(*docs.columns), F.lit(max(1, rows))) < SAMPLE).select("text")
    counts = sample.mapInArrow(run, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n")).where(F.col("n") >= OFTEN)
    found = counts.orderBy(F.desc("n"), "shingle").limit(MOST).toArrow()  # at most MOST rows of two numbers
    shingles, n = found.column("shingle").to_numpy().view(np.uint64), found.column("n").to_numpy()
    order = np.argsort(shingles)
    return shingles[order], n[order], max(1.0, rows / SAMPLE)


def histogram(own: np.ndarray) -> bytes:
    """How many of a set's shingles fall in each bucket, by their last bits; 255 stands for that or more."""
    buckets = max(BUCKETS, 1 << max(0, len(own) // PER_BUCKET).bit_length())
    counts = np.bincount((own & np.uint64(buckets - 1)).astype(np.int64), minlength=buckets)
    return np.minimum(counts, 255).astype(np.uint8).tobytes()


def with_sets(docs: DataFrame, often: tuple[np.ndarray, np.ndarray, float], words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """docs with GRAY (from the fingerprint of the text's shingle set, so repeats count once), DIGEST, size, prefix (its first shingles in the common order), parts (over how many parts each one's group is dealt, by the sample) and buckets (its histogram); one pass."""
    added = {GRAY: "long"} | dict.fromkeys(DIGEST, "long") | {"size": "int", "prefix": "array<long>", "parts": "array<int>", "buckets": "binary"}
    schema = docs.withColumns({c: F.lit(None).cast(t) for c, t in added.items()}).schema
    where = docs.columns.index("text")
    shingles, counts, scale = often

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for part in (x for batch in batches for x in common.slices(batch)):
            codes, digests, sizes, firsts, parts, buckets = [], [], [], [], [], []
            for t in part.column(where).to_pylist():
                own = np.unique(shingle_hashes(t or "", words))
                n = len(own)
                seen = np.zeros(n, np.int64)
                if n and len(shingles):
                    at = np.minimum(np.searchsorted(shingles, own), len(shingles) - 1)
                    seen = np.where(shingles[at] == own, counts[at], 0)
                first = n - math.ceil(similarity * n - 1e-9) + 1 if n else 0
                order = np.argsort(seen, kind="stable")[:first]
                firsts.append(own[order].view(np.int64))
                parts.append(np.maximum(1, np.ceil(seen[order] * scale / GROUP)).astype(np.int32))
                codes.append(majority_bits(own))
                digests.append(xxhash.xxh3_128_digest(own.astype("<u8").tobytes()))
                sizes.append(n)
                buckets.append(histogram(own))
            ends = np.cumsum([0, *map(len, firsts)], dtype=np.int32)
            prefix, dealt = (pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(x))) for x in (firsts, parts))
            digest = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2).T.copy()
            columns = [pa.array(gray_rank(np.array(codes, np.uint64)).view(np.int64)), *map(pa.array, digest), pa.array(sizes, pa.int32()), prefix, dealt, pa.array(buckets, pa.binary())]
            yield pa.RecordBatch.from_arrays([*part.columns, *columns], names=[*part.schema.names, *added])
        common.give_back()

    return docs.mapInArrow(run, schema)


def by_key(rows: DataFrame) -> DataFrame:
    return rows.repartition("key").sortWithinPartitions("key")


def group_ends(key: np.ndarray) -> np.ndarray:
    """Where the run of equal keys that each row is in ends."""
    ends = np.append(np.flatnonzero(key[1:] != key[:-1]) + 1, len(key))
    return np.repeat(ends, np.diff(np.r_[0, ends]))


def meetings(nodes: DataFrame, similarity: float) -> DataFrame:
    """Each node's prefix shingles (keys) with their places, where a key occurs more than once. nodes has node, GRAY, size, prefix and parts.

    `part` tells runs of at most GROUP rows of a key in Gray order apart; a key that the sample
    calls frequent is dealt over several tasks first. `before` is the row's neighbour in that order and `bits`
    what their fingerprints differ in, if the two can be similar enough and near.
    """
    rows = nodes.select("node", GRAY, "size", "parts", F.posexplode("prefix").alias("place", "key"))
    rows = rows.withColumn("parts", F.element_at("parts", F.col("place") + 1)).withColumn("deal", F.pmod(F.xxhash64("node", "key"), F.col("parts")).cast("int"))
    order = Window.partitionBy("key", "deal").orderBy(GRAY, "node")
    code = F.col(GRAY).bitwiseXOR(F.shiftrightunsigned(F.col(GRAY), 1))
    last = {c: F.lag(c).over(order) for c in ("node", "size", "place")}
    rows = rows.withColumn("code", code).withColumns({f"last_{c}": v for c, v in last.items()} | {"last_code": F.lag("code").over(order), "next": F.lead("node").over(order), "at": F.row_number().over(order) - 1})
    met = rows.where("last_node is not null or next is not null or parts > 1")
    met = met.withColumn("bits", F.bit_count(F.col("code").bitwiseXOR(F.col("last_code"))))
    left = F.least(F.col("size") - F.col("place"), F.col("last_size") - F.col("last_place"))
    can = (F.col("bits") <= NEAR) & (left >= similarity / (1 + similarity) * (F.col("size") + F.col("last_size")) - 1e-6)
    part = F.col("deal").cast("long") * (1 << 32) + F.floor(F.col("at") / GROUP)
    return met.select("key", part.alias("part"), "node", GRAY, "size", "place", F.when(can, F.col("last_node")).alias("before"), "bits")


def enough(size: np.ndarray, place: np.ndarray, i: np.ndarray, j: np.ndarray, similarity: float) -> np.ndarray:
    """Whether the pairs (i, j) can be similar: at their first common shingle, what both have left must suffice. False only for pairs that aren't."""
    left = np.minimum(size[i] - place[i], size[j] - place[j])
    return left >= similarity / (1 + similarity) * (size[i] + size[j]) - 1e-6


def pairs_batch(node: np.ndarray, i: np.ndarray, j: np.ndarray, **more: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(node[i], node[j])), pa.array(np.maximum(node[i], node[j])), *map(pa.array, more.values())], names=["a", "b", *more])


def spanning_forest(a: np.ndarray, b: np.ndarray, differ: np.ndarray, n: int) -> np.ndarray:
    """Numbers of the links of a minimum spanning forest of positions 0..n-1 (Boruvka's rounds)."""
    label, taken = np.arange(n), []
    order = np.argsort(differ, kind="stable")
    a, b = a[order], b[order]
    while True:
        la, lb = label[a], label[b]
        across = np.flatnonzero(la != lb)
        if not len(across):
            return order[np.unique(np.concatenate(taken))] if taken else np.zeros(0, np.int64)
        least = np.full(n, len(a))
        np.minimum.at(least, la[across], across)
        np.minimum.at(least, lb[across], across)
        chosen = np.unique(least[least < len(a)])
        taken.append(chosen)
        nodes, roots = local_stars(la[chosen], lb[chosen], n)
        step = np.arange(n)
        step[nodes] = roots
        label = step[label]


def nearest_links(met: DataFrame) -> DataFrame:
    """(a, b): of each node's neighbours before it in Gray order the one with the least bits. No pairs are made: a link per node at most, and a tree over each group."""
    nearest = met.where("before is not null").groupBy("node").agg(F.min(F.struct("bits", "before")).alias("to"))
    return nearest.select(F.least("node", "to.before").alias("a"), F.greatest("node", "to.before").alias("b")).distinct()


def near_links(met: DataFrame, similarity: float) -> DataFrame:
    """(a, b), a < b: of the near pairs that the Gray-order index finds in the parts of groups, a minimum spanning forest of `root`s per task.

    Parts of one root are done.
    """

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["key", "part"]):
            key, part, root = (table.column(c).to_numpy() for c in ("key", "part", "root"))
            begin = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (part[1:] != part[:-1])])
            several = np.minimum.reduceat(root, begin) < np.maximum.reduceat(root, begin)
            length = np.diff(np.r_[begin, len(key)])
            open_ = np.flatnonzero(np.repeat(several, length))
            number = np.repeat(np.arange(len(begin)), length)[open_]
            node, rank, size, place = (table.column(c).to_numpy()[open_] for c in ("node", GRAY, "size", "place"))
            code = rank.view(np.uint64) ^ (rank.view(np.uint64) >> np.uint64(1))
            roots, own = np.unique(root[open_], return_inverse=True)
            a, b, differ = (np.zeros(0, np.int64) for _ in range(3))
            for i, j, bits in index_pairs(number, code, NEAR):
                can = (own[i] != own[j]) & enough(size, place, i, j, similarity)
                a, b, differ = np.r_[a, i[can]], np.r_[b, j[can]], np.r_[differ, bits[can]]
                if len(a) > PAIRS:
                    keep = spanning_forest(own[a], own[b], differ, len(roots))
                    a, b, differ = a[keep], b[keep], differ[keep]
            keep = spanning_forest(own[a], own[b], differ, len(roots))
            yield pairs_batch(node, a[keep], b[keep])
        common.give_back()

    rows = met.select("key", "part", "node", GRAY, "size", "place", "root").repartition("key", "part").sortWithinPartitions("key", "part", GRAY)
    return rows.mapInArrow(join, "a long, b long").distinct()


def shingle_sets(nodes: DataFrame, words: int) -> DataFrame:
    """(node, own): the ascending hashes of each text's set of shingles."""

    def make():
        return lambda c: {"node": c["row"], "own": [np.unique(shingle_hashes(t or "", words)).astype("<u8").tobytes() for t in c["text"]]}

    return common.map_batches(nodes.select("row", "text"), "node long, own binary", make)


def alike_pairs(x: np.ndarray, y: np.ndarray, sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """Which of the pairs (x, y) of numbers of sets have this Jaccard similarity; x is ascending."""
    start = np.cumsum([0, *map(len, sets)])
    words, ids = np.unique(np.concatenate(sets), return_inverse=True)
    size, mark, out = np.diff(start), np.zeros(len(words), bool), np.zeros(len(x), bool)
    begin = np.flatnonzero(np.r_[len(x) > 0, x[1:] != x[:-1]])
    for a, b in zip(begin, [*begin[1:], len(x)], strict=False):
        mine = ids[start[x[a]] : start[x[a] + 1]]
        mark[mine] = True
        for c in range(a, b, 256):
            to = y[c : min(b, c + 256)]
            length = size[to]
            at = np.repeat(start[to] - np.r_[0, np.cumsum(length)[:-1]], length) + np.arange(length.sum())
            both = np.bincount(np.repeat(np.arange(len(to)), length), mark[ids[at]], len(to))
            out[c : c + len(to)] = both >= similarity * (size[x[a]] + length - both)
        mark[mine] = False
    return out


def places(met: DataFrame) -> DataFrame:
    """Where the rows of groups that still hold several roots meet: key (a task's share), shingle, node, root, size, place and side. met has key, node, size, place and root.

    The rows of a group's most common root and its other rows are dealt
    into blocks of GROUP rows and SHINGLES shingles; the former meet the blocks of the latter, and these each other, in a task for two blocks.
    So a large family with a few strangers costs its rows, not its pairs. Groups that begin with the same node go to the same
    task, TOGETHER rows of them, and give each pair once: relatives share many keys.
    """
    counts = met.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("held"), F.min("node").alias("lead"))
    size = counts.groupBy("key").agg(F.sum("n").alias("rows"), F.sum("held").alias("shingles"), F.max(F.struct("n", "root", "held")).alias("most"), F.min("lead").alias("lead")).where("rows > most.n")
    blocks = lambda n, held: F.ceil(F.greatest(n / GROUP, held / SHINGLES)).cast("int")
    parts = size.select("key", "lead", "rows", "shingles", F.col("most.root").alias("common"), blocks(F.col("most.n"), F.col("most.held")).alias("first"), blocks(F.col("rows") - F.col("most.n"), F.col("shingles") - F.col("most.held")).alias("others"))
    # a family's shingles count once for each key it shares: many times more than a task holds
    leads = parts.groupBy("lead").agg(F.ceil(F.greatest(F.sum("rows") / TOGETHER, F.sum("shingles") / (16 * SHINGLES))).cast("int").alias("tasks"))
    rows = met.join(parts.drop("rows", "shingles").join(leads, "lead"), "key").withColumn("usual", F.col("root") == F.col("common"))
    deal = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    rows = rows.withColumn("own", F.when(F.col("usual"), deal(F.col("first"))).otherwise(F.col("first") + deal(F.col("others"))))
    rows = rows.withColumn("other", F.explode(F.sequence(F.when(F.col("usual"), F.col("first")).otherwise(0), F.col("first") + F.col("others") - 1)))
    place = F.xxhash64("lead", F.pmod(F.xxhash64("key"), F.col("tasks")), F.least("own", "other"), F.greatest("own", "other"))
    return rows.select(place.alias("key"), F.col("key").alias("shingle"), "node", "root", "size", "place", F.when(F.col("own") != F.col("other"), F.col("own")).otherwise(-1).alias("side"))


class Seats:
    """The rows of whole places in a task: a seat for each place and node, and the pairs of seats that can be similar by sizes and places."""

    def __init__(self, table: pa.Table) -> None:
        order = np.lexsort((table.column("root").to_numpy(), table.column("shingle").to_numpy(), table.column("key").to_numpy()))
        key, self.shingle, node, self.root, self.size, self.place, self.side = (table.column(c).to_numpy()[order] for c in ("key", "shingle", "node", "root", "size", "place", "side"))
        self.other_key = np.r_[0, key[1:] != key[:-1]]
        nodes, at = np.unique(node, return_inverse=True)
        _, first, self.seat = np.unique(np.cumsum(self.other_key) * len(nodes) + at, return_index=True, return_inverse=True)
        #: Of each seat.
        self.keys, self.nodes, self.sizes = key[first], node[first], self.size[first]

    def pairs(self, similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(x, y), x < y and ascending: about PAIRS pairs at a time, each once in a part."""
        new = self.other_key | np.r_[0, self.shingle[1:] != self.shingle[:-1]]
        group, number = np.cumsum(new), np.cumsum(new | np.r_[0, self.root[1:] != self.root[:-1]])
        start, end = group_ends(number), group_ends(group)  # of the other roots' rows
        following = end - start
        total = np.cumsum(following)
        n, rows = len(self.nodes), len(self.seat)
        seen: list[np.ndarray] = []
        at = 0
        while at < rows:
            before = total[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(total, before + PAIRS, side="right")))
            i = np.repeat(np.arange(at, to), following[at:to])
            j = np.repeat(start[at:to], following[at:to]) + np.arange(len(i)) - np.repeat(total[at:to] - following[at:to] - before, following[at:to])
            can = ((self.side[i] < 0) | (self.side[i] != self.side[j])) & enough(self.size, self.place, i, j, similarity)
            x, y = self.seat[i[can]], self.seat[j[can]]
            seen.append(np.unique(np.minimum(x, y) * n + np.maximum(x, y)))
            at = to
            if at == rows or sum(map(len, seen)) > PAIRS:
                seen = [np.unique(np.concatenate(seen))]
                if at == rows or len(seen[0]) > PAIRS // 2:
                    yield seen[0] // n, seen[0] % n
                    seen = []


class Bounds:
    """Histograms of numbered sets, and which pairs they allow: the sum of the buckets' lesser counts bounds what two sets share."""

    def __init__(self, buckets: list[bytes], size: np.ndarray) -> None:
        self.buckets, self.size = [np.frombuffer(b, np.uint8) for b in buckets], size.astype(np.int64)
        self.width = np.array([len(b) for b in self.buckets])
        self.full = np.array([b.max() == 255 for b in self.buckets])
        self.folded: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def of(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Each set's row in the second array, where sets of so many buckets or more have that many."""
        if width not in self.folded:
            wide = self.width >= width
            self.folded[width] = np.cumsum(wide) - 1, np.array([b.reshape(-1, width).sum(0, dtype=np.int32) for b, w in zip(self.buckets, wide, strict=True) if w])
        return self.folded[width]

    def allow(self, x: np.ndarray, y: np.ndarray, similarity: float) -> np.ndarray:
        out = self.full[x] | self.full[y]
        least = np.minimum(self.width[x], self.width[y])
        for width in np.unique(least[~out]).tolist():
            row, counts = self.of(width)
            pairs, step = np.flatnonzero(~out & (least == width)), max(1, (1 << 21) // width)
            for c in (pairs[k : k + step] for k in range(0, len(pairs), step)):
                both = np.minimum(counts[row[x[c]]], counts[row[y[c]]]).sum(1)
                out[c] = both >= similarity / (1 + similarity) * (self.size[x[c]] + self.size[y[c]]) - 1e-6
        return out


def seated(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Seats, list[bytes]]]:
    """The seats of whole places, and what each seat's node has in `own`: rows of a place either sit there or hold a node's own."""
    for table in whole_groups(batches, ["key"], rows=4096):
        have = table.column("own").is_valid()
        held, seats = table.filter(have), Seats(table.filter(pc.invert(have)))
        own = dict(zip(held.column("node").to_pylist(), held.column("own").to_pylist(), strict=True))
        yield seats, [own[n] for n in seats.nodes.tolist()]


def with_own(rows: DataFrame, own: DataFrame) -> DataFrame:
    """Rows of places, and one more for each node in a place with its `own` (key, node, own)."""
    return by_key(rows.withColumn("own", F.lit(None).cast("binary")).unionByName(own.select("key", "node", "own"), allowMissingColumns=True))


def close_seats(rows: DataFrame, buckets: DataFrame, similarity: float) -> DataFrame:
    """(key, node) of the rows of places that have a pair there which sizes, places and histograms allow; buckets has node and buckets. The others have no link there."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for seats, own in seated(batches):
            bounds, close = Bounds(own, seats.sizes), np.zeros(len(own), bool)
            for x, y in seats.pairs(similarity):
                unsettled = ~(close[x] & close[y])
                x, y = x[unsettled], y[unsettled]
                allowed = bounds.allow(x, y, similarity)
                close[x[allowed]] = close[y[allowed]] = True
            yield pa.RecordBatch.from_arrays([pa.array(seats.keys[close]), pa.array(seats.nodes[close])], names=["key", "node"])
        common.give_back()

    own = rows.select("key", "node").distinct().join(buckets.select("node", F.col("buckets").alias("own")), "node")
    return with_own(rows, own).mapInArrow(join, "key long, node long")


def remaining_links(met: DataFrame, similarity: float, sets: DataFrame | Callable[[DataFrame], DataFrame] | None = None, buckets: DataFrame | None = None) -> DataFrame:
    """(a, b), a < b: all pairs of a group that differ in `root` and can have this similarity. met has key, node, size, place and root.

    With sets (node, own), the pairs are compared where they meet, and of those that have the similarity a spanning forest of each task is given, staged:
    a large family without a link has many pairs, and no row for any of them.
    A set goes to every place where its node sits, many times its size. So with buckets (node, buckets: histograms, a hundredth of the sets) only nodes that have a pair at a place
    which histograms allow sit there; sets may then be a function that makes them for the nodes it is given.

    Groups of one root are done; for the others see places().
    """
    rows = places(met)
    if sets is None:

        def give(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for table in whole_groups(batches, ["key"]):
                seats = Seats(table)
                yield from (pairs_batch(seats.nodes, x, y) for x, y in seats.pairs(similarity))
            common.give_back()

        return by_key(rows).mapInArrow(give, "a long, b long").distinct()

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for seats, held in seated(batches):
            own = [np.frombuffer(o, "<u8") for o in held]
            bounds = Bounds([histogram(o) for o in own], seats.sizes)
            for x, y in seats.pairs(similarity):
                allowed = bounds.allow(x, y, similarity)
                taken, at = np.unique(np.r_[x[allowed], y[allowed]], return_inverse=True)
                if not len(taken):
                    continue
                x, y = at[: len(at) // 2], at[len(at) // 2 :]
                alike = alike_pairs(x, y, [own[k] for k in taken.tolist()], similarity)
                yield pairs_batch(seats.nodes[taken], *local_stars(x[alike], y[alike], len(taken)))
        common.give_back()

    made = [common.staged(rows, "places")]
    rows = made[0]
    here = rows.select("key", "node").distinct()
    if buckets is not None:
        made.append(here := common.staged(close_seats(rows, buckets, similarity), "seats"))
        rows = rows.join(here, ["key", "node"], "left_semi")
    if callable(sets):
        made.append(sets := common.staged(sets(here.select("node").distinct()), "sets"))
    found = common.staged(with_own(rows, here.join(sets, "node")).mapInArrow(join, "a long, b long").distinct(), "confirmed")
    for df in made:
        common.unstage(df)
    return found


def possible(links: DataFrame, rows: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) whose histograms allow the similarity: the sum of the buckets' lesser counts bounds what two sets share. It loses no link."""

    def make():
        def step(c):
            kept = []
            for x, y, n, m in zip(c["buckets_a"], c["buckets_b"], c["size_a"], c["size_b"], strict=True):
                s, t = np.frombuffer(x, np.uint8).astype(np.int32), np.frombuffer(y, np.uint8).astype(np.int32)
                full = max(s.max(), t.max()) == 255
                least = min(len(s), len(t))
                s, t = s.reshape(-1, least).sum(0), t.reshape(-1, least).sum(0)
                kept.append(bool(full or np.minimum(s, t).sum() >= similarity / (1 + similarity) * (n + m) - 1e-6))
            return {"a": c["a"], "b": c["b"], "kept": kept}

        return step

    side = lambda x: rows.select(F.col("row").alias(x), F.col("buckets").alias(f"buckets_{x}"), F.col("size").alias(f"size_{x}"))
    return common.map_batches(links.join(side("b"), "b").join(side("a"), "a"), "a long, b long, kept boolean", make).where("kept").select("a", "b")


def confirmed(links: DataFrame, rows: DataFrame, words: int, similarity: float) -> DataFrame:
    """Links (a, b) whose texts' shingle sets have at least this Jaccard similarity; rows has row, text, size and buckets."""

    def make():
        def step(c):
            sets = {t: np.unique(shingle_hashes(t or "", words)) for t in {*c["text_a"], *c["text_b"]}}
            alike = []
            for s, t in zip(map(sets.get, c["text_a"]), map(sets.get, c["text_b"]), strict=True):
                both = len(np.intersect1d(s, t, assume_unique=True))
                alike.append(both >= similarity * (len(s) + len(t) - both))
            return {"a": c["a"], "b": c["b"], "alike": alike}

        return step

    links = common.staged(possible(links, rows, similarity), "possible")
    ends = common.staged(links.select(F.col("a").alias("row")).union(links.select("b")).distinct(), "ends")
    texts = common.staged(rows.select("row", "text").join(ends, "row", "left_semi"), "texts")
    pairs = links.join(texts.select(F.col("row").alias("b"), F.col("text").alias("text_b")), "b").join(texts.select(F.col("row").alias("a"), F.col("text").alias("text_a")), "a")
    found = common.staged(common.map_batches(pairs, "a long, b long, alike boolean", make).where("alike").select("a", "b"), "confirmed")
    for df in (links, ends, texts):
        common.unstage(df)
    return found


def joined(roots: DataFrame | None, found: DataFrame) -> DataFrame:
    """(node, root) after more links: components of the old roots by the new links, which are few and near, instead of those of all links anew."""
    if roots is None:
        return common.staged(components(found), "roots")
    at = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}"))
    ends = found.join(at("a"), "a", "left").join(at("b"), "b", "left").select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b"))
    moved = common.staged(components(ends), "moved")
    old = roots.join(moved.select(F.col("node").alias("root"), F.col("root").alias("now")), "root", "left").select("node", F.coalesce("now", "root").alias("root"))
    following = common.staged(old.union(moved.join(roots, "node", "left_anti").select("node", "root")), "roots")
    for df in (moved, roots):
        common.unstage(df)
    return following


def linked(nodes: DataFrame, words: int, similarity: float) -> DataFrame:
    """(node, root): the component of each linked row. nodes has row (a unique long), text and what with_sets() adds; no two sets are equal."""
    met = common.staged(meetings(nodes.withColumnRenamed("row", "node"), similarity), "meetings")
    roots = None
    tried: list[DataFrame] = []
    rooted = lambda: met.withColumn("root", F.col("node")) if roots is None else met.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    for search in (nearest_links, lambda m: near_links(m, similarity)):
        links = search(rooted())
        for done in tried:
            links = links.join(done, ["a", "b"], "left_anti")
        tried.append(common.staged(links, "candidates"))
        found = confirmed(tried[-1], nodes, words, similarity)
        roots = joined(roots, found)
        common.unstage(found)
    now = common.staged(rooted(), "rooted")
    sets = lambda ends: shingle_sets(nodes.select("row", "text").join(ends.withColumnRenamed("node", "row"), "row", "left_semi"), words)
    found = remaining_links(now, similarity, sets, nodes.select(F.col("row").alias("node"), "buckets"))
    roots = joined(roots, found)
    for df in (met, now, found, *tried):
        common.unstage(df)
    return roots


def keep_one(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """docs without near-duplicates: of each group of linked rows the one with the smallest doc_id stays.

    Two rows are linked if their sets of word shingles have a Jaccard
    similarity of at least `similarity`. Null and empty texts are copies of one another.
    Null ids come last; of rows with equal ids in a group one stays. Columns
    are those of docs, whatever their names; an empty table stays empty.
    """
    names = docs.columns
    plain = docs.select(*[F.col(f"`{c}`").alias("text" if c == "text" else f"c{i}") for i, c in enumerate(names)])
    at = {c: "text" if c == "text" else f"c{i}" for i, c in enumerate(names)}
    id_ = F.col(at["doc_id"])
    sets = with_sets(plain, frequent(plain.select(at["doc_id"], "text"), words), words, similarity)
    rows = common.staged(sets.withColumn("row", F.monotonically_increasing_id()), "documents")

    # only rows that have a copy or a link take part in what follows; all others stay as they are
    several = common.staged(rows.groupBy(*DIGEST).agg(F.min("row").alias("node"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "copies")
    copies = common.staged(rows.select("row", *DIGEST).join(several, DIGEST).where("row <> node").select("row", "node"), "copies")
    roots = linked(rows.join(copies.select("row"), "row", "left_anti"), words, similarity)
    member = copies.union(several.select(F.col("node").alias("row"), "node")).union(roots.select("node", "node")).distinct()
    member = common.staged(member.join(roots, "node", "left").select("row", F.coalesce("root", "node").alias("root")), "members")
    ids = rows.select("row", id_.isNull().alias("none"), id_.alias("id")).join(member, "row")
    first = ids.groupBy("root").agg(F.min(F.struct("none", "id", "row")).alias("first")).select(F.col("first.row").alias("row"))
    gone = common.staged(member.select("row").join(first, "row", "left_anti"), "duplicates")
    for df in (several, copies, member):
        common.unstage(df)
    stays = rows.join(gone, "row", "left_anti")
    return stays.select(*[F.col(v).alias(k) for k, v in at.items()])
