"""A Brown class-based bigram model: words are exchanged between classes, texts are scored by
p(class | class before) * p(word | class).

- Words seen at least LEAST times in training start in as many classes as there are, the most frequent ones in a class of
  their own. In each of ROUNDS rounds every word's neighbours are counted by class over the whole training corpus, and a word
  moves to the class that raises the corpus' likelihood most, if one does. Words move at the same time in all tasks.
- Words whose hashes fall in one of 2 to the power of SPREAD places move together; counts and probabilities are each word's own.
  So the table of classes is a byte a place at any size of the vocabulary, and every task holds it.
- Rarer words share a class with those of about their count; words seen once share one with the unknown word, whose part of
  it is that of first sightings (Good and Turing). The end of a text is a word with its own class, and stands before each text.
- Class transitions are smoothed towards class frequencies. Over the words known in training and one unknown word, the
  probabilities after any class sum to one (to less where no word has a band's counts).

Texts are coded once, in blocks with a small dictionary of their own; only dictionaries, never tokens, meet the
vocabulary. What is broadcast is the table of classes (4 MB), the table of class transitions and the class totals.

Null and empty texts are one end; a null id counts as empty text in the choice of training rows. Repeated rows count as
often as they stand there. Without training texts every word is unknown. Extra columns are not read; texts are read whole.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .simhash import whole_groups

#: Classes of exchanged words, and counts from which rare words share a class; before them stand the end's class and that of words seen once.
CLASSES, LEAST, BANDS, ROUNDS = 64, 20, (2, 3, 5, 10), 3
END, RARE, FIRST = 0, 1, 2 + len(BANDS)
ALL = FIRST + CLASSES
#: Places of words are numbers of so many bits, the last ones of their CRC-32.
SPREAD = 22
#: Weight of class frequencies in a transition, in occurrences.
SMOOTH = 5.0
#: Classes that a word's move is tried with exactly, the best by the present model.
TRIED = 3
#: Bytes of text in a block (a longer text is a block of its own), words that a step decides at once, and neighbours that a task gathers before it hands them on.
BLOCK, AT_ONCE, HELD = 8 << 20, 2048, 1 << 22


def learns(doc_id: Column) -> Column:
    """Rows that the model learns from: those whose crc32 of the id as text doesn't leave 2 modulo 7."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 7 != 2


def packed(a: np.ndarray) -> bytes:
    """An array's bytes, first those of lowest place, compressed; the number of elements stands before them."""
    return len(a).to_bytes(8, "little") + pa.compress(np.ascontiguousarray(a.view(np.uint8).reshape(-1, a.itemsize).T).tobytes(), codec="zstd", asbytes=True)


def unpacked(data: bytes, kind: str) -> np.ndarray:
    n, size = int.from_bytes(data[:8], "little"), np.dtype(kind).itemsize
    raw = pa.decompress(data[8:], n * size, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, n).T).reshape(-1).view(kind)


def coded(docs: DataFrame) -> DataFrame:
    """Blocks of documents: ids and lengths, tokens as numbers in the block's own word list, and each word's place and training count. Word 0 is the end, written ''."""
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), learns(docs["doc_id"]).alias("learns"), common.text_column(docs).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32

        def begin():
            numbers: dict = defaultdict()
            numbers.default_factory = numbers.__len__
            numbers[b""]  # noqa: B018
            return numbers, [], [], [], 0

        def block(number):
            ids = np.concatenate(tokens)
            length = np.array([len(x) for x in tokens], np.int64)
            trained = np.bincount(ids[np.repeat(np.array(learn), length)], minlength=len(numbers))
            place = np.array([zlib.crc32(w) for w in numbers], "<u4") & np.uint32((1 << SPREAD) - 1)
            arrays = [[task + number], [doc_ids], [learn], [length], [packed(ids)], [packed(place)], [list(numbers)], [trained]]
            types = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.int64())]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(arrays, types, strict=True)], names=["block", "doc_id", "learns", "length", "ids", "places", "words", "trained"])

        number = 0
        numbers, doc_ids, learn, tokens, size = begin()
        for batch in batches:
            for part in common.slices(batch):
                for doc_id, learned, text in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    if tokens and size + len(text) > BLOCK:
                        yield block(number)
                        number += 1
                        numbers, doc_ids, learn, tokens, size = begin()
                    words = text.lower().split()
                    words.append(b"")
                    tokens.append(np.fromiter(map(numbers.__getitem__, words), "<u4", len(words)))
                    doc_ids.append(doc_id)
                    learn.append(learned)
                    size += len(text)
        if tokens:
            yield block(number)

    return common.staged(rows.mapInArrow(run, "block long, doc_id array<long>, learns array<boolean>, length array<long>, ids binary, places binary, words array<binary>, trained array<long>"), "coded")


class Corpus:
    """The coded documents, each block with the training counts of its words (blocks), the vocabulary, and its totals."""

    def __init__(self, docs: DataFrame):
        first = coded(docs)
        spread = first.select("block", F.posexplode(F.arrays_zip("words", "trained")).alias("number", "c")).select("block", "number", F.col("c.words").alias("word"), F.col("c.trained").alias("n"))
        self.vocabulary = common.staged(spread.where("n > 0").groupBy("word").agg(F.sum("n").alias("n")), "vocabulary")
        total = self.vocabulary.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v"), F.count_if(F.col("n") == 1).alias("n1"), F.count_if(F.col("n") == 2).alias("n2")).first()
        self.tokens, self.words, self.once, self.twice = total.n or 0, total.v, total.n1, total.n2
        known = spread.drop("n").join(self.vocabulary, "word", "left").select("block", "number", F.coalesce("n", F.lit(0).cast("long")).alias("n"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for table in whole_groups(batches, ["block"]):
                block, n = table.column("block").to_numpy(), table.column("n").to_numpy()
                begin = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
                parts = [packed(x.astype("<i8")) for x in np.split(n, begin[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(block[begin]), pa.array(parts, pa.binary())], names=["block", "counts"])

        counts = known.repartition("block").sortWithinPartitions("block", "number").select("block", "n").mapInArrow(run, "block long, counts binary")
        self.blocks = common.staged(first.drop("words", "trained").join(counts, "block"), "blocks")
        common.unstage(first)

    def drop(self) -> None:
        for df in (self.blocks, self.vocabulary):
            common.unstage(df)


def _block(column: dict, i: int, table: np.ndarray) -> tuple[np.ndarray, ...]:
    """(tokens, length, learns, counts, places, classes) of row i; the last three by word."""
    raw = lambda c, t: unpacked(column[c][i].as_py(), t)
    values = lambda c: column[c][i].values.to_numpy(zero_copy_only=False)
    counts, places = raw("counts", "<i8"), raw("places", "<u4")
    by = np.full(len(counts), RARE, np.int64)
    for k, least in enumerate(BANDS):
        by[counts >= least] = 2 + k
    by[counts >= LEAST] = table[places[counts >= LEAST]]
    by[0] = END
    return raw("ids", "<u4"), values("length"), values("learns"), counts, places, by


def _binaries(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """One binary per row; row i ends at element ends[i]."""
    raw = np.ascontiguousarray(data)
    offsets = np.concatenate([[0], ends]).astype(np.int64) * raw.itemsize
    return pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(raw.tobytes())]).cast(pa.binary())


_CONTEXT = "place int, twins long, slots binary, times binary, cell boolean"
_NAMES = [x.split()[0] for x in _CONTEXT.split(", ")]
#: A place's slots: classes before it, classes after it, and itself before it.
_SLOTS = 2 * ALL + 1


def contexts(corpus: Corpus, table: np.ndarray, places: bool = True) -> DataFrame:
    """Per task and place of exchanged words: how often each class stands before them (slots below ALL) and after them, and how often a word of the place follows one.

    Rows with `cell` count transitions of classes instead: place is before * ALL + after, twins the count; one set a task. Without `places` there are only these.
    """
    shared = corpus.blocks.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(ALL * ALL, np.int64)
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def handed() -> pa.RecordBatch:
            key, n = np.concatenate([k for k, _ in held]), np.concatenate([n for _, n in held])
            order = np.argsort(key, kind="stable")
            key, n = key[order], n[order]
            begin = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
            key, n = key[begin], np.add.reduceat(n, begin) if len(begin) else n
            place, slot = key // _SLOTS, key % _SLOTS
            twin = slot == 2 * ALL
            own, first = np.unique(place, return_index=True)
            twins = np.zeros(len(own), np.int64)
            twins[np.searchsorted(own, place[twin])] = n[twin]
            place, slot, n = place[~twin], slot[~twin], n[~twin]
            ends = np.searchsorted(place, own, side="right")
            return pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(twins), _binaries(slot.astype(np.uint8), ends), _binaries(n, ends), pa.array(np.zeros(len(own), bool))], names=_NAMES)

        for batch in batches:
            column = dict(zip(batch.schema.names, batch.columns, strict=True))
            for i in range(batch.num_rows):
                ids, length, learns_, counts, place, by = _block(column, i, shared.value)
                x = ids[np.repeat(learns_, length)]
                if not len(x):
                    continue
                before = np.concatenate([[0], x[:-1]])
                cells += np.bincount(by[before] * ALL + by[x], minlength=ALL * ALL)
                if not places:
                    continue
                moves = counts >= LEAST
                moves[0] = False
                base = place.astype(np.int64) * _SLOTS
                keys = []
                for shift, word, other in ((0, x, before), (ALL, before, x)):
                    used = moves[word]
                    keys.append(base[word[used]] + shift + by[other[used]])
                same = moves[x] & moves[before] & (place[x] == place[before])
                keys.append(base[x[same]] + 2 * ALL)
                held.append(np.unique(np.concatenate(keys), return_counts=True))
                size += len(held[-1][0])
                if size > HELD:
                    yield handed()
                    held, size = [], 0
        if held:
            yield handed()
        used = np.flatnonzero(cells)
        none = pa.nulls(len(used), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(cells[used]), none, none, pa.array(np.ones(len(used), bool))], names=_NAMES)

    return common.staged(corpus.blocks.drop("block", "doc_id").mapInArrow(run, _CONTEXT), "contexts")


def transitions(found: DataFrame) -> np.ndarray:
    """How often class j follows class i: ALL x ALL cells, summed by Spark."""
    out = np.zeros(ALL * ALL)
    for r in found.where("cell").groupBy("place").agg(F.sum("twins").alias("n")).collect():
        out[r.place] = r.n
    return out.reshape(ALL, ALL)


def _xlogx(x: np.ndarray) -> np.ndarray:
    return np.where(x > 0, x * np.log(np.maximum(x, 1e-300)), 0.0)


def gains(table: np.ndarray, a: np.ndarray, b: np.ndarray, before: np.ndarray, after: np.ndarray, twins: np.ndarray) -> np.ndarray:
    """Change of the corpus' log likelihood when word k alone moves from class a[k] to b[k]; before and after: its neighbours by class."""
    i = np.arange(len(a))
    apart = np.ones(before.shape, bool)
    apart[i, a] = apart[i, b] = False
    change = np.zeros(len(a))
    for old, new in ((table[a], table[a] - after), (table[b], table[b] + after), (table[:, a].T, table[:, a].T - before), (table[:, b].T, table[:, b].T + before)):
        change += ((_xlogx(new) - _xlogx(old)) * apart).sum(1)
    both = before[i, a] + after[i, a] - twins, before[i, b] + after[i, b] + twins
    for old, new in ((table[a, a], table[a, a] - both[0]), (table[b, b], table[b, b] + both[1]), (table[a, b], table[a, b] - after[i, b] + before[i, a] - twins), (table[b, a], table[b, a] - before[i, b] + after[i, a] - twins)):
        change += _xlogx(new) - _xlogx(old)
    for totals, n in ((table.sum(1), after.sum(1)), (table.sum(0), before.sum(1))):
        change -= _xlogx(totals[a] - n) - _xlogx(totals[a]) + _xlogx(totals[b] + n) - _xlogx(totals[b])
    return change


def moved(table: np.ndarray, own: np.ndarray, before: np.ndarray, after: np.ndarray, twins: np.ndarray) -> np.ndarray:
    """The class that each word goes to: the best of TRIED by exact gain, or its own."""
    log = np.log((table + 0.5) / (table.sum(1, keepdims=True) + 0.5 * ALL))
    likely = before @ log + after @ log.T - before.sum(1)[:, None] * np.log(table.sum(0) + 0.5)
    likely = likely[:, FIRST:]
    likely[np.arange(len(own)), own - FIRST] = -np.inf
    best, out = np.zeros(len(own)), own.copy()
    for to in np.argsort(-likely, 1, kind="stable")[:, :TRIED].T + FIRST:
        gain = gains(table, own, to, before, after, twins)
        up = gain > best
        best[up], out[up] = gain[up], to[up]
    return out


def exchange(found: DataFrame, table: np.ndarray, cells: np.ndarray) -> np.ndarray:
    """The table after one round: all rows of a place meet in one task, and its words take the class that suits them best. Only places that move come back, a byte each in the table."""
    shared = found.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in whole_groups(batches, ["place"]):
            place = part.column("place").to_numpy()
            begin = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
            for a in range(0, len(begin), AT_ONCE):
                row = begin[a], begin[a + AT_ONCE] if a + AT_ONCE < len(begin) else len(place)
                rows = part.slice(row[0], row[1] - row[0])
                own = place[begin[a : a + AT_ONCE]]
                group = np.searchsorted(own, place[row[0] : row[1]])
                slots = [np.frombuffer(x, np.uint8) for x in rows.column("slots").to_pylist()]
                times = np.frombuffer(b"".join(rows.column("times").to_pylist()), np.int64)
                index = np.repeat(group * (2 * ALL), [len(x) for x in slots]) + np.concatenate(slots)
                seen = np.bincount(index, times, len(own) * 2 * ALL).reshape(len(own), 2 * ALL)
                twins = np.bincount(group, rows.column("twins").to_numpy(), len(own))
                now = shared.value[own].astype(np.int64)
                to = moved(cells, now, seen[:, :ALL], seen[:, ALL:], twins)
                yield pa.RecordBatch.from_arrays([pa.array(own[to != now]), pa.array(to[to != now].astype(np.int32))], names=["place", "class"])

    rows = found.where("NOT cell").drop("cell").repartition("place").sortWithinPartitions("place")
    moves = rows.mapInArrow(run, "place int, class int").toArrow()  # at most 2 to the power of SPREAD rows of two small numbers
    out = table.copy()
    out[moves.column("place").to_numpy()] = moves.column("class").to_numpy()
    return out


def first_table(corpus: Corpus) -> np.ndarray:
    """The class of each place: those of the CLASSES - 1 most frequent words have their own, all others the last one."""
    place = F.crc32("word").bitwiseAND(F.lit((1 << SPREAD) - 1)).cast("int")
    words = corpus.vocabulary.where((F.col("n") >= LEAST) & (F.length("word") > 0)).groupBy(place.alias("place")).agg(F.sum("n").alias("n"))
    table = np.full(1 << SPREAD, ALL - 1, np.uint8)
    for i, r in enumerate(words.orderBy(F.desc("n"), "place").limit(CLASSES - 1).collect()):
        table[r.place] = FIRST + i
    return table


def log_emissions(counts: np.ndarray, by: np.ndarray, totals: np.ndarray, once: int, unknown: float) -> np.ndarray:
    """log10 p(word | class) of words with these training counts and classes; `once` words were seen once, the unknown word has its part of their class."""
    e = counts / np.maximum(totals[by], 1)
    e[(by == RARE) & (counts > 0)] = (1 - unknown) / max(once, 1)
    e[counts == 0] = unknown
    e[by == END] = 1.0
    return np.log10(np.maximum(e, 1e-300))


class Model:
    """Fitted classes and their probabilities; `score` gives one row per document of the corpus."""

    def __init__(self, corpus: Corpus, rounds: int = ROUNDS):
        self.corpus = corpus
        self.classes = first_table(corpus)
        for _ in range(rounds):
            found = contexts(corpus, self.classes)
            self.classes = exchange(found, self.classes, transitions(found))
            common.unstage(found)
        found = contexts(corpus, self.classes, places=False)
        self.table = transitions(found)
        common.unstage(found)

    def log_transitions(self) -> np.ndarray:
        """log10 p(class j | class i), each row summing to one."""
        prior = (self.table.sum(0) + 1) / (self.table.sum() + ALL)
        return np.log10((self.table + SMOOTH * prior) / (self.table.sum(1, keepdims=True) + SMOOTH))

    def unknown(self) -> float:
        """The unknown word's part of its class."""
        once, twice = self.corpus.once, self.corpus.twice
        return (once + 1) / (once + 2 * twice + 1) if once else 1.0

    def score(self) -> DataFrame:
        log, totals, unknown = self.log_transitions(), self.table.sum(0), self.unknown()
        tokens, words, once = self.corpus.tokens, self.corpus.words, self.corpus.once

        shared = self.corpus.blocks.sparkSession.sparkContext.broadcast(self.classes)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                column = dict(zip(batch.schema.names, batch.columns, strict=True))
                for i in range(batch.num_rows):
                    x, length, learned, counts, _, by = _block(column, i, shared.value)
                    start = np.cumsum(length) - length
                    before = np.concatenate([[0], x[:-1]])
                    sums = lambda v: np.add.reduceat(v, start)  # noqa: B023, E731
                    known, base = sums((counts[x] > 0).astype(np.int64)), sums(np.log10((counts + 1) / (tokens + words + 1))[x])
                    score = sums(log[by[before], by[x]] + log_emissions(counts, by, totals, once, unknown)[x])
                    yield pa.RecordBatch.from_arrays([column["doc_id"][i].values, pa.array(~learned), pa.array(length), pa.array(known), pa.array(np.full(len(length), tokens, np.int64)), pa.array(base), pa.array(score)], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

        return self.corpus.blocks.drop("block").mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op12_class_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Model(Corpus(spark.read.parquet(f"{sf_dir}/documents.parquet"))).score()
