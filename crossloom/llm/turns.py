"""Conversations with broken turn structure, and their cheapest repair.

A repaired conversation reads `(system? (user assistant)+)?`. Edits keep a turn, give it another role,
delete it or insert an empty one; of the cheapest edits the least audit (the edits' initials in order) counts.

The search is a dynamic program over four states (nothing yet, after system, after user, after
assistant). One turn and the inserts before it are one macro edit; its code (`IIK`, `D`, ...) ends in
the only letter that isn't I, so codes are prefix-free and audits of equally many turns compare like
sequences of codes. No audit is ever built in the search: a layer keeps for each state its cost, the
rank of its audit among the layer's, and the state it came from. Audits are read off afterwards.

The program runs from all four states at once, so a stretch of turns sums up to a 4 x 4 matrix of
costs and ranks, just like a single turn. A conversation of any length is cut into stretches that
different tasks work on, and a second run of the same program joins the stretches' matrices.

Turns are ordered by turn (nulls first), then role and text. Null roles and texts count as one space,
a null id is a conversation of its own. An empty role has no initial and fits nowhere. Repeated rows are
turns like others (the second one is a duplicate). Extra columns are not read; texts are read whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Costs of the edits, and of a truncated turn that stays.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
SPACES = " \t\n\x0b\x0c\r"
#: A stretch holds 2 to this power turns at most.
STRETCH = 16
#: Turns or stretches that the program works on at once, if no single conversation has more.
AT_ONCE = 1 << 15

#: What a turn is: its first fault times four, plus its role's initial. States: nothing yet, after system, after user, after assistant.
FINE, CUT, BLANK, DUPLICATE = range(4)
SYSTEM, USER, ASSISTANT, OTHER = range(4)
_NEXT = (2, 2, 3, 2)
_KEEP = ((1, 2, None, None), (None, 2, None, None), (None, None, 3, None), (None, 2, None, None))
_ROLE = {2: "user", 3: "assistant"}
#: Inserts that end a conversation rightly from each state.
_TAIL = (0, 2, 1, 0)
CODES = sorted("I" * n + x for n in range(3) for x in "DKR")
_FAR = 1 << 50


def _macros() -> tuple[np.ndarray, np.ndarray]:
    """Cost and code of the best macro edit of each kind of turn from state to state."""
    cost, code = np.full((16, 4, 4), _FAR, np.int64), np.zeros((16, 4, 4), np.int64)
    for kind in range(16):
        fault, initial = divmod(kind, 4)
        for begin in range(4):
            state = begin
            for inserts in range(3):
                ways = [("D", state, DELETE)]
                if fault <= CUT:
                    ways.append(("R", _NEXT[state], REROLE + TRUNCATED * (fault == CUT)))
                    if _KEEP[state][initial] is not None:
                        ways.append(("K", _KEEP[state][initial], TRUNCATED * (fault == CUT)))
                for way, end, price in ways:
                    new = (price + INSERT * inserts, CODES.index("I" * inserts + way))
                    if new < (cost[kind, begin, end], code[kind, begin, end]):
                        cost[kind, begin, end], code[kind, begin, end] = new
                state = _NEXT[state]
    return cost, code


MACRO_COST, MACRO_CODE = _macros()


def _layers(length: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(t, lanes longer than t) for t = 0, 1, ..."""
    order = np.argsort(-length, kind="stable")
    alive = len(length) - np.searchsorted(np.sort(length), np.arange(length.max(initial=0)), side="right")
    for t, n in enumerate(alive.tolist()):
        yield t, order[:n]


def fold(cost: np.ndarray, rank: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Run the program over lanes of 4 x 4 matrices: lane i is matrices start[i] to start[i] + length[i].

    Returns the lanes' costs and audit ranks from state to state, and for each matrix the states come from (16 of two bits).
    """
    lanes = len(start)
    best = np.broadcast_to(np.where(np.eye(4, dtype=bool), 0, _FAR), (lanes, 4, 4)).copy()
    place = np.zeros((lanes, 4, 4), np.int64)
    came = np.zeros(len(cost), np.uint32)
    shifts = np.arange(0, 32, 2, dtype=np.uint32)
    for t, lane in _layers(length):
        row = start[lane] + t
        way = ((np.minimum(best[lane][:, :, :, None] + cost[row][:, None], _FAR)) << 8) | (place[lane][:, :, :, None] << 4) | rank[row][:, None]
        source = way.argmin(2)
        won = np.take_along_axis(way, source[:, :, None, :], 2)[:, :, 0, :].reshape(-1, 16)
        came[row] = (source.reshape(-1, 16).astype(np.uint32) << shifts).sum(1, dtype=np.uint32)
        best[lane] = (won >> 8).reshape(-1, 4, 4)
        codes = won & 255
        order = codes.argsort(1)
        ordered = np.take_along_axis(codes, order, 1)
        dense = np.zeros_like(codes)
        np.cumsum(ordered[:, 1:] != ordered[:, :-1], axis=1, out=dense[:, 1:])
        ranks = np.empty_like(codes)
        np.put_along_axis(ranks, order, dense, 1)
        place[lane] = ranks.reshape(-1, 4, 4)
    return best, place, came


def trace(came: np.ndarray, start: np.ndarray, length: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(state before, state after) of every matrix on the lanes' best ways from begin to end."""
    before, after = np.zeros(len(came), np.int64), np.zeros(len(came), np.int64)
    state = end.astype(np.int64).copy()
    for t, lane in reversed(list(_layers(length))):
        row = start[lane] + t
        after[row] = state[lane]
        state[lane] = (came[row].astype(np.int64) >> (2 * (4 * begin[lane] + state[lane]))) & 3
        before[row] = state[lane]
    return before, after


def damage(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text): the rows with known faults put in, by crc32(`conv_id:turn`) modulo 20."""
    conv, turn = (conversations[c].cast("long") for c in ("conv_id", "turn"))
    role, text = (F.coalesce(conversations[c].cast("string"), F.lit(" ")) for c in ("role", "text"))
    fate = F.crc32(F.concat(F.coalesce(conv.cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(turn.cast("string"), F.lit(" "))).cast("binary")) % 20
    rows = conversations.select(conv.alias("conv_id"), turn.alias("turn"), F.when(fate == 4, "user").otherwise(role).alias("role"), F.when(fate == 1, "").when(fate == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"), fate.alias("_fate"))
    return rows.where("_fate != 0").select("conv_id", "turn", "role", "text", F.explode(F.when(F.col("_fate") == 3, F.array(F.lit(0), F.lit(0))).otherwise(F.array(F.lit(0)))).alias("_copy")).drop("_copy")


def placed(rows: DataFrame) -> DataFrame:
    """rows with `pos`, an order number over all of them, as a written table. A long conversation spreads over several partitions."""
    rows = rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")])
    dealt = rows.repartitionByRange("conv_id", "turn", F.substring("role", 1, 64), F.substring("text", 1, 64))
    return common.staged(dealt.sortWithinPartitions("conv_id", "turn", "role", "text").withColumn("pos", F.monotonically_increasing_id()), "turns")


def kinds(rows: DataFrame) -> DataFrame:
    """(pos, conv_id, turn, kind) of placed rows; texts stay behind. A text is a duplicate unless it is the first of its conversation and role."""
    end = F.rtrim(F.col("text"), F.lit(SPACES))
    blank = end == ""
    initial = F.coalesce(*[F.when(F.substring("role", 1, 1) == x, i) for i, x in enumerate("sua")], F.lit(OTHER))
    narrow = rows.select("pos", "conv_id", "turn", initial.alias("initial"), F.when(blank, BLANK).when(~F.right(end, F.lit(1)).isin(".", "!", "?"), CUT).otherwise(FINE).alias("fault"))
    firsts = rows.where(~blank).groupBy("conv_id", "role", F.unhex(F.sha2("text", 256)).alias("_digest")).agg(F.min("pos").alias("pos")).select("pos", F.lit(True).alias("_first"))
    fault = F.when((F.col("fault") == BLANK) | F.col("_first"), F.col("fault")).otherwise(DUPLICATE)
    return narrow.join(firsts, "pos", "left").select("pos", "conv_id", "turn", (fault * 4 + F.col("initial")).cast("int").alias("kind"))


def _breaks(c: pa.Array) -> np.ndarray:
    """Where a run of equal values (nulls are equal) begins."""
    codes = pc.dictionary_encode(c, null_encoding="encode").indices.to_numpy()
    return np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]])) if len(codes) else np.zeros(0, np.int64)


def _whole(batches: Iterator[pa.RecordBatch], key: int, least: int) -> Iterator[pa.Table]:
    """Batches joined so that no run of column `key` is cut, of `least` rows or one run at least."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows >= least:
            table = pa.Table.from_batches(held).combine_chunks()
            cut = int(_breaks(table.column(key).chunk(0))[-1])
            if cut:
                yield table.slice(0, cut).combine_chunks()
                held, rows = table.slice(cut).combine_chunks().to_batches(), table.num_rows - cut
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _column(table: pa.Table, name: str) -> pa.Array:
    c = table.column(name)
    return c.chunk(0) if c.num_chunks == 1 else pa.concat_arrays(c.chunks)


_LEGAL = np.zeros((4, 4), bool)
_LEGAL[[SYSTEM, USER, ASSISTANT], [USER, ASSISTANT, USER]] = True
_SUMMARY = "first long, conv_id long, kinds binary, came binary, cost binary, rank binary, blank long, duplicate long, truncated long, illegal long, turns long, low long, high long, opens int, closes int"


def stretches(facts: DataFrame) -> DataFrame:
    """One row per stretch: what its turns are, the program's matrices and pointers, and its tallies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole(batches, 0, AT_ONCE):
            pos, conv, turn, kind = (_column(table, c) for c in ("pos", "conv_id", "turn", "kind"))
            begin = np.unique(np.concatenate([_breaks(_column(table, "block")), _breaks(conv)]))
            length = np.diff(np.append(begin, table.num_rows))
            kind = kind.to_numpy().astype(np.int64)
            cost, rank, came = fold(MACRO_COST[kind], MACRO_CODE[kind], begin, length)
            fault, initial = kind // 4, kind % 4
            opened = np.zeros(len(kind), bool)
            opened[begin] = True
            known = turn.is_valid().to_numpy(zero_copy_only=False)
            number = pc.fill_null(turn, 0).to_numpy()
            new = known & (opened | ~np.roll(known, 1) | (number != np.roll(number, 1)))
            illegal = ~opened & ~_LEGAL[np.roll(initial, 1), initial]
            last = begin + length - 1
            top, least = np.iinfo(np.int64).max, np.iinfo(np.int64).min
            low, high = np.minimum.reduceat(np.where(known, number, top), begin), np.maximum.reduceat(np.where(known, number, least), begin)
            none = ~np.maximum.reduceat(known, begin)
            ends = [*begin.tolist(), len(kind)]
            cut = lambda a: pa.array([a[i:j].tobytes() for i, j in zip(ends, ends[1:], strict=False)], pa.binary())  # noqa: B023, E731
            sums = [pa.array(np.add.reduceat(x.astype(np.int64), begin)) for x in (fault == BLANK, fault == DUPLICATE, fault == CUT, illegal, new)]
            each = lambda a, t: pa.array([x.tobytes() for x in a.astype(t).reshape(-1, 16)], pa.binary())
            yield pa.RecordBatch.from_arrays([pos.take(pa.array(begin)), conv.take(pa.array(begin)), cut(kind.astype(np.uint8)), cut(came), each(cost, np.int64), each(rank, np.uint8), *sums, pa.array(low, mask=none), pa.array(high, mask=none), pa.array(initial[begin].astype(np.int32)), pa.array(initial[last].astype(np.int32))], names=[x.split()[0] for x in _SUMMARY.split(", ")])

    block = F.shiftright("pos", STRETCH)
    dealt = facts.select(block.alias("block"), "pos", "conv_id", "turn", "kind").repartition("block").sortWithinPartitions("pos")
    return common.staged(dealt.mapInArrow(run, _SUMMARY), "stretches")


_PLAN = "first long, conv_id long, begin int, end int, tail int, last boolean, gaps long, blank long, duplicate long, truncated long, illegal long, cost long"


def plans(summed: DataFrame) -> DataFrame:
    """One row per stretch: the states it begins and ends in; the conversation's last one carries its end inserts, tallies and cost."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole(batches, 1, AT_ONCE):
            begin = _breaks(_column(table, "conv_id"))
            length = np.diff(np.append(begin, table.num_rows))
            last = begin + length - 1
            matrix = lambda c, t: np.frombuffer(b"".join(_column(table, c).to_pylist()), t).astype(np.int64).reshape(-1, 4, 4)  # noqa: B023, E731
            cost, rank, came = fold(matrix("cost", np.int64), matrix("rank", np.uint8), begin, length)
            total = np.minimum(cost[:, 0] + INSERT * np.array(_TAIL), _FAR)
            end = ((total << 8) | (rank[:, 0] << 4) | np.array(_TAIL)).argmin(1)
            before, after = trace(came, begin, length, np.zeros(len(begin), np.int64), end)
            opens, closes = _column(table, "opens").to_numpy(), _column(table, "closes").to_numpy()
            inner = np.ones(table.num_rows, bool)
            inner[begin] = False
            low, high = _column(table, "low"), _column(table, "high")
            known = low.is_valid().to_numpy(zero_copy_only=False)
            low, high = pc.fill_null(low, 0).to_numpy(), pc.fill_null(high, 0).to_numpy()
            again = inner & known & np.roll(known, 1) & (low == np.roll(high, 1))
            joins = inner & ~_LEGAL[np.roll(closes, 1), opens]
            tally = lambda c, more=0: np.add.reduceat(_column(table, c).to_numpy() + more, begin)  # noqa: B023, E731
            turns = tally("turns", -again.astype(np.int64))
            top, least = np.iinfo(np.int64).max, np.iinfo(np.int64).min
            span = np.maximum.reduceat(np.where(known, high, least), begin) - np.minimum.reduceat(np.where(known, low, top), begin) + 1 - turns
            sums = {"gaps": np.where(turns > 0, span, 0), **{c: tally(c) for c in ("blank", "duplicate", "truncated")}, "illegal": tally("illegal", joins.astype(np.int64)), "cost": total[np.arange(len(begin)), end]}
            wide = {c: np.zeros(table.num_rows, np.int64) for c in sums}
            for c, x in sums.items():
                wide[c][last] = x
            tail, is_last = np.zeros(table.num_rows, np.int32), np.zeros(table.num_rows, bool)
            tail[last], is_last[last] = np.array(_TAIL)[end], True
            yield pa.RecordBatch.from_arrays([_column(table, "first"), _column(table, "conv_id"), pa.array(before.astype(np.int32)), pa.array(after.astype(np.int32)), pa.array(tail), pa.array(is_last), *[pa.array(wide[x.split()[0]]) for x in _PLAN.split(", ")[6:]]], names=[x.split()[0] for x in _PLAN.split(", ")])

    narrow = summed.drop("kinds", "came").repartition("conv_id").sortWithinPartitions("conv_id", "first")
    return common.staged(narrow.mapInArrow(run, _PLAN), "plans")


def edits(summed: DataFrame, plan: DataFrame) -> DataFrame:
    """(pos, ahead, edit, new_role, behind) of every turn: roles inserted ahead of it and, at a conversation's end, behind it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = []
        for state in range(4):
            roles: list[list[str]] = [[]]
            for _ in range(2):
                roles.append([*roles[-1], _ROLE[_NEXT[state]]])
                state = _NEXT[state]
            runs.append(roles)
        for batch in batches:
            table = pa.Table.from_batches([batch])
            kind = np.frombuffer(b"".join(_column(table, "kinds").to_pylist()), np.uint8).astype(np.int64)
            came = np.frombuffer(b"".join(_column(table, "came").to_pylist()), np.uint32)
            length = pc.binary_length(_column(table, "kinds")).to_numpy().astype(np.int64)
            start = np.cumsum(length) - length
            begin, end, tail, first = (_column(table, c).to_numpy().astype(np.int64) for c in ("begin", "end", "tail", "first"))
            before, after = trace(came, start, length, begin, end)
            code = MACRO_CODE[kind, before, after]
            pos = np.repeat(first - start, length) + np.arange(len(kind))
            behind: list[list[str]] = [[]] * len(kind)
            for i in np.flatnonzero(tail).tolist():
                behind[start[i] + length[i] - 1] = runs[end[i]][tail[i]]
            text = [CODES[x] for x in code.tolist()]
            ahead = [runs[s][len(x) - 1] for s, x in zip(before.tolist(), text, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(pos), pa.array(ahead, pa.list_(pa.string())), pa.array([x[-1] for x in text]), pa.array([_ROLE.get(s) if x[-1] == "R" else None for s, x in zip(after.tolist(), text, strict=True)], pa.string()), pa.array(behind, pa.list_(pa.string()))], names=["pos", "ahead", "edit", "new_role", "behind"])

    joined = summed.select("first", "kinds", "came").join(plan.select("first", "begin", "end", "tail"), "first")
    return joined.mapInArrow(run, "pos long, ahead array<string>, edit string, new_role string, behind array<string>")


def _step(edit: Column | str, role: Column, text: Column) -> Column:
    return F.struct((F.lit(edit) if isinstance(edit, str) else edit).alias("edit"), role.alias("role"), text.alias("text"))


class Repair:
    """The repair of a table of conversations: `steps()` lists every edit with its turn, `turns()` the repaired turns, `report()` one row per conversation."""

    def __init__(self, conversations: DataFrame):
        self.rows = placed(conversations)
        self.stretches = stretches(kinds(self.rows))
        self.plan = plans(self.stretches)

    def steps(self) -> DataFrame:
        """(conv_id, turn, pos, step, edit, role, text): the edits in the order of pos and step; D shows what was deleted."""
        inserted = lambda c: F.transform(c, lambda r: _step("I", r, F.lit("")))
        own = _step(F.col("edit"), F.coalesce("new_role", "role"), F.col("text"))
        all_steps = F.concat(inserted("ahead"), F.array(own), inserted("behind"))
        joined = self.rows.join(edits(self.stretches, self.plan), "pos")
        return joined.select("conv_id", "turn", "pos", F.posexplode(all_steps).alias("step", "c")).select("conv_id", "turn", "pos", "step", "c.*")

    def turns(self) -> DataFrame:
        return self.steps().where("edit != 'D'")

    def digests(self) -> DataFrame:
        """(conv_id, audit, repaired_sha256). A hash reads its conversation in one go, so one task streams it, row by row and in little memory."""
        steps = self.steps().select("conv_id", "pos", "step", "edit", F.when(F.col("edit") != "D", F.concat("role", F.lit(":"), "text").cast("binary")).alias("line"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            conv, hashed, audit, lines = None, None, [], 0
            done: list[tuple] = []
            for batch in batches:
                for c, edit, line in zip(*(batch.column(x).to_pylist() for x in (0, 3, 4)), strict=True):
                    if hashed is None or c != conv:
                        if hashed is not None:
                            done.append((conv, "".join(audit), hashed.hexdigest()))
                        conv, hashed, audit, lines = c, hashlib.sha256(), [], 0
                    audit.append(edit)
                    if line is not None:
                        hashed.update(b"\n" + line if lines else line)
                        lines += 1
                if done:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*done, strict=True), (pa.int64(), pa.string(), pa.string()), strict=True)], names=["conv_id", "audit", "repaired_sha256"])
                    done = []
            if hashed is not None:
                yield pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), pa.array(["".join(audit)]), pa.array([hashed.hexdigest()])], names=["conv_id", "audit", "repaired_sha256"])

        return steps.repartition("conv_id").sortWithinPartitions("conv_id", "pos", "step").mapInArrow(run, "conv_id long, audit string, repaired_sha256 string")

    def report(self) -> DataFrame:
        """(conv_id, gaps, blank, duplicate, truncated, illegal, cost) per conversation that has turns."""
        return self.plan.where("last").select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return repaired(conversations)


def repaired(conversations: DataFrame) -> DataFrame:
    """Damage the conversations, repair them, and give one row per original conversation, those without turns included."""
    repair = Repair(damage(conversations))
    ids = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    found = repair.report().withColumnRenamed("conv_id", "_a").join(repair.digests().withColumnRenamed("conv_id", "_b"), F.expr("_a <=> _b"))
    all_ids = ids.join(found, F.expr("conv_id <=> _a"), "left")
    sums = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return all_ids.select("conv_id", *sums, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
