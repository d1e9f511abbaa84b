"""Conversation structure repair: the cheapest edits that make the roles of a conversation follow (s?(ua)+)?.

A forward Viterbi pass over the turns of each conversation with four grammar states: nothing yet, after the system turn, after a user turn, after an assistant's
turn. A turn is kept, given another role or deleted; each layer closes with inserted turns, at most two, as two lead from every state to every state that
inserts reach. A state carries the least (cost, audit string). The strings themselves are not carried: before its inserts a layer's strings all end in a turn's
edit, so none is a prefix of another, and their order is the order of their parents, then of the few letters since. A state thus holds its cost, its rank among the
four, and the hash of its repaired text so far; a byte for each state and turn leads back through the edits at the end.

Conversations are dealt by id and sorted by turn; a turn is seen once and its text is not kept, so a conversation of any length takes one pass in its task, with 4 bytes of memory for each
of its turns. Turns seen earlier are found by a sort over (role, text) in the same partitions.

A null conv_id is a conversation of its own. Null turns come first. Null roles and texts are one space. Turns of one number are ordered by role and text. Empty tables
give an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD

RETAG, DELETE, INSERT, CUT = 1, 2, 5, 5
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = (START, SYSTEM, USER, ASSISTANT)
#: States that a turn of this state may follow.
BEFORE = {SYSTEM: (START,), USER: (START, SYSTEM, ASSISTANT), ASSISTANT: (USER,)}
OF_INITIAL = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
NAME = {USER: "user", ASSISTANT: "assistant"}
#: Inserts that close a layer: (from, to, how many).
INSERTS = tuple((a, USER, 1) for a in BEFORE[USER]) + ((USER, ASSISTANT, 1),) + tuple((a, ASSISTANT, 2) for a in (START, SYSTEM))
FINAL = (START, ASSISTANT)
LETTERS = "DKR"
LEGAL = {"su", "ua", "au"}


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, gone: the rows after damage by crc32 of `conv_id:turn`; dropped ones stay with `gone`, without a text."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    way = F.pmod(F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")), F.lit(20))
    rows = rows.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), way.alias("way"))
    text = F.when(F.col("way").isin(0, 1), "").when(F.col("way") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("way") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("way") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("way") == 0).alias("gone"), copies.alias("_copy")).drop("_copy")


def fault(text: Column, seen: Column) -> Column:
    """The first fault of a turn: 1 blank, 2 duplicate, 3 truncated; else 0."""
    last = F.regexp_extract(text, r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    return F.when(~text.rlike(WORD), 1).when(seen, 2).when(~last.isin(".", "!", "?"), 3).otherwise(0)


class Repair:
    """The forward pass over one conversation's turns."""

    def __init__(self) -> None:
        # cost, rank of the string among the layer's, hash of the repaired text, whether it has a turn
        self.base: list[tuple | None] = [(0, 0, hashlib.sha256(), False), None, None, None]
        self.back = bytearray()
        self.close()

    def close(self) -> None:
        """self.closed[state]: (cost, rank, inserts, base state) after at most two inserts."""
        self.closed: list[tuple | None] = [(b[0], b[1], 0, s) if b else None for s, b in enumerate(self.base)]
        for a, to, n in INSERTS:
            if (b := self.base[a]) and (self.closed[to] is None or (b[0] + INSERT * n, b[1]) < self.closed[to][:2]):
                self.closed[to] = (b[0] + INSERT * n, b[1], n, a)

    def text_of(self, state: int, spelled: tuple[int, bytes] | None) -> tuple:
        """The hash of a closed state's text with its inserts, and with one more turn (its state's name and text)."""
        _, _, n, source = self.closed[state]
        _, _, digest, any_turn = self.base[source]
        added = [NAME[s].encode() + b":" for s in ((ASSISTANT,) if state == ASSISTANT and n == 1 else (USER, ASSISTANT)[:n])]
        if spelled:
            added.append(spelled)
        if not added:
            return digest, any_turn
        digest = digest.copy()
        digest.update((b"\n" if any_turn else b"") + b"\n".join(added))
        return digest, True

    def turn(self, role: str, text: str, fault: int) -> None:
        best: list[tuple | None] = [None] * 4
        own = OF_INITIAL.get(role[:1])
        extra = CUT if fault == 3 else 0

        def offer(to: int, cost: int, letter: str, before: int) -> None:
            _, rank, n, source = self.closed[before]
            value = (cost, rank, "I" * n + letter, source, before, n)
            if best[to] is None or value[:3] < best[to][:3]:
                best[to] = value

        for s in STATES:
            if self.closed[s]:
                offer(s, self.closed[s][0] + DELETE, "D", s)
        if fault not in (1, 2):
            for to, befores in BEFORE.items():
                for s in befores:
                    if self.closed[s]:
                        if own == to:
                            offer(to, self.closed[s][0] + extra, "K", s)
                        elif to in NAME:
                            offer(to, self.closed[s][0] + RETAG + extra, "R", s)
        order = {x[1:3]: i for i, x in enumerate(sorted((b for b in best if b), key=lambda b: b[1:3]))}
        layer: list[tuple | None] = [None] * 4
        for to, b in enumerate(best):
            if b is None:
                self.back.append(0)
                continue
            cost, rank, letters, source, before, n = b
            spelled = None if letters[-1] == "D" else ((role if letters[-1] == "K" else NAME[to]) + ":" + text).encode()
            layer[to] = (cost, order[rank, letters], *self.text_of(before, spelled))
            self.back.append(source << 4 | n << 2 | LETTERS.index(letters[-1]))
        self.base = layer
        self.close()

    def result(self) -> tuple[int, str, str]:
        """cost, audit, hash of the repaired text."""
        end = min((s for s in FINAL if self.closed[s]), key=lambda s: (self.closed[s][:2], "I" * self.closed[s][2]))
        cost, _, n, at = self.closed[end]
        audit = ["I" * n]
        for layer in range(len(self.back) // 4 - 1, -1, -1):
            step = self.back[4 * layer + at]
            audit.append("I" * (step >> 2 & 3) + LETTERS[step & 3])
            at = step >> 4
        return cost, "".join(reversed(audit)), self.text_of(end, None)[0].hexdigest()


class Conversation:
    """Counts and repair of one conversation, turn by turn."""

    def __init__(self) -> None:
        self.faults, self.illegal, self.last = [0, 0, 0, 0], 0, None
        self.least = self.most = None
        self.turns = 0
        self.repair = Repair()

    def add(self, turn: int | None, role: str, text: str, fault: int) -> None:
        self.faults[fault] += 1
        self.illegal += self.last is not None and self.last + role[:1] not in LEGAL
        self.last = role[:1]
        if turn is not None and turn != self.most:
            self.turns += 1
            self.least, self.most = (turn if self.least is None else self.least), turn
        self.repair.turn(role, text, fault)

    def row(self) -> tuple:
        gaps = self.most - self.least + 1 - self.turns if self.turns else 0
        return (gaps, *self.faults[1:], self.illegal, *self.repair.result())


FIELDS = (("gaps", "bigint"), ("blank", "bigint"), ("duplicate", "bigint"), ("truncated", "bigint"), ("illegal", "bigint"), ("cost", "bigint"), ("audit", "string"), ("repaired_sha256", "string"))


def repair(rows: DataFrame) -> DataFrame:
    """One row for each conv_id of rows (conv_id, turn, role, text; with `gone` true, a row only names its conversation): counts of gaps, faults and illegal
    neighbours, then cost, audit and the hash of the repaired `role:text` lines."""
    if "gone" not in rows.columns:
        rows = rows.withColumn("gone", F.lit(False))
    id_type = rows.schema["conv_id"].dataType.simpleString()
    space = lambda c: F.coalesce(F.col(c), F.lit(" ")).alias(c)
    rows = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), space("role"), space("text"), "gone").repartition("conv_id")
    # partitions by conv_id serve the window too
    again = W.partitionBy("conv_id", "role", "text", "gone").orderBy(F.asc_nulls_first("turn"))
    rows = rows.withColumn("seen", F.row_number().over(again) > 1).withColumn("fault", fault(F.col("text"), F.col("seen")).cast("int"))
    rows = rows.sortWithinPartitions("conv_id", "gone", F.asc_nulls_first("turn"), "role", "text", "seen").select("conv_id", "gone", "turn", "role", "text", "fault")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, now, first = None, Conversation(), True
        out: list[tuple] = []

        def packed() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True))
            arrays = [pa.array(columns[0], schema_id)] + [pa.array(c, pa.int64() if kind == "bigint" else pa.string()) for c, (_, kind) in zip(columns[1:], FIELDS, strict=True)]
            return pa.RecordBatch.from_arrays(arrays, ["conv_id", *(n for n, _ in FIELDS)])

        for batch in batches:
            schema_id = batch.schema.field(0).type
            for conv, gone, turn, role, text, kind in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if first or conv != at:
                    if not first:
                        out.append((at, *now.row()))
                    at, now, first = conv, Conversation(), False
                if not gone:
                    now.add(turn, role, text, kind)
            if len(out) > 1000:
                yield packed()
                out = []
        if not first:
            out.append((at, *now.row()))
            yield packed()

    return rows.mapInArrow(run, f"conv_id {id_type}, " + ", ".join(f"{n} {t}" for n, t in FIELDS))


def follows_grammar(initials: str) -> bool:
    return re.fullmatch("(s?(ua)+)?", initials) is not None
