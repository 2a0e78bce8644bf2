"""Chat formatting in budgeted windows.

A window is a turn-aligned span of a conversation whose tokens, by prefix sums over
the turns, fit the budget. It begins with the conversation's system turn, then
repeats earlier turns as far as ``history`` tokens reach, then brings new turns. Every
turn is new in exactly one window. The loss mask covers the texts of new assistant
turns; what is repeated is masked. A turn larger than what is left of the budget
stands alone with the system turn, without history; turns are never cut.

Template: ``<s>[INST]role[/INST]text</s>`` for each turn. In roles and texts a
backslash goes before every backslash and before every control string, which
``unescape`` undoes exactly.

Turns are numbered by their order first, whatever their turn numbers are: rows are dealt in
ranges of (conversation, turn), counted in each, and what lies before in earlier ranges is added, so
that a conversation of any length is numbered by many tasks. Then they are dealt by
conversation and stretch of ``STRETCH`` places (or four times the history, if that is more) and
sorted; a window does not reach over the end of a stretch. A stretch after the first
begins with what it needs of those before it: the system turn, and as history the last turns, as many as
the history may have tokens. So windows depend on the order of turns and
their tokens alone, a long conversation is shared by many tasks, and
a task keeps the open window and its history only. ``read_back`` hashes a
conversation's turns in their order, which one task has to do, in bounded memory.

The budget counts the words and marks of a turn; ``tokens`` may name a column with the
counts of a tokenizer instead.

Edge cases: of turns with 0 tokens (by a column) as many are repeated as the history may have tokens; null texts and roles are empty; a null conv_id is a conversation of its
own; null turns come first; rows of equal turn go by role, then text, and all
stay; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import maybe_in, runs, stored

OPEN, ROLE, TEXT, CLOSE = "<s>", "[INST]", "[/INST]", "</s>"
CONTROL = "|".join(map(re.escape, (OPEN, CLOSE, ROLE, TEXT)))
HIDE = re.compile(rf"\\|(?={CONTROL})")
SHOW = re.compile(rf"\\(\\|(?={CONTROL}))")
MARK = re.compile(rf"\\\\|\\(?={CONTROL})(?:{CONTROL})|{CONTROL}")
TOKEN = r"(?U)\w+|[^\w\s]"
STRETCH = 1024
WINDOWS = "conv_id bigint, stretch bigint, window int, n_repeated int, n_turns int, n_tokens bigint, text string, loss array<struct<start: int, end: int>>"


def escape(text: str) -> str:
    return HIDE.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return SHOW.sub(r"\1", text)


def token_count(role: Column, text: Column) -> Column:
    """Tokens of a formatted turn; each of its four control strings is one."""
    return 4 + F.regexp_count(role, F.lit(TOKEN)) + F.regexp_count(text, F.lit(TOKEN))


def read_turns(text: str) -> list[tuple[str, str]]:
    """Role and text of each turn of a formatted window."""
    out: list[tuple[str, str]] = []
    begin, role = 0, ""
    for m in MARK.finditer(text):
        if m[0] == ROLE:
            begin = m.end()
        elif m[0] == TEXT:
            role, begin = text[begin : m.start()], m.end()
        elif m[0] == CLOSE:
            out.append((unescape(role), unescape(text[begin : m.start()])))
    return out


class Formatter:
    """Turns of one stretch of a conversation, in order, to windows."""

    def __init__(self, key: tuple[int | None, int], budget: int, history: int):
        self.key, self.budget, self.history = key, budget, history
        self.system: tuple[str, str, int] | None = None
        #: History and new turns, with prefix sums of their tokens; turns from `new` on are new.
        self.turns: list[tuple[str, str, int]] = []
        self.sums = [0]
        self.new = 0
        self.window = 0
        self.begun = False
        #: A system turn at the beginning, new in the first window and repeated in the later ones.
        self.lead: tuple[str, str, int] | None = None

    def carry(self, kind: int, turn: tuple[str, str, int]) -> None:
        """What earlier stretches bring: first their system turn (of an empty role if there is none), then history."""
        self.begun = True
        if kind == SYSTEM:
            self.system = self.lead = turn if turn[0] == "system" else None
        elif turn != self.lead:
            self.turns.append(turn)
            self.sums.append(self.sums[-1] + turn[2])
            self.new = len(self.turns)
            self.forget(bisect_left(self.sums, self.sums[-1] - self.history))

    def add(self, *turn: Any) -> Iterator[tuple]:
        role = turn[0]
        room = self.budget - (self.system[2] if self.system else 0)
        if len(self.turns) > self.new and self.sums[-1] + turn[2] - self.sums[0] > room:
            yield self.close()
        if len(self.turns) == self.new and self.sums[-1] + turn[2] - self.sums[0] > room:
            # Shorten the history until the new turn fits.
            drop = bisect_left(self.sums, self.sums[-1] + turn[2] - room)
            self.forget(min(drop, len(self.turns)))
        self.turns.append(turn)
        self.sums.append(self.sums[-1] + turn[2])
        if not self.begun and role == "system":
            self.lead = turn
        self.begun = True

    def forget(self, count: int) -> None:
        del self.turns[:count]
        del self.sums[:count]
        self.new -= count

    def close(self) -> tuple:
        """The open window; its last turns become the next one's history."""
        repeated = ([self.system] if self.system else []) + self.turns[: self.new]
        text, loss, total = [], [], 0
        at = 0
        for k, (role, content, size) in enumerate(repeated + self.turns[self.new :]):
            head, body = f"{OPEN}{ROLE}{escape(role)}{TEXT}", escape(content)
            if k >= len(repeated) and role == "assistant":
                loss.append((at + len(head), at + len(head) + len(body)))
            text.append(f"{head}{body}{CLOSE}")
            at += len(text[-1])
            total += size
        row = (*self.key, self.window, len(repeated), len(repeated) + len(self.turns) - self.new, total, "".join(text), loss)
        self.window += 1
        self.forget(bisect_left(self.sums, self.sums[-1] - self.history))
        self.system = self.lead
        if self.window == 1 and self.lead and self.turns and self.turns[0] is self.lead:
            self.forget(1)
        self.new = len(self.turns)
        return row


SYSTEM, HISTORY, OWN = 0, 1, 2


def numbered(rows: DataFrame) -> DataFrame:
    """Adds nth: a row's place in its conversation, from 0, by turn, role and text; rows has no_id and conv. The result is stored."""
    order = ["no_id", "conv", "turn", "role", "text"]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("range", F.spark_partition_id())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, n = None, 0
        for key, part in runs(batches, "no_id", "conv"):
            n = n if key == here else 0
            yield part.append_column("place", pa.array(np.arange(n, n + part.num_rows, dtype=np.int64)))
            here, n = key, n + part.num_rows

    schema = ", ".join(f"{c} {t}" for c, t in ranged.dtypes)
    # Stored, since the ranges must not change between the two times that they are read.
    placed = stored(ranged.mapInArrow(count, f"{schema}, place bigint"), "turns")
    conv = ["no_id", "conv"]
    before = Window.partitionBy(*conv).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ends = placed.groupBy(*conv, "range").agg((F.max("place") + 1).alias("n")).withColumn("before", F.sum("n").over(before))
    # Only a range's first conversation can have begun in an earlier one, so there are fewer rows than ranges.
    ends = ends.where("before IS NOT NULL").select(*conv, "range", "before")
    return placed.join(F.broadcast(ends), [*conv, "range"], "left").withColumn("nth", F.col("place") + F.coalesce("before", F.lit(0))).drop("range", "place", "before")


def carried(rows: DataFrame, stretch: int, reach: int) -> DataFrame:
    """Rows that stretches after a conversation's first get from earlier ones; rows has no_id, conv, nth, stretch, kind, role, text, tokens."""
    conv = ["no_id", "conv"]
    columns = [*conv, "stretch", "kind", "nth", "role", "text", "tokens"]
    long = rows.groupBy(*conv).agg(F.max("stretch").alias("last")).where(F.col("last") > 0).withColumn("key", F.xxhash64(*conv))
    # Most conversations have one stretch; only rows that may be of others are looked at.
    edge = rows.where((F.col("nth") == 0) | (F.pmod("nth", F.lit(stretch)) >= stretch - reach))
    near = maybe_in(edge, F.xxhash64(*conv), long, "key", "maybe").where("maybe").drop("maybe").join(long.drop("key"), conv)
    lead = near.where("nth = 0").withColumn("stretch", F.explode(F.sequence(F.lit(1).cast("bigint"), "last"))).withColumn("kind", F.lit(SYSTEM))
    lead = lead.withColumns({c: F.when(F.col("role") == "system", F.col(c)).otherwise(F.lit("")) for c in ("text", "role")})
    last = near.where(F.pmod("nth", F.lit(stretch)) >= stretch - reach).withColumns({"stretch": F.col("stretch") + 1, "kind": F.lit(HISTORY)}).where(F.col("stretch") <= F.col("last"))
    return lead.select(*columns).unionByName(last.select(*columns))


def format_windows(conversations: DataFrame, budget: int = 512, history: int = 128, tokens: str | None = None) -> DataFrame:
    """One row for each window: the formatted text and the spans of the loss mask in it.

    window: counts the windows of a stretch of the conversation; n_repeated: turns at its beginning that an
    earlier window has brought. tokens: a column with the number of tokens of each turn.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.select(
        F.col("conv_id").isNull().cast("int").alias("no_id"), F.coalesce(F.col("conv_id").cast("bigint"), F.lit(0)).alias("conv"), F.col("turn").cast("bigint").alias("turn"),
        role.alias("role"), text.alias("text"), (token_count(role, text) if tokens is None else F.col(tokens)).cast("bigint").alias("tokens"),
    )
    stretch, reach = max(STRETCH, 4 * history), history
    rows = numbered(rows).drop("turn").withColumns({"stretch": F.floor(F.col("nth") / stretch), "kind": F.lit(OWN)})
    keys = ("no_id", "conv", "stretch")
    dealt = rows.unionByName(carried(rows, stretch, reach)).repartition(*keys).sortWithinPartitions(*keys, "kind", "nth")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))]
        names = [x.split()[0] for x in WINDOWS.split(", ")[:7]] + ["loss"]

        def pack(done: list[tuple]) -> pa.RecordBatch:
            columns = [*zip(*done, strict=True)]
            columns[7] = [[{"start": a, "end": b} for a, b in x] for x in columns[7]]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

        open_one: Formatter | None = None
        for b in batches:
            done: list[tuple] = []
            for no_id, conv, stretch, kind, *turn in zip(*(b.column(k).to_pylist() for k in (*keys, "kind", "role", "text", "tokens")), strict=True):
                key = (None if no_id else conv, stretch)
                if open_one is None or open_one.key != key:
                    if open_one is not None:
                        done.append(open_one.close())
                    open_one = Formatter(key, budget, history)
                if kind == OWN:
                    done += open_one.add(*turn)
                else:
                    open_one.carry(kind, tuple(turn))
            if done:
                yield pack(done)
        if open_one is not None:
            yield pack([open_one.close()])

    return dealt.mapInArrow(run, WINDOWS)


def read_back(windows: DataFrame) -> DataFrame:
    """Digests of each conversation's turns and loss text, read from formatted windows alone."""
    schema = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    dealt = windows.select("conv_id", "stretch", "window", "n_repeated", "text", "loss").repartition("conv_id").sortWithinPartitions("conv_id", "stretch", "window")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in schema.split(", ")]

        class Sum:
            def __init__(self, conv_id):
                self.conv_id, self.n, self.chars, self.loss_chars = conv_id, 0, 0, 0
                self.turns, self.loss = hashlib.sha256(), hashlib.sha256()

            def row(self):
                return self.conv_id, self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars

        one: Sum | None = None
        for b in batches:
            done = []
            for conv_id, repeated, text, loss in zip(*(b.column(k).to_pylist() for k in ("conv_id", "n_repeated", "text", "loss")), strict=True):
                if one is None or one.conv_id != conv_id:
                    if one is not None:
                        done.append(one.row())
                    one = Sum(conv_id)
                new = read_turns(text)[repeated:]
                one.n += len(new)
                one.chars += len(text)
                for role, content in new:
                    one.turns.update(f"{role}\n{content}\n".encode())
                for span in loss:
                    plain = unescape(text[span["start"] : span["end"]])
                    one.loss_chars += len(plain)
                    one.loss.update(plain.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c) if k else pa.array(c, pa.int64()) for k, c in enumerate(zip(*done, strict=True))], names)
        if one is not None:
            yield pa.RecordBatch.from_arrays([pa.array([c]) if k else pa.array([c], pa.int64()) for k, c in enumerate(one.row())], names)

    return dealt.mapInArrow(run, schema)
