"""Conversation structure repair: the cheapest edits that make turns alternate.

Roles of a sound conversation read, by their initials, ``(s?(ua)+)?``. Edits are Delete (3),
Insert of an empty message (2), Keep (0) and Rerole to user or assistant (2); a message that
stays cut short costs 1. The weight of a path is one integer: its high digits are the cost, its
low digits of ``BITS`` bits each the audit letters by their place from the left, padded with
zeros at the end. So the least integer is the cheapest path with the ASCII-least audit, and an
ordinary shortest-path search over (rows read, last role) decides everything. (An audit fixes
its path and each further letter without a row costs 2, so that of two paths of equal cost to
one node neither's audit begins the other's.)

A conversation is read as a stream of its sorted rows: blocks of ``BLOCK`` rows become tables
(from role, to role) -> weight, remembered by the rows' roles and faults; after each block every
open path keeps its letters since all paths were one, its hash so far and nothing else. Memory
therefore does not grow with a conversation but for its audit. Its rows meet in one task since
SHA-256 is one chain over the whole text; its faults are found with its rows spread by text.

Cases: null role or text is one space; a null conv_id is a conversation of its own, null turns
come first; rows of one turn go by role, then text; repeated rows are duplicates; empty texts
are blank; very long texts pass through the hash; a conversation whose rows all went is sound
and empty; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mise.llm.common import partitions, ship

DELETE, INSERT, KEEP, REROLE = 1, 2, 3, 4       # digits in the ASCII order of their initials
LETTERS = " DIKR"
BITS = 3
BLOCK = 32
OK, BLANK, DUPLICATE, TRUNCATED = range(4)
START, SYSTEM, USER, ASSISTANT = range(4)       # the last role written
INITIALS = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
FOLLOWS = {(START, SYSTEM), (START, USER), (SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)}
SOUND = {"su", "ua", "au"}
SPACES = " \t\n\x0b\x0c\r"

RESULT = ("conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, "
          "audit string, repaired_sha256 string")
MESSAGES = "conv_id long, position long, role string, text string, edit string"


def messages(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, there): nulls of role and text as one space."""
    return conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"), F.lit(True).alias("there"))


def damaged(conversations: DataFrame) -> DataFrame:
    """``messages`` after the damage that their conversation and turn call for; a dropped row
    stays as one that is not ``there``."""
    rows = messages(conversations)
    named = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"),
                     F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    rows = rows.withColumn("kind", F.crc32(named.cast("binary")) % 20)
    copies = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    there = F.col("kind") != 0
    return rows.select(
        "conv_id", "turn",
        F.when(there, F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))).alias("role"),
        F.when(there, F.when(F.col("kind") == 1, "").when(
            F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))).alias("text"),
        there.alias("there"), F.explode(copies).alias("copy")).drop("copy")


def faults(rows: DataFrame) -> DataFrame:
    """The messages with their first fault and, among equal ones, their number ``again``."""
    same = Window.partitionBy("conv_id", "role", "text").orderBy(F.col("turn").asc_nulls_first())
    end = F.right(F.rtrim(F.col("text"), F.lit(SPACES)), F.lit(1))
    rows = rows.withColumn("again", F.row_number().over(same))
    return rows.withColumn("fault", F.when(end == "", BLANK).when(F.col("again") > 1, DUPLICATE).when(
        ~end.isin(".", "!", "?"), TRUNCATED).otherwise(OK))


def in_order(rows: DataFrame) -> DataFrame:
    """Each conversation's messages one after the other in one partition."""
    columns = ["conv_id", "turn", "role", "text", "there", "again", "fault"]
    return rows.select(*columns).repartition(partitions(rows.sparkSession), "conv_id").sortWithinPartitions(
        "conv_id", F.col("turn").asc_nulls_first(), "role", "text", "again")


def appended(weight: int, length: int, width: int, letter: int) -> int:
    return weight | letter << BITS * (width - 1 - length)


@lru_cache(maxsize=20_000)
def block_table(symbols: tuple) -> dict:
    """{(from, to): (cost, digits, letters)} of the best paths over rows of (role, fault).

    A message may be inserted before each row."""
    width = 2 * len(symbols)
    unit = 1 << BITS * width
    table = {}
    for begin in (START, SYSTEM, USER, ASSISTANT):
        best = {begin: (0, 0)}

        def step(nodes, out, frm, to, letter, cost):
            weight, length = nodes[frm]
            weight = appended(weight, length, width, letter) + cost * unit
            if to not in out or weight < out[to][0]:
                out[to] = weight, length + 1

        for role, fault in symbols:
            ready = dict(best)
            for frm, to in FOLLOWS:
                if frm in best and to != SYSTEM:
                    step(best, ready, frm, to, INSERT, 2)
            after = {}
            for q in ready:
                step(ready, after, q, q, DELETE, 3)
            if fault in (OK, TRUNCATED):
                for frm, to in FOLLOWS:
                    if frm in ready:
                        if to == role:
                            step(ready, after, frm, to, KEEP, int(fault == TRUNCATED))
                        if to != SYSTEM:
                            step(ready, after, frm, to, REROLE, 2 + (fault == TRUNCATED))
            best = after
        for to, (weight, length) in best.items():
            table[begin, to] = weight >> BITS * width, (weight & unit - 1) >> BITS * (width - length), length
    return table


#: Once the rows are over a message may follow: (from, to) -> (cost, digits, letters).
LAST = {(q, q): (0, 0, 0) for q in (START, SYSTEM, USER, ASSISTANT)} | {
    (frm, to): (2, INSERT, 1) for frm, to in FOLLOWS if to != SYSTEM}


def spell(digits: int, length: int) -> str:
    return "".join(LETTERS[digits >> BITS * k & 7] for k in range(length - 1, -1, -1))


def edited(letters: str, rows: list, state: int):
    """(role, text, letter, state) of the messages that edits leave of (role, text) rows."""
    at = 0
    for letter in letters:
        if letter == "I":
            role, text = "assistant" if state == USER else "user", ""
        else:
            role, text = rows[at]
            at += 1
            if letter == "D":
                continue
            if letter == "R":
                role = "assistant" if state == USER else "user"
        state = INITIALS[role[0]]
        yield role, text, letter, state


class Path:
    """An open path: cost, letters since all paths were one, and the hash of what it wrote."""

    __slots__ = ("cost", "digits", "length", "hash")

    def __init__(self, cost: int, digits: int, length: int, hash):
        self.cost, self.digits, self.length, self.hash = cost, digits, length, hash


class Conversation:
    """One conversation read message by message."""

    def __init__(self, conv_id):
        self.conv_id = conv_id
        self.open = {START: Path(0, 0, 0, hashlib.sha256())}
        self.sure: list[str] = []
        self.rows: list = []
        self.symbols: list = []
        self.seen = [0, 0, 0, 0]
        self.illegal = self.turns = 0
        self.first = self.last = self.role = None

    def add(self, turn, role: str, text: str, fault: int) -> None:
        self.seen[fault] += 1
        if turn is not None and turn != self.last:
            self.first = turn if self.first is None else self.first
            self.last = turn
            self.turns += 1
        if self.role is not None and self.role + role[:1] not in SOUND:
            self.illegal += 1
        self.role = role[:1]
        self.rows.append((role, text))
        self.symbols.append((INITIALS.get(role[:1], -1), fault))
        if len(self.rows) == BLOCK:
            self.advance(block_table(tuple(self.symbols)))

    def advance(self, table: dict) -> None:
        """All open paths over the rows held, by the least weight for each last role."""
        width = max(p.length for p in self.open.values()) + max(x[2] for x in table.values())
        after = {}
        for (frm, to), (cost, digits, length) in table.items():
            p = self.open.get(frm)
            if p is not None:
                total = p.length + length
                weight = p.cost + cost << BITS * width | (p.digits << BITS * length | digits) << BITS * (width - total)
                if to not in after or weight < after[to][0]:
                    after[to] = weight, total, frm, digits, length
        paths = {}
        for to, (weight, total, frm, digits, length) in after.items():
            hash, state = self.open[frm].hash.copy(), frm
            for role, text, _, now in edited(spell(digits, length), self.rows, frm):
                hash.update(f"{'' if state == START else chr(10)}{role}:{text}".encode())
                state = now
            whole = weight & (1 << BITS * width) - 1
            paths[to] = Path(weight >> BITS * width, whole >> BITS * (width - total), total, hash)
        self.open, self.rows, self.symbols = paths, [], []
        self.settle()

    def settle(self) -> None:
        """Letters on which all open paths agree are sure."""
        spelled = {q: spell(p.digits, p.length) for q, p in self.open.items()}
        least, most = min(spelled.values()), max(spelled.values())
        same = next((k for k, (x, y) in enumerate(zip(least, most)) if x != y), min(len(least), len(most)))
        if same:
            self.sure.append(least[:same])
            for p in self.open.values():
                p.length -= same
                p.digits &= (1 << BITS * p.length) - 1

    def result(self) -> tuple:
        if self.rows:
            self.advance(block_table(tuple(self.symbols)))
        self.advance(LAST)
        # what is open after the last row ends either empty or with an assistant
        width = max(p.length for p in self.open.values())
        p = min((self.open[q] for q in (START, ASSISTANT) if q in self.open),
                key=lambda p: p.cost << BITS * width | p.digits << BITS * (width - p.length))
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.turns
        return (self.conv_id, gaps, self.seen[BLANK], self.seen[DUPLICATE], self.seen[TRUNCATED], self.illegal, p.cost,
                "".join(self.sure) + spell(p.digits, p.length), p.hash.hexdigest())


def sorted_rows(batches):
    for batch in batches:
        for at in range(0, len(batch), 1024):
            yield from zip(*(c.to_pylist() for c in batch.slice(at, 1024).columns))


def results(batches):
    """Sorted rows of ``in_order`` -> one row per conversation."""
    now, done, size = None, [], 0

    def out():
        columns = list(zip(*done))
        types = [pa.int64()] * 7 + [pa.string()] * 2
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)],
                                          [c.split()[0] for c in RESULT.split(", ")])

    for conv_id, turn, role, text, there, _, fault in sorted_rows(batches):
        if now is None or now.conv_id != conv_id:
            if now is not None:
                done.append(now.result())
                size += 100 + len(done[-1][7])
            now = Conversation(conv_id)
            if size > 4 << 20:
                yield out()
                done, size = [], 0
        if there:
            now.add(turn, role, text, fault)
    if now is not None:
        done.append(now.result())
        yield out()


def repair(rows: DataFrame) -> DataFrame:
    """One row per conversation of ``messages``: its faults, the cheapest edits and the
    digest of what they leave."""
    ship(rows.sparkSession)
    return in_order(faults(rows)).mapInArrow(results, RESULT)


def write_out(batches):
    """Sorted rows, each conversation's audit before them -> the repaired messages."""
    now, position, state, out, size = (), 0, START, [], 0

    def table():
        columns = list(zip(*out))
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)],
                                          [c.split()[0] for c in MESSAGES.split(", ")])

    for conv_id, audit, role, text in sorted_rows(batches):
        if audit is not None:
            now, at, position, state = audit, 0, 0, START
            stretch, rows = inserts(now, at), []
        else:
            stretch, rows = now[at:at + 1], [(role, text)]
            at += 1
            stretch += inserts(now, at)
        at += len(stretch) - len(rows)
        for role, text, letter, state in edited(stretch, rows, state):
            out.append((conv_id, position, role, text, letter))
            position += 1
            size += len(text) + 64
        if size > 4 << 20:
            yield table()
            out, size = [], 0
    if out:
        yield table()


def inserts(audit: str, at: int) -> str:
    end = at
    while audit[end:end + 1] == "I":
        end += 1
    return audit[at:end]


def repaired(rows: DataFrame, found: DataFrame) -> DataFrame:
    """The messages that the edits of ``repair`` leave: (conv_id, position, role, text, edit)."""
    ship(rows.sparkSession)
    spark = rows.sparkSession
    texts = faults(rows).filter("there").select("conv_id", F.lit(None).cast("string").alias("audit"), "turn", "role", "text", "again")
    audits = found.select("conv_id", "audit", F.lit(None).cast("long").alias("turn"), F.lit(None).cast("string").alias("role"),
                          F.lit(None).cast("string").alias("text"), F.lit(0).alias("again"))
    both = texts.unionByName(audits).repartition(partitions(spark), "conv_id").sortWithinPartitions(
        "conv_id", F.col("audit").isNull(), F.col("turn").asc_nulls_first(), "role", "text", "again")
    return both.select("conv_id", "audit", "role", "text").mapInArrow(write_out, MESSAGES)
