"""Conversation structure repair over a suffix-shared automaton.

A conversation becomes a signature, one letter per row: the class of its role and its
fault. ``audits`` reads all distinct signatures from their ends: equal suffixes are one
node of the automaton, shared by every conversation that ends so. Sorted by their
reversed text, signatures that share a suffix follow each other, so a task keeps the
nodes of the current signature on a stack and computes only what is new. A node holds,
for each state of the grammar ``(s?(ua)+)?``, the cost to go and the first edit of the
best audit suffix; the rest of the suffix is found by walking down the stack.

Edits: Keep 0, Rerole to user or assistant 3, Delete 4 (the only one for blank and
repeated rows), Insert an empty user or assistant row 3; a truncated row that is not
deleted adds 3. In a grammar state each edit letter leads to one next state, so the
cheapest audit, ties to the least text, is decided letter by letter.

``plan`` gives costs and audits, ``repaired`` the repaired rows, ``digests`` a hash of
each repaired conversation.

Rows are ordered by turn (nulls first), then role, then a digest of role and text;
equal rows are interchangeable. The order is found by a range shuffle of narrow rows, so
a conversation of any length is many pieces, and repeats are found by an aggregate on the
row digests. What must be one per conversation is: its signature and audit, a byte
for each row; a task's stack, 36 bytes for each row of the longest one; and the hash, whose
definition is sequential: the rows stream through it in order and are not held.

Defined cases: a null role or text counts as one space. A null id is a conversation of
its own. Null turns come first and leave no gap; more gaps than a long
holds are its highest value. Texts are read whole. Conversations
without rows have an empty audit, no cost and no repaired rows. Repeated rows in the
input are duplicates. Columns other than the four are not read. An empty table gives
an empty result.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corridor.llm.common import BLANKS
from corridor.operators.frames import join_unique
from corridor.scratch import stored

KEEP, REROLE, DELETE, INSERT, UNFINISHED = 0, 3, 4, 3, 3
#: Grammar states: nothing yet, after the system row, user row seen, pair complete. What each expects and becomes.
WANTED = ("u", "u", "a", "u")
AFTER = (2, 2, 3, 2)
NAMES = {"u": "user", "a": "assistant"}
LETTERS = "DIKR"
#: Signature letters by role class: sound, truncated, to be deleted.
SOUND, CUT, GONE, ROLES = "suao", "SUAO", "1234", "suao"
END = 255
FAR = 1 << 60
ORDER = ["turn", "role", "mark"]


def conversation_key(column: str) -> Column:
    """The id as text that is never null."""
    return F.coalesce(F.concat(F.lit("="), F.col(column).cast("string")), F.lit(""))


def damage(rows: DataFrame) -> DataFrame:
    """Damage rows by ``crc32(conv_id:turn) % 20``, nulls read as one space: 0 drops a row, 1 empties its text,
    2 removes its ``[.!?]``, 3 repeats it, 4 makes it a user row."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.pmod(F.crc32(F.concat_ws(":", spaced("conv_id"), spaced("turn")).cast("binary")), F.lit(20))
    marked = rows.select("conv_id", "turn", spaced("role").alias("role"), spaced("text").alias("text"), kind.alias("_kind")).where("_kind <> 0")
    text = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("_kind") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.array_repeat(F.lit(0), F.when(F.col("_kind") == 3, 2).otherwise(1)))
    return marked.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("_copy")).drop("_copy")


def _marked(rows: DataFrame) -> DataFrame:
    """Rows with their conversation key and a digest of role and text."""
    clean = rows.select(
        conversation_key("conv_id").alias("conv"), "turn",
        *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")],
    )
    return clean.withColumn("mark", F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary"))))


def signatures(rows: DataFrame) -> DataFrame:
    """``(conv, signature, blank, duplicate, truncated)``: a letter per row in order, and how many rows have each fault first."""
    bare = F.rtrim("text", F.lit(BLANKS))
    initial = F.substring("role", 1, 1)
    flagged = _marked(rows).select(
        "conv", *ORDER, (bare == "").alias("is_blank"), (~F.right(bare, F.lit(1)).isin(".", "!", "?")).alias("is_cut"),
        F.when(initial.isin("s", "u", "a"), initial).otherwise("o").alias("class"),
    )
    key = ["conv", *ORDER]
    ranged = flagged.repartitionByRange(*key).sortWithinPartitions(*key)
    ordered = stored(
        ranged.select("conv", "mark", "is_blank", "is_cut", "class", F.monotonically_increasing_id().alias("at")), "repair-rows"
    )
    again = ordered.where(~F.col("is_blank")).groupBy("conv", "mark").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("_n"))
    again = stored(again.where("_n > 1"), "repair-repeats")
    seen = join_unique(ordered, again.drop("_n"), ["conv", "mark"], "left", again.select("conv", "mark", "_n"))
    repeat = ~F.col("is_blank") & F.coalesce(F.col("at") > F.col("first"), F.lit(False))
    sound = ~F.col("is_blank") & ~repeat
    letter = (
        F.when(~sound, F.translate("class", ROLES, GONE)).when(F.col("is_cut"), F.translate("class", ROLES, CUT)).otherwise(F.col("class"))
    )
    lettered = seen.select(
        "conv", F.shiftright("at", 33).alias("piece"), "at", letter.alias("letter"), F.col("is_blank").cast("long").alias("blank"),
        repeat.cast("long").alias("duplicate"), (sound & F.col("is_cut")).cast("long").alias("truncated"),
    )

    def joined(at: str, text: str) -> Column:
        return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(at, text))), lambda x: x[text]), "").alias(text)

    faults = [F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")]
    pieces = lettered.groupBy("conv", "piece").agg(joined("at", "letter"), *faults)
    return pieces.groupBy("conv").agg(joined("piece", "letter"), *faults).withColumnRenamed("letter", "signature")


def _moves(letter: str, state: int) -> list[tuple[int, int, int]]:
    """``(cost, edit, next state)`` of the edits that use up a row."""
    moves = [(DELETE, 0, state)]
    if letter != "x":
        extra = UNFINISHED if letter in CUT else 0
        role = letter.lower()
        if role == WANTED[state]:
            moves.append((KEEP + extra, 2, AFTER[state]))
        elif role == "s" and state == 0:
            moves.append((KEEP + extra, 2, 1))
        moves.append((REROLE + extra, 3, AFTER[state]))
    return moves


class Automaton:
    """The nodes of one signature's suffixes, shortest first; shared suffixes are kept from signature to signature."""

    moves = {letter: [_moves(letter, state) for state in range(4)] for letter in SOUND + CUT + "x"}

    def __init__(self) -> None:
        self.letters, self.costs, self.edits = bytearray(), array("q"), bytearray()
        self.computed = 0
        self._push([(0, END), (FAR, END), (FAR, END), (0, END)])

    def _push(self, best: list[tuple[int, int]]) -> None:
        """Add a node; ``best`` has cost and edit (4 * letter + next state) of every grammar state before insertions."""
        insert = 4 * LETTERS.index("I")
        two = min(best[2], (INSERT + best[3][0], insert + 3))
        three = min(best[3], (INSERT + best[2][0], insert + 2))
        first = [min(b, (INSERT + two[0], insert + 2)) for b in best[:2]]
        for cost, edit in (*first, two, three):
            self.costs.append(cost)
            self.edits.append(edit)
        self.computed += 1

    def turn_to(self, backward: bytes) -> None:
        """Make ``backward`` (a signature from its end) the current path, computing the nodes it does not share."""
        shared, most = 0, min(len(backward), len(self.letters))
        while shared < most and backward[shared] == self.letters[shared]:
            shared += 1
        del self.letters[shared:]
        del self.costs[4 * shared + 4 :]
        del self.edits[4 * shared + 4 :]
        for at in range(shared, len(backward)):
            ahead, table = self.costs[4 * at : 4 * at + 4], self.moves[chr(backward[at])]
            self._push([min((cost + ahead[to], 4 * edit + to) for cost, edit, to in moves) for moves in table])
        self.letters += backward[shared:]

    def answer(self) -> tuple[int, str]:
        """Cost and audit of the current signature."""
        node, state, out = len(self.letters), 0, bytearray()
        while (edit := self.edits[4 * node + state]) != END:
            out.append(ord(LETTERS[edit >> 2]))
            state = edit & 3
            node -= edit >> 2 != 1
        return self.costs[4 * len(self.letters)], out.decode()


def audits(paths: DataFrame) -> DataFrame:
    """``(path, cost, audit)`` of the distinct signatures in ``path``."""

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automaton = Automaton()
        for frame in frames:
            found = []
            for path in frame["path"]:
                automaton.turn_to(path[::-1].encode())
                found.append((path, *automaton.answer()))
            yield pd.DataFrame(found, columns=["path", "cost", "audit"])

    backward = F.reverse("path")
    return paths.select("path").repartitionByRange(backward).sortWithinPartitions(backward).mapInPandas(each, "path string, cost bigint, audit string")


def plan(rows: DataFrame) -> DataFrame:
    """``(conv, gaps, blank, duplicate, truncated, illegal, cost, audit)`` of every conversation with rows, stored."""
    signed = stored(signatures(rows).withColumn("path", F.translate("signature", GONE, "xxxx")), "repair-signatures")
    paths = stored(signed.groupBy("path").agg(F.count(F.lit(1)).alias("_n")), "repair-paths")
    answered = stored(audits(paths), "repair-audits")
    found = join_unique(signed, answered, ["path"], "inner", paths)
    roles = F.translate("signature", CUT + GONE, ROLES + ROLES)
    legal = F.regexp_count(roles, F.lit("(?=su|ua|au).")).cast("long")
    span = F.max("turn").cast("decimal(20,0)") - F.min("turn").cast("decimal(20,0)") + 1 - F.countDistinct("turn")
    span = F.least(span, F.lit(2**63 - 1).cast("decimal(20,0)")).cast("long")
    gaps = rows.groupBy(conversation_key("conv_id").alias("conv")).agg(
        F.when(F.count("turn") == 0, F.lit(0).cast("long")).otherwise(span).alias("gaps")
    )
    planned = found.join(gaps, "conv").select(
        "conv", "gaps", "blank", "duplicate", "truncated", (F.length("signature").cast("long") - 1 - legal).alias("illegal"), "cost", "audit"
    )
    return stored(planned, "repair-plan")


def repaired(rows: DataFrame, planned: DataFrame) -> DataFrame:
    """``(conv, position, role, text)``: the rows of every repaired conversation, whole and in order within a partition.

    The audit travels in front of the rows of its conversation, once, and is used up as they stream by.
    """
    body = _marked(rows).select("conv", F.lit(1).alias("part"), *ORDER, "text")
    kind = rows.schema["turn"].dataType.simpleString()
    head = planned.select(
        "conv", F.lit(0).alias("part"), F.lit(None).cast(kind).alias("turn"), F.lit("").alias("role"), F.lit(None).cast("binary").alias("mark"),
        F.col("audit").alias("text"),
    )
    key = ["conv", "part", *ORDER]
    stream = head.unionByName(body).repartition("conv").sortWithinPartitions(*key).select("conv", "part", "role", "text")

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        conv, audit, at, state, position = None, "", 0, 0, 0
        out: list[tuple] = []

        def emit(role: str, text: str, to: int) -> None:
            nonlocal state, position
            out.append((conv, position, role, text))
            state, position = to, position + 1

        def insertions() -> None:
            nonlocal at
            while at < len(audit) and audit[at] == "I":
                emit(NAMES[WANTED[state]], "", AFTER[state])
                at += 1

        for frame in frames:
            for key, part, role, text in zip(frame["conv"], frame["part"], frame["role"], frame["text"]):
                if part == 0:
                    insertions()
                    conv, audit, at, state, position = key, text, 0, 0, 0
                    continue
                insertions()
                edit, at = audit[at], at + 1
                if edit == "K":
                    emit(role, text, AFTER[state] if role[:1] == WANTED[state] else 1)
                elif edit == "R":
                    emit(NAMES[WANTED[state]], text, AFTER[state])
            yield pd.DataFrame(out, columns=["conv", "position", "role", "text"])
            out.clear()
        insertions()
        yield pd.DataFrame(out, columns=["conv", "position", "role", "text"])

    return stream.mapInPandas(each, "conv string, position bigint, role string, text string")


def digests(turns: DataFrame) -> DataFrame:
    """``(conv, sha256)`` of the ``role:text`` lines of ``repaired``, newline-joined; no row for an empty conversation."""

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        conv, running = None, None
        for frame in frames:
            done = []
            for key, role, text in zip(frame["conv"], frame["role"], frame["text"]):
                if key != conv:
                    if running is not None:
                        done.append((conv, running.hexdigest()))
                    conv, running = key, hashlib.sha256()
                else:
                    running.update(b"\n")
                running.update(f"{role}:{text}".encode("utf-8", "surrogatepass"))
            yield pd.DataFrame(done, columns=["conv", "sha256"], dtype="object")
        if running is not None:
            yield pd.DataFrame([(conv, running.hexdigest())], columns=["conv", "sha256"])

    return turns.mapInPandas(each, "conv string, sha256 string")


def report(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The plan and the digest of every conversation in ``ids`` (column ``conv_id``), also of those without rows."""
    planned = plan(rows)
    hashed = digests(repaired(rows, planned))
    every = ids.select("conv_id").distinct().withColumn("conv", conversation_key("conv_id"))
    joined = every.join(planned, "conv", "left").join(hashed, "conv", "left").drop("conv")
    empty = hashlib.sha256().hexdigest()
    numbers = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return joined.select(
        "conv_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in numbers], F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("sha256", F.lit(empty)).alias("repaired_sha256"),
    )
