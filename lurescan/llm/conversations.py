"""Repair of conversations' role structure by a suffix-shared automaton (operator 11).

A row of a conversation has the first fault that fits: *blank* (only blanks and 0x09-0x0D), *duplicate* (an
earlier row has its role and text), *truncated* (the last other character is not one of ``.!?``). A conversation
is in order if its roles' initials read ``(s?(ua)+)?``. Edits: Keep 0, Rerole to user or assistant 2, Delete 3 (the
only edit of blank and duplicate rows), Insert an empty user or assistant row 2; a truncated row that stays costs 1.

1. Rows are reduced to order key, initial and fault, without their texts, and sorted by conversation. A task
   streams over its sorted rows and writes one *signature* per conversation, one letter per row.
2. Equal signatures are counted and repaired once, however many conversations have them. Read from the end, the
   distinct signatures form an automaton whose nodes are their distinct suffixes: sorted by their reversed letters,
   each shares the longest suffix possible with the one before it, so every node is built once, and a task holds
   only the nodes of one signature. A node has, for each of four grammar states, the cost-to-go and the first
   edits of the ASCII-least cheapest audit, which the next node continues. These depend on the letter and the
   next node's cost differences alone, so they are minimised further: built once per letter and set of differences.
3. The audit joins its conversations, heavy signatures by broadcast (their number and length are bounded), and is
   sent ahead of the conversation's rows, which are streamed once more to hash the repaired text.

So a task's memory is bounded by one signature, not by a conversation's texts. A conversation's hash reads its rows
in order, which is one task's work by nature, however long the conversation is.

Rows are ordered by turn, nulls first, then by role and by the SHA-256 of the text; rows that tie in all of these
are identical. Null roles and texts are one space. Null ids are one conversation. A conversation whose rows are all
gone has zeros, an empty audit and the empty string's hash. An empty table gives no rows; extra columns of any name
are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.storage import stable

KEEP, REROLE, DELETE, INSERT, CUT = 0, 2, 3, 2, 1
#: signatures repaired by broadcast: so many, of so many rows at most
HOT_SIGNATURES, HOT_ROWS = 1_000, 1_000
_BLANKS = r"\x20\x09-\x0D"
#: grammar states: nothing yet, after s, after u, after a; where s, u and a lead, and where reading may end
_NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
_ENDS = (0, 3)
_ROLES = {"u": "user", "a": "assistant"}
_FACTS = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint"


# --- rows --------------------------------------------------------------------------------------


def damaged(table: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv, turn, role, text, gone``: the damage that crc32 of ``conv:turn`` modulo 20 names.

    0 drops a row (kept here with ``gone``, so that its conversation stays known), 1 empties its text, 2 takes out
    ``.!?``, 3 repeats it, 4 makes it a user's.
    """
    space = F.lit(" ")
    name = F.concat_ws(":", *[F.coalesce(F.col(f"`{c}`").cast("string"), space) for c in (conv_id, turn)])
    kind = F.crc32(name.cast("binary")) % 20
    rows = table.select(
        F.col(f"`{conv_id}`").alias("conv"),
        F.col(f"`{turn}`").cast("bigint").alias("turn"),
        F.coalesce(F.col(f"`{role}`"), space).alias("role"),
        F.coalesce(F.col(f"`{text}`"), space).alias("text"),
        kind.alias("kind"),
    )
    changed = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    role_ = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    return rows.select("conv", "turn", role_.alias("role"), changed.alias("text"), (F.col("kind") == 0).alias("gone"), F.explode(copies).alias("_")).drop("_")


def _key(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def row_facts(rows: DataFrame) -> DataFrame:
    """``conv, turn, letter, initial``: what the repair needs of a row; sorted by conversation within tasks.

    Letters: initial of a sound row, its capital if truncated, ``x`` (blank) and ``y`` (duplicate) if it must go,
    ``o`` and ``O`` for other initials, ``-`` for a row that is gone.
    """
    blank = ~F.col("text").rlike(f"[^{_BLANKS}]")
    cut = ~F.col("text").rlike(f"[.!?][{_BLANKS}]*\\z")
    initial = F.substring("role", 1, 1)
    own = F.when(initial.isin("s", "u", "a"), initial).otherwise(F.lit("o"))
    slim = rows.select("conv", "turn", "role", _key(F.col("text")).alias("key"), "gone", blank.alias("blank"), F.when(cut, F.upper(own)).otherwise(own).alias("own"))
    # the rows of a conversation meet once; both sorts below take place inside that partitioning
    slim = slim.repartition("conv")
    seen = F.row_number().over(Window.partitionBy("conv", "role", "key", "gone").orderBy(F.asc_nulls_first("turn")))
    slim = slim.withColumn("nth", seen)
    letter = F.when(F.col("gone"), "-").when(F.col("blank"), "x").when(F.col("nth") > 1, "y").otherwise(F.col("own"))
    slim = slim.sortWithinPartitions(F.asc_nulls_first("conv"), F.asc_nulls_first("turn"), "role", "key", "nth")
    return slim.select("conv", "turn", letter.alias("letter"), F.substring("role", 1, 1).alias("initial"))


def signatures(rows: DataFrame) -> DataFrame:
    """One row per conversation: ``conv``, facts of its rows and its signature."""
    facts = row_facts(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        conv, at = None, None
        for batch in batches:
            for c, turn, letter, initial in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if at is None or c != conv:
                    if at is not None:
                        out.append(at.row(conv))
                    conv, at = c, _Facts()
                at.add(turn, letter, initial)
            if len(out) >= 1_000:
                yield batch_of(out)
                out = []
        if at is not None:
            out.append(at.row(conv))
        if out:
            yield batch_of(out)

    made = T.StructType([T.StructField("conv", rows.schema["conv"].dataType), *T._parse_datatype_string(_FACTS).fields, T.StructField("signature", T.StringType())])
    batch_of = _batch_maker(made)
    return facts.mapInArrow(run, made)


def _batch_maker(schema: T.StructType):
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)
    return lambda rows: pa.RecordBatch.from_arrays([pa.array(column, f.type) for column, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)


class _Facts:
    """What is counted while a conversation's rows pass."""

    LEGAL = ("su", "ua", "au")

    def __init__(self):
        self.letters, self.last, self.illegal = [], None, 0
        self.low = self.high = self.turn = None
        self.turns = 0

    def add(self, turn, letter: str, initial: str) -> None:
        if letter == "-":
            return
        self.illegal += self.last is not None and self.last + initial not in self.LEGAL
        self.last = initial
        self.letters.append(letter)
        if turn is not None:
            self.turns += turn != self.turn
            self.low = turn if self.low is None else self.low
            self.high = self.turn = turn

    def row(self, conv) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        signature = "".join(self.letters)
        return conv, gaps, signature.count("x"), signature.count("y"), sum(map(str.isupper, signature)), self.illegal, signature


# --- the automaton -------------------------------------------------------------------------------


@cache
def _node(letter: str, after: tuple[int, int, int, int]) -> tuple[tuple[int, ...], tuple[tuple[str, int], ...]]:
    """Of a node that reads ``letter`` before a node with costs ``after``: per grammar state the cost-to-go, and the
    edits up to and including the letter's with the state that they lead to; equal costs go to the ASCII-least.

    A state and an edit's initial leave one next state, so the first differing edit decides between audits, and an
    edit that is ASCII-less here never needs the rest to be compared.
    """
    forced, cut, own = letter in "xy", letter.isupper() * CUT, letter.lower()
    costs, edits = [], []
    for state in range(4):
        found, pre, spent, at = [], "", 0, state
        for _ in range(4):
            found.append((spent + DELETE + after[at], pre + "D", at))
            if not forced:
                if (at, own) in _NEXT:
                    found.append((spent + KEEP + cut + after[_NEXT[at, own]], pre + "K", _NEXT[at, own]))
                role = "a" if at == 2 else "u"
                found.append((spent + REROLE + cut + after[_NEXT[at, role]], pre + "R", _NEXT[at, role]))
            pre, spent, at = pre + "I", spent + INSERT, _NEXT[at, "a" if at == 2 else "u"]
        cost, steps, to = min(found)
        costs.append(cost)
        edits.append((steps, to))
    return tuple(costs), tuple(edits)


#: the node after the last row: what must still be inserted
END = (0, 2 * INSERT, INSERT, 0)
_END_EDITS = ("", "II", "I", "")


class SharedSuffixes:
    """Nodes of the signatures read so far that the next one may share; feed them sorted by reversed letters."""

    def __init__(self):
        self.letters: list[str] = []  # from the end
        self.costs: list[tuple] = [END]
        self.base: list[int] = [0]  # costs are kept as differences to this
        self.edits: list[tuple] = []
        self.built = 0

    def repair(self, signature: str) -> tuple[int, str]:
        """(least cost, ASCII-least cheapest audit)"""
        reverse = signature[::-1]
        shared = 0
        for a, b in zip(self.letters, reverse):  # noqa: B905 - the shorter one decides
            if a != b:
                break
            shared += 1
        del self.letters[shared:], self.costs[shared + 1 :], self.base[shared + 1 :], self.edits[shared:]
        for letter in reverse[shared:]:
            costs, edits = _node(letter, self.costs[-1])
            least = min(costs)
            self.letters.append(letter)
            self.costs.append(tuple(c - least for c in costs))
            self.base.append(self.base[-1] + least)
            self.edits.append(edits)
            self.built += 1
        state, audit = 0, []
        for edits in reversed(self.edits):
            steps, state = edits[state]
            audit.append(steps)
        audit.append(_END_EDITS[state])
        return self.base[-1] + self.costs[-1][0], "".join(audit)


def audits(signed: DataFrame) -> DataFrame:
    """``signature, heavy, cost, audit``: each distinct signature once."""
    distinct = signed.groupBy("signature").agg(F.count(F.lit(1)).alias("heavy"))
    back = F.reverse("signature")
    spread = distinct.withColumn("back", back).repartitionByRange("back").sortWithinPartitions("back").select("signature", "heavy")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes = SharedSuffixes()
        for batch in batches:
            texts = batch.column(0).to_pylist()
            found = [nodes.repair(t) for t in texts]
            yield pa.RecordBatch.from_pydict(
                {"signature": pa.array(texts, pa.string()), "heavy": batch.column(1), "cost": pa.array([c for c, _ in found], pa.int64()), "audit": pa.array([a for _, a in found], pa.string())}
            )

    return spread.mapInArrow(run, "signature string, heavy bigint, cost bigint, audit string")


def with_audits(signed: DataFrame) -> DataFrame:
    """The conversations with ``cost`` and ``audit``; signatures that many conversations share are broadcast."""
    found = audits(signed)
    hot = found.where(F.length("signature") <= HOT_ROWS).orderBy(F.desc("heavy"), "signature").limit(HOT_SIGNATURES)
    hot = hot.select(F.col("signature").alias("hot_signature"), F.struct("cost", "audit").alias("hot"))
    rest = found.select(F.col("signature").alias("rest_signature"), F.struct("cost", "audit").alias("rest"))
    out = signed.join(F.broadcast(hot), F.col("signature") == F.col("hot_signature"), "left")
    near, far = out.where("hot IS NOT NULL"), out.where("hot IS NULL")
    near = near.select(*signed.columns, "hot.cost", "hot.audit")
    far = far.join(rest, F.col("signature") == F.col("rest_signature")).select(*signed.columns, "rest.cost", "rest.audit")
    return near.unionByName(far)


# --- the repaired text ---------------------------------------------------------------------------


class Repair:
    """Applies an audit while rows pass, and hashes what comes out."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state, self.first, self.digest = audit, 0, 0, True, hashlib.sha256()

    def _write(self, role: str, text: str) -> None:
        self.digest.update(f"{role}:{text}".encode() if self.first else f"\n{role}:{text}".encode())
        self.first = False

    def _insert(self) -> None:
        while self.audit[self.at : self.at + 1] == "I":
            role = "a" if self.state == 2 else "u"
            self._write(_ROLES[role], "")
            self.state, self.at = _NEXT[self.state, role], self.at + 1

    def row(self, role: str, text: str) -> None:
        self._insert()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self._write(role, text)
            self.state = _NEXT[self.state, role[0]]
        elif edit == "R":
            new = "a" if self.state == 2 else "u"
            self._write(_ROLES[new], text)
            self.state = _NEXT[self.state, new]

    def close(self) -> str:
        self._insert()
        return self.digest.hexdigest()


def repair(table: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Per conversation: ``conv_id``, facts of the damaged rows, ``cost``, ``audit`` and ``repaired_sha256``."""
    rows = damaged(table, conv_id, turn, role, text)
    signed = stable(signatures(rows), "signatures")  # several jobs read it
    facts = T._parse_datatype_string(f"{_FACTS}, cost bigint, audit string")
    head = with_audits(signed).select("conv", F.struct(*facts.fieldNames()).alias("head"), *[F.lit(None).cast(t).alias(c) for c, t in (("turn", "bigint"), ("role", "string"), ("text", "string"))])
    body = rows.where("NOT gone").select("conv", F.lit(None).cast(facts).alias("head"), "turn", "role", "text")
    both = head.unionByName(body).withColumn("key", _key(F.col("text"))).repartition("conv")
    both = both.sortWithinPartitions(F.asc_nulls_first("conv"), F.col("head").isNull(), F.asc_nulls_first("turn"), "role", "key").drop("turn", "key")
    made = T.StructType([T.StructField(conv_id, rows.schema["conv"].dataType), *facts.fields, T.StructField("repaired_sha256", T.StringType())])
    batch_of = _batch_maker(made)
    names = facts.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        conv, top, now = None, None, None
        for batch in batches:
            for c, head_, role_, text_ in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if head_ is not None:
                    if now is not None:
                        out.append((conv, *(top[n] for n in names), now.close()))
                    conv, top, now = c, head_, Repair(head_["audit"])
                else:
                    now.row(role_, text_)
            if len(out) >= 1_000:
                yield batch_of(out)
                out = []
        if now is not None:
            out.append((conv, *(top[n] for n in names), now.close()))
        if out:
            yield batch_of(out)

    return both.mapInArrow(run, made)
