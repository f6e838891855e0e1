"""Repair of conversation structure: the cheapest edits that leave a system turn, if any, and then user and assistant in turn.

Faults. A row is blank if it has no character but white space, else a duplicate if its role and text stood earlier in the
conversation, else truncated if its last character but white space isn't one of ``.!?``. Edits: keeping a row is free, another
role, deleting (which blank rows and duplicates must be), an empty turn put in and a truncated row that stays have their prices
(``Costs``; at those of the contract a deletion is always cheaper than putting something in). The initials of the roles that result are nothing or ``s?(ua)+``.

Method. Dynamic programming over the retained subsequence, in one pass: what a row costs when it is kept or gets another
role, after the best earlier retained row of each role. The rows between cost the difference of two prefix sums of deletions,
so each role's best is a running minimum of cost less prefix sum, and which turns have to be put in follows from the pair of roles
alone. Of equally cheap edits the audit (initials of the edits, in order; in a gap deletions come before insertions) that is
least by character wins. Audits are compared by rank: those of all roles end at the same row, so neither is the other's
beginning, and what a row adds decides only between equal ones. A byte for each row and role leads back to the audit, and
a hash object for each role holds the repaired text so far.

Scale. One shuffle by conversation; duplicates and turns are then found by sorting within partitions, which spills, and rows stream
through. A conversation is one task's, as its audit and hash are one value each, but in memory it is some 3 bytes a row.

Cases. Null roles and texts are taken as one space here, which makes a null text blank and a null role one that no pattern
keeps. Rows are ordered by turn, nulls first, ties by role and then text; repeated rows are duplicates. Rows with a null id are one
conversation. Texts of any length stream through whole. An empty table gives no rows; a conversation of which
no row is present gets zeros, an empty audit and the hash of nothing. Other columns aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window



@dataclass(frozen=True)
class Costs:
    """Prices of the edits, and of a truncated row that stays."""

    rerole: int = 1
    delete: int = 2
    insert: int = 5
    truncated: int = 5

    def __post_init__(self):
        if min(self.rerole, self.delete, self.insert) < 1 or self.truncated < 0:
            raise ValueError("edits must cost at least 1")


BLANK, REPEATED, CUT = 1, 2, 3
# Fixed values of the contract: white space, and the pairs of role initials that may follow each other.
_SPACE = r"\x20\x09-\x0D"
LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}
ROLES = {"u": "user", "a": "assistant"}
#: The states: nothing retained yet, or the initial of the role retained last.
STATES = ("", "s", "u", "a")
#: What has to be put in between two retained roles, and before the end.
BETWEEN = {
    "s": {"": ""},
    "u": {"": "", "s": "", "a": "", "u": "a"},
    "a": {"u": "", "": "u", "s": "u", "a": "u"},
}
LAST = {"": "", "a": "", "u": "a", "s": "ua"}
_FAR = 1 << 60

PLAN = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


class Repair:
    """One conversation: takes its rows in order, and gives counts, cost, audit and hash."""

    def __init__(self, costs: Costs = Costs()):
        self.costs = costs
        self.value = [0, _FAR, _FAR, _FAR]  # cost of the best that ends in a state, less the deletions before
        self.rank = [0, 0, 0, 0]  # order of the audits
        self.hashes = [None] * 4  # of the repaired text, None while it is empty
        self.steps = bytearray()  # for each row three bytes: how u, a and s were reached, 0 by deleting
        self.rows = self.deleted = 0  # deleted: the prefix sum of deletions
        self.counts = [0, 0, 0, 0]
        self.illegal = self.turns = 0
        self.before = self.least = self.most = None

    def add(self, turn: int | None, role: str, text: bytes, fault: int) -> None:
        initial = role[:1]
        self.illegal += self.rows > 0 and (self.before, initial) not in LEGAL
        self.before = initial
        if turn is not None and turn != self.most:  # in order
            self.least = turn if self.least is None else self.least
            self.most, self.turns = turn, self.turns + 1
        self.rows += 1
        self.counts[fault] += 1
        if fault in (BLANK, REPEATED):
            self.steps += b"\0\0\0"
            self.deleted += self.costs.delete
            return
        extra, offers = self.costs.truncated if fault == CUT else 0, [(self.value[q] + self.deleted + self.costs.delete, self.rank[q], "D", q) for q in range(4)]
        best = list(offers)
        for r, state in enumerate(STATES[1:], 1):
            if initial == state or state in ROLES:
                edit, price = ("K", 0) if initial == state else ("R", self.costs.rerole)
                for q, puts in BETWEEN[state].items():
                    q = STATES.index(q)
                    if self.value[q] < _FAR // 2:
                        best[r] = min(best[r], (self.value[q] + self.deleted + len(puts) * self.costs.insert + price + extra, self.rank[q], "I" * len(puts) + edit, q))
        hashes, steps = list(self.hashes), [0, 0, 0, 0]
        for r in (1, 2, 3):
            if best[r] is not offers[r]:
                _, _, audit, q = best[r]
                steps[r] = 1 + q * 4 + (audit[0] == "I") * 2 + (audit[-1] == "R")
                kept = ROLES[STATES[r]] if audit[-1] == "R" else role
                hashes[r] = _extended(self.hashes[q], [*(ROLES[x].encode() + b":" for x in BETWEEN[STATES[r]][STATES[q]]), kept.encode() + b":" + text])
        self.steps += bytes(steps[1:])
        order = {key: i for i, key in enumerate(sorted({(b[1], b[2]) for b in best}))}
        self.rank = [order[b[1], b[2]] for b in best]
        self.deleted += self.costs.delete
        self.value = [b[0] - self.deleted for b in best]
        self.hashes = hashes

    def plan(self) -> tuple:
        ends = [(self.value[q] + self.deleted + len(LAST[s]) * self.costs.insert, self.rank[q], "I" * len(LAST[s]), q) for q, s in enumerate(STATES)]
        cost, _, audit, q = min(ends)
        repaired = _extended(self.hashes[q], [ROLES[x].encode() + b":" for x in LAST[STATES[q]]]) or hashlib.sha256()
        out = [audit]
        for i in range(self.rows - 1, -1, -1):
            step = self.steps[i * 3 + q - 1] if q else 0
            out.append("D" if not step else ("R" if (step - 1) & 1 else "K"))
            if step:
                out.append("I" if (step - 1) & 2 else "")
                q = (step - 1) >> 2
        gaps = self.most - self.least + 1 - self.turns if self.turns else 0
        return gaps, self.counts[BLANK], self.counts[REPEATED], self.counts[CUT], self.illegal, cost, "".join(reversed(out)), repaired.hexdigest()


def _extended(state, lines: list[bytes]):
    """A copy of a hash of lines with more of them."""
    if not lines:
        return state
    if state is None:
        return hashlib.sha256(b"\n".join(lines))
    state = state.copy()
    for line in lines:
        state.update(b"\n")
        state.update(line)
    return state


def _ordered(rows: DataFrame, conv: str, turn: str, role: str, text: str, present: Column | None) -> DataFrame:
    """Rows with their faults, of a conversation together and in order."""
    there = F.lit(True) if present is None else present
    rows = rows.select(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role), F.lit(" ")).alias("role"), F.coalesce(F.col(text), F.lit(" ")).alias("text"), there.alias("there"))
    same = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256)
    rows = rows.withColumn("same", F.when(F.col("there"), same)).repartition("conv")
    nth = F.row_number().over(Window.partitionBy("conv", "same").orderBy("turn"))
    blank = ~F.col("text").rlike(f"[^{_SPACE}]")
    cut = ~F.col("text").rlike(rf"[.!?][{_SPACE}]*\z")
    fault = F.when(blank, BLANK).when(nth > 1, REPEATED).when(cut, CUT).otherwise(0)
    rows = rows.withColumn("fault", fault).drop("same")
    # of equal rows of one turn the first is the one that is no duplicate
    return rows.sortWithinPartitions("conv", "turn", "role", "text", F.col("fault") == REPEATED)


def repairs(rows: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", present: Column | None = None, costs: Costs = Costs()) -> DataFrame:
    """conv and its faults, cost, audit and repaired_sha256, one row for each conversation, also for one of which no row is present."""
    kind = dict(rows.dtypes)[conv]

    def streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, plans, now, at = [], [], None, None

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(names, of), *(pa.array(c, t) for c, t in zip(zip(*plans, strict=True), [pa.int64()] * 6 + [pa.string()] * 2, strict=True))], names=["conv", *(x.split()[0] for x in PLAN.split(", "))])

        of = pa.null()
        for b in batches:
            of = b.column("conv").type
            text = b.column("text").cast(pa.large_binary()).to_pylist()
            for c, turn, role, t, there, fault in zip(b.column("conv").to_pylist(), b.column("turn").to_pylist(), b.column("role").to_pylist(), text, b.column("there").to_pylist(), b.column("fault").to_pylist(), strict=True):
                if now is None or c != at:
                    if now is not None:
                        names.append(at)
                        plans.append(now.plan())
                    now, at = Repair(costs), c
                if there:
                    now.add(turn, role, t, fault)
            if len(names) >= 5000:
                yield out()
                names, plans = [], []
        if now is not None:
            names.append(at)
            plans.append(now.plan())
            yield out()

    return _ordered(rows, conv, turn, role, text, present).mapInArrow(streamed, f"conv {kind}, {PLAN}").withColumnRenamed("conv", conv)


def repaired(rows: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", present: Column | None = None, costs: Costs = Costs()) -> DataFrame:
    """The repaired conversations: conv, place (from 0), turn (of the row; null where one was put in), role, text, edit (K, R or I)."""
    kind = dict(rows.dtypes)[conv]
    there = F.lit(True) if present is None else present
    audits = repairs(rows, conv=conv, turn=turn, role=role, text=text, present=present, costs=costs).select(F.col(conv).alias("conv"), F.lit(True).alias("plan"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.col("audit").alias("text"))
    each = rows.where(there).select(F.col(conv).alias("conv"), F.lit(False).alias("plan"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role), F.lit(" ")).alias("role"), F.coalesce(F.col(text), F.lit(" ")).alias("text"))

    def applied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        audit, at, place, last, end = "", 0, 0, "", 0
        for b in batches:
            out = []

            def put(conv) -> None:
                nonlocal at, place, last
                while at < len(audit) and audit[at] == "I":
                    last = "a" if last == "u" else "u"
                    out.append((conv, place, None, ROLES[last], "", "I"))
                    at, place = at + 1, place + 1

            for r in b.to_pylist():
                if r["plan"]:
                    audit, at, place, last = r["text"], 0, 0, ""
                    end = len(audit.rstrip("I"))
                    continue
                put(r["conv"])
                edit = audit[at]
                at += 1
                if edit != "D":
                    last = r["role"][:1] if edit == "K" else "a" if last == "u" else "u"
                    out.append((r["conv"], place, r["turn"], r["role"] if edit == "K" else ROLES[last], r["text"], edit))
                    place += 1
                if at == end:
                    put(r["conv"])
            cols = list(zip(*out, strict=True)) or [()] * 6
            kinds = [b.column("conv").type, pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["conv", "place", "turn", "role", "text", "edit"])

    both = audits.unionByName(each).repartition("conv").sortWithinPartitions("conv", F.desc("plan"), "turn", "role", "text")
    return both.mapInArrow(applied, f"conv {kind}, place long, turn long, role string, text string, edit string").withColumnRenamed("conv", conv)


def damaged(rows: DataFrame) -> DataFrame:
    """The contract's damage to conversations: conv_id, turn, role, text, present (false for rows that are dropped)."""
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat_ws(":", text_of("conv_id"), text_of("turn")).cast("binary")) % 20
    role, text = text_of("role"), text_of("text")
    rows = rows.select(
        "conv_id",
        "turn",
        F.when(fate == 4, "user").otherwise(role).alias("role"),
        F.when(fate == 1, "").when(fate == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        (fate != 0).alias("present"),
        F.explode(F.array_repeat(F.lit(0), F.when(fate == 3, 2).otherwise(1))).alias("copy"),
    )
    return rows.drop("copy")
