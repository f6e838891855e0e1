"""The prefix trie of conversations: one node for every distinct sequence of first turns.

Paths. A turn is known by 128 bits of the SHA-256 of role and text, a conversation by these side by side: byte order of
such paths is the order of turn arrays, and the common bytes of two of them give their longest common prefix (LCP). Texts are
never shuffled.

Method. Paths are sorted globally, by range partitions of path and id. In the sorted order a node is an interval of rows, and the
LCP of neighbours says where intervals end: a stack of the open nodes is popped down to it, and a node that is popped has
met all of its members, so its sums are final. That holds but for nodes on the path of a partition's first or last row, which
may go on in its neighbours. These open stacks are written as rows, a few for each partition, and a second sweep of the same
kind over them, in partition order, stitches them: it goes on with what is equal, closes the rest, and adds up. Nodes whose
parent is still open where they close point at it by partition and place, and get its id by a join.

Scale. Range partitions split by path and id, so a prefix, or one whole conversation, that a third of all rows share is
spread evenly. A partition's sweep holds the open nodes, those below them that wait for their parent's id, and the ids
of members that end at the node on top. The second sweep is one task: it gets two paths from each partition and the ids that end
there, and holds one path, a digest and the open nodes' partitions. A digest over all ids that end at a node can't be split.

Cases. Null roles and texts are empty. Turns are taken in ascending order, nulls first, ties in the order of their digests; repeated
rows are turns of their own. Rows with a null id are one conversation: it is a member, but counts neither as a smallest id
nor among those of a digest, so a node of nothing else has a null id. Equal conversations share all nodes. Texts of any length
are digested whole; a conversation's path, 16 bytes a turn, is one value. An empty table has no node, not even a
root. Other columns aren't read. Ids are whole numbers.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: Bytes that a turn is known by.
SIZE = 16
#: Rows of a batch that a sweep returns.
BATCH = 10_000
#: What a sweep's rows are: a closed node that knows its parent's id, one whose parent is still open, an open node, an open node's id.
CLOSED, POINTING, OPEN, SETTLED = range(4)
FIRST, LAST = 0, 1


def turns(rows: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv, turns: the digest and the number of code points of every turn, in order."""
    role, text = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    known = F.unhex(F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256), 1, 2 * SIZE))
    one = F.struct(F.col(turn).alias("turn"), known.alias("known"), F.length(text).alias("chars"))
    grouped = rows.select(F.col(conv).cast("long").alias(conv), one.alias("one")).groupBy(conv).agg(F.sort_array(F.collect_list("one")).alias("turns"))
    return grouped.select(conv, F.transform("turns", lambda t: F.struct(t["known"].alias("known"), t["chars"].alias("chars"))).alias("turns"))


def rebuilt(own: DataFrame, conv: str = "conv_id", every: int = 100, most: int = 6) -> DataFrame:
    """The contract's conversations: the first h turns of conversation c - c % every, then the own ones after the first h; h is
    crc32 of the decimal id, modulo most. A conversation without an id stays as it is."""
    h = F.coalesce((F.crc32(F.col(conv).cast("string").cast("binary")) % most).cast("int"), F.lit(0))
    base = own.where(F.col(conv) % every == 0).select(F.col(conv).alias("__base"), F.slice("turns", 1, most).alias("__head"))
    rows = own.join(base, F.col(conv) - F.col(conv) % every == F.col("__base"), "left").withColumn("__h", h)
    head = F.coalesce(F.slice("__head", F.lit(1), F.col("__h")), F.array().cast(dict(own.dtypes)["turns"]))
    tail = F.slice("turns", F.col("__h") + 1, F.greatest(F.size("turns") - F.col("__h"), F.lit(0)))
    return rows.select(conv, F.concat(head, tail).alias("turns"))


class Node:
    """An open node: what is known of its members so far."""

    __slots__ = ("depth", "known", "chars", "n", "least", "children", "leaves", "saved", "ids", "ends", "waiting", "marks")

    def __init__(self, depth: int, known: bytes, chars: int):
        self.depth, self.known, self.chars = depth, known, chars
        self.n = self.children = self.leaves = self.saved = 0
        self.least = None  # smallest id
        self.ids = None  # ids that end here and aren't digested yet
        self.ends = None  # digest of those that end here: an object that takes more, or its text
        self.waiting = []  # closed children that wait for this node's id
        self.marks = []  # where this node was open

    def ended(self) -> str:
        if self.ids is not None:
            self.digest(self.ids)
        return self.ends if isinstance(self.ends, str) else (self.ends or hashlib.sha256()).hexdigest()

    def digest(self, ids) -> None:
        if len(ids):
            text = ",".join(map(str, ids)).encode()
            if self.ends is None:
                self.ends = hashlib.sha256(text)
            else:
                self.ends.update(b"," + text)

    def settle(self) -> None:
        """All members and children are known."""
        self.leaves = self.leaves if self.children else 1
        self.saved += (self.n - 1) * self.chars

    def into(self, parent: Node) -> None:
        parent.n += self.n
        if self.least is not None and (parent.least is None or self.least < parent.least):
            parent.least = self.least
        parent.children += 1
        parent.leaves += self.leaves
        parent.saved += self.saved

    def values(self) -> tuple:
        return self.least, self.depth, self.n, self.children, self.leaves, self.saved, self.ended()


ROW = pa.schema(
    [("kind", pa.int32()), ("conv_id", pa.int64()), ("depth", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("ends_sha256", pa.string())]
    + [("parent_conv_id", pa.int64()), ("part", pa.int64()), ("side", pa.int32()), ("place", pa.int64()), ("known", pa.binary()), ("chars", pa.int64()), ("ids", pa.list_(pa.int64()))]
)
DDL = "kind int, conv_id long, depth long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, parent_conv_id long, part long, side int, place long, known binary, chars long, ids array<long>"


def _closed(values: tuple, parent: int | None) -> tuple:
    return (CLOSED, *values, parent, None, None, None, None, None, None)


def _pointing(values: tuple, part: int, side: int, place: int) -> tuple:
    return (POINTING, *values, None, part, side, place, None, None, None)


def _open(node: Node, part: int, side: int, undigested: bool) -> tuple:
    ends = None if undigested else node.ended()
    return (OPEN, node.least, node.depth, node.n, node.children, node.leaves, node.saved, ends, None, part, side, node.depth, node.known, node.chars, list(node.ids or ()) if undigested else None)


def common(a: bytes, b: bytes) -> int:
    """Turns at the beginning of both paths."""
    most, i = min(len(a), len(b)), 0
    while i < most and a[i : i + SIZE] == b[i : i + SIZE]:
        i += SIZE
    return i // SIZE


def sweep(part: int, rows: Iterator[tuple[bytes, list[int], int | None]]) -> Iterator[tuple]:
    """The nodes of a sorted partition (path, code points of its turns, id): closed ones, and at last the open ones."""
    stack: list[Node] = []
    first: list[Node] = []  # popped nodes of the first row's path, deepest first
    along = 0  # down to this depth the stack is the first row's path
    ends = -1  # depth of the first row
    last = b""

    def popped() -> Iterator[tuple]:
        nonlocal along
        node = stack.pop()
        if node.depth <= along:
            first.append(node)
            along = node.depth - 1
            return
        node.settle()
        parent, values = stack[-1], node.values()
        node.into(parent)
        if parent.depth <= along:
            yield _pointing(values, part, FIRST, parent.depth)
        else:
            parent.waiting.append(values)
        for x in node.waiting:
            yield _closed(x, node.least)

    for path, chars, conv in rows:
        if stack:
            shared = common(last, path)
            while len(stack) - 1 > shared:
                yield from popped()
        else:
            stack.append(Node(0, b"", 0))
            ends = along = len(path) // SIZE
        for depth in range(len(stack), len(path) // SIZE + 1):
            stack.append(Node(depth, path[(depth - 1) * SIZE : depth * SIZE], chars[depth - 1]))
        node, last = stack[-1], path
        node.n += 1
        node.ids = array("q") if node.ids is None else node.ids
        if conv is not None:
            node.ids.append(conv)
            node.least = conv if node.least is None else min(node.least, conv)
    for node in stack[: along + 1] + first[::-1]:
        yield _open(node, part, FIRST, node.depth == ends or node is stack[-1])
    for node in stack[along + 1 :]:
        yield _open(node, part, LAST, node is stack[-1])
        for x in node.waiting:
            yield _pointing(x, part, LAST, node.depth)


def stitch(rows: Iterator[dict]) -> Iterator[tuple]:
    """The open nodes of all partitions, in order of partition, side and depth: closed now, and their ids for those that point at them."""
    stack: list[Node] = []

    def popped() -> Iterator[tuple]:
        node = stack.pop()
        node.settle()
        if stack:
            stack[-1].waiting.append(node.values())
            node.into(stack[-1])
        else:
            yield _closed(node.values(), None)
        for x in node.waiting:
            yield _closed(x, node.least)
        for part, side in node.marks:
            yield (SETTLED, node.least, *[None] * 7, part, side, node.depth, None, None, None)

    on = False
    for r in rows:
        depth = r["place"]
        # the first path of a partition goes on with the open stack as long as their turns are equal
        on = r["side"] == FIRST and (on or depth == 0) and depth < len(stack) and stack[depth].known == r["known"]
        if not on:
            while len(stack) > depth:
                yield from popped()
            stack.append(Node(depth, r["known"], r["chars"]))
        node = stack[-1] if not on else stack[depth]
        node.n += r["n_convs"]
        if r["conv_id"] is not None:
            node.least = r["conv_id"] if node.least is None else min(node.least, r["conv_id"])
        node.children += r["n_children"]
        node.leaves += r["n_leaves"]
        node.saved += r["saved_tokens"]
        if r["ids"] is not None:
            node.digest(r["ids"])
        elif node.ends is None and r["n_convs"]:
            node.ends = r["ends_sha256"]
        node.marks.append((r["part"], r["side"]))
    while stack:
        yield from popped()


def _batches(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    held = []
    for r in rows:
        held.append(r)
        if len(held) == BATCH:
            yield _batch(held)
            held = []
    if held:
        yield _batch(held)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), ROW, strict=True)], schema=ROW)


def _swept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    rows = (r for b in batches for r in zip(b.column("path").to_pylist(), b.column("chars").to_pylist(), b.column("conv_id").to_pylist(), strict=True))
    yield from _batches(sweep(TaskContext.get().partitionId(), rows))


def _stitched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from _batches(stitch(r for b in batches for r in b.to_pylist()))


NODE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def nodes(paths: DataFrame, conv: str = "conv_id") -> DataFrame:
    """The nodes of conversations (conv, turns). A node's turn is the depth-th one of conversation conv_id, its smallest member."""
    path = F.unhex(F.array_join(F.transform("turns", lambda t: F.hex(t["known"])), ""))
    rows = paths.select(F.col(conv).alias("conv_id"), path.alias("path"), F.transform("turns", lambda t: t["chars"]).alias("chars"))
    rows = rows.repartitionByRange(F.col("path"), F.col("conv_id")).sortWithinPartitions("path", "conv_id")
    # written once: a second run could cut the ranges elsewhere
    found = written(rows.mapInArrow(_swept, DDL), "trie-sweep", by="kind")
    kind = lambda df, k: df.where(F.col("kind") == k)
    opened = kind(found, OPEN).repartition(1).sortWithinPartitions("part", "side", "place")
    last = written(opened.mapInArrow(_stitched, DDL), "trie-stitch", by="kind")
    parents = kind(last, SETTLED).select("part", "side", "place", F.col("conv_id").alias("parent"))
    pointing = kind(found, POINTING).join(parents, ["part", "side", "place"]).withColumn("parent_conv_id", F.col("parent"))
    return kind(found, CLOSED).select(*NODE).unionByName(pointing.select(*NODE)).unionByName(kind(last, CLOSED).select(*NODE))


def trie(rows: DataFrame, **columns: str) -> DataFrame:
    """The nodes of the conversations of a table as they are."""
    return nodes(turns(rows, **columns), columns.get("conv", "conv_id"))
