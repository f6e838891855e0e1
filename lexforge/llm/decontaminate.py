"""Benchmark decontamination: one Aho-Corasick automaton over the windows of all benchmark items.

Texts are normalised byte for byte (A-Z lower-cased; whatever is neither an ASCII letter, an ASCII digit nor part of a
non-ASCII character becomes a space), so that an offset in the normalised text is the offset in the original. The
automaton's symbols are whole words: the items' words are numbered, and all other words are 0, which no window has. The
words of a text run through the automaton once. Matches carry their items and word range, and word ranges are mapped to
byte ranges of the original.

The automaton goes to the executors as a broadcast of the items' texts, and a worker builds it once, not once a task. It
has at most ``width`` nodes for each window. Items of more windows than ``max_windows`` are dealt into blocks, each an
automaton of its own and a job of its own, one after the other; what a block finds is written as slim rows under the text's
hash, and the blocks' finds meet in the end. So a worker never holds more than one block's automaton.

Cases. Null or empty texts have no words, no hits and are not contaminated. An item without words has no window. Repeated
documents are judged one by one; items that share a window are all reported, repeated item ids once (ties). The windows of
an item whose id is null hit like all others; it has no name, so it counts neither in n_items nor in items_sha256. Texts of
any length are scanned whole, each as one row. Empty documents give an empty result, an empty benchmark hits nothing. Columns
may have any names: they travel under names of our own.
"""

from __future__ import annotations

import hashlib
import math
import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import raw, table, written

WIDTH = 13
#: Windows of one automaton: at most WIDTH nodes each.
MAX_WINDOWS = 500_000
_KEEP = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))

REPORT = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def normalised(data: bytes) -> bytes:
    """Lower-cased, with a space for each byte that belongs to no word; as long as the input."""
    return data.translate(_KEEP)


class Windows:
    """An Aho-Corasick automaton over numbered words; its values are (words in the window, item ids)."""

    def __init__(self, items, width: int = WIDTH):
        import ahocorasick

        self.number: dict[bytes, int] = {}
        self.trie = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for item_id, data in items:
            ws = [self.number.setdefault(w, len(self.number) + 1) for w in normalised(data or b"").split()]
            for i in range(max(1, len(ws) - width + 1) if ws else 0):
                window = tuple(ws[i : i + width])
                n, ids = self.trie.get(window, (len(window), ()))
                if item_id is not None and item_id not in ids:
                    ids = (*ids, item_id)
                self.trie.add_word(window, (n, ids))
        if self.number:
            self.trie.make_automaton()

    def scan(self, ws: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Word ranges [first, last] of all windows in a text's words, and the ids of their items."""
        ranges: list[tuple[int, int]] = []
        items: set = set()
        if not self.number or not ws:
            return ranges, items
        number = self.number.get
        for last, (n, ids) in self.trie.iter(tuple([number(w, 0) for w in ws])):
            ranges.append((last - n + 1, last))
            items.update(ids)
        return ranges, items


def hits(ranges, n: int) -> np.ndarray:
    """For each of n words, whether a range covers it."""
    step = np.zeros(n + 1, np.int64)
    for first, last in ranges:
        step[first] += 1
        step[last + 1] -= 1
    return np.cumsum(step[:n]) > 0


def spans(data: bytes, covered: np.ndarray) -> list[tuple[int, int]]:
    """Byte ranges [start, end) in the original text of the runs of covered words."""
    out: list[tuple[int, int]] = []
    before = -2
    for k, m in enumerate(re.finditer(rb"[^ ]+", normalised(data))):
        if covered[k]:
            if before == k - 1:
                out[-1] = (out[-1][0], m.end())
            else:
                out.append(m.span())
            before = k
    return out


def _blocks(benchmark: DataFrame, item_id: str, text: str, width: int, max_windows: int):
    """The items in blocks of about max_windows windows; they are counted before anything is collected."""
    items = benchmark.select(F.col(item_id).cast("string").alias("i"), F.col(text).cast("binary").alias("t")).where("t is not null")
    # an upper bound without parsing: every word but the first of a text has a byte before it
    windows = items.agg(F.coalesce(F.sum((F.length("t") + 1) / 2), F.lit(0.0))).first()[0]
    if windows > max_windows:
        windows = items.agg(F.coalesce(F.sum(F.size(F.split(F.col("t").cast("string"), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"))), F.lit(0))).first()[0]
    n = max(1, math.ceil(windows / max_windows))
    for k in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k)
        yield [(r.i, bytes(r.t)) for r in part.toLocalIterator()], n


def contamination(docs: DataFrame, benchmark: DataFrame, *, doc_id="doc_id", **options) -> DataFrame:
    """One row per document: its id, words, hit words, items, spans (byte ranges in the original text) and whether at
    least ``percent`` % of its words are hit."""
    found = _judged(docs, benchmark, [doc_id], **options)
    return found.withColumnRenamed("k0", doc_id)


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that are not contaminated, with all their columns."""
    found = _judged(docs, benchmark, docs.columns, **options).where("not contaminated")
    return found.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(docs.columns)])


def _judged(docs: DataFrame, benchmark: DataFrame, carried, *, text="text", item_id="item_id", item_text="text", width=WIDTH, percent=5, max_windows=MAX_WINDOWS) -> DataFrame:
    spark = docs.sparkSession
    rows = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(carried)], F.col(text).alias("t"))
    kinds = [rows.schema[f"k{i}"].dataType.simpleString() for i in range(len(carried))]
    after = ", ".join(f"k{i} {kind}" for i, kind in enumerate(kinds)) + f", {REPORT}, spans array<struct<start:int,end:int>>"
    finds = []
    for items, n in _blocks(benchmark, item_id, item_text, width, max_windows):
        sent, name = spark.sparkContext.broadcast(items), uuid.uuid4().hex
        if n == 1:
            return rows.mapInArrow(_reporter(len(carried), percent, lambda: _built(name, sent, width)), after)
        # a verdict depends on the text alone: its hash is the key, and copies of it find the same
        texts = docs.select(F.md5(F.col(text).cast("binary")).alias("key"), F.col(text).alias("t")).where("t is not null")
        found = texts.mapInArrow(_finder(name, sent, width), "key string, ranges array<int>, items array<string>")
        finds.append(written(found.groupBy("key").agg(F.first("ranges").alias("ranges"), F.first("items").alias("items")), "windows"))
        sent.unpersist()
    every = finds[0]
    for f in finds[1:]:
        every = every.unionByName(f)
    every = every.groupBy("key").agg(F.flatten(F.collect_list("ranges")).alias("ranges"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    rows = rows.withColumn("of", F.md5(F.col("t").cast("binary"))).join(every, F.col("of") == F.col("key"), "left").drop("of", "key")
    return rows.mapInArrow(_reporter(len(carried), percent, None), after)


_last: dict[str, Windows] = {}


def _built(name: str, sent, width: int) -> Windows:
    """The automaton of a broadcast, built once by each worker, which keeps one."""
    if name not in _last:
        _last.clear()
        _last[name] = Windows(sent.value, width)
    return _last[name]


def _finder(name: str, sent, width: int):
    """key, ranges and items of the texts with a window."""

    def run(batches):
        trie = _built(name, sent, width)
        for batch in batches:
            rows = [(k, *trie.scan(normalised(data).split())) for k, data in zip(batch.column("key").to_pylist(), raw(batch.column("t")), strict=True)]
            rows = [(k, [x for r in ranges for x in r], sorted(ids)) for k, ranges, ids in rows if ranges]
            if rows:
                keys, ranges, items = map(list, zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(ranges, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string()))], names=["key", "ranges", "items"])

    return run


def _reporter(n_kept: int, percent: int, trie):
    """The report of each text: by the automaton, or from the ranges and items that rows bring along."""

    def run(batches):
        found = trie() if trie else None
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                kept = {f"k{i}": part.column(i) for i in range(n_kept)}
                brought = zip(part.column("ranges").to_pylist(), part.column("items").to_pylist(), strict=True) if not found else None
                rows = []
                for data in raw(part.column("t")):
                    ws = normalised(data or b"").split()
                    if found:
                        ranges, ids = found.scan(ws)
                    else:
                        flat, ids = (x or [] for x in next(brought))
                        ranges = list(zip(flat[::2], flat[1::2], strict=True))
                    covered = hits(ranges, len(ws)) if ranges else None
                    n = int(covered.sum()) if ranges else 0
                    rows.append((len(ws), n, len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), n > 0 and 100 * n >= percent * len(ws), [{"start": a, "end": b} for a, b in spans(data, covered)] if ranges else []))
                names = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans"]
                columns = dict(zip(names, map(list, zip(*rows, strict=True)), strict=True))
                schema = [(c, part.column(c).type) for c in kept] + [("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()), ("contaminated", pa.bool_()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))]
                yield table(part, pa.schema(schema), **kept, **columns)

    return run
