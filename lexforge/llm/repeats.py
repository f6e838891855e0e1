"""Exact removal of repeated substrings by prefix-free parsing.

A byte is removed when some string of ``width`` bytes that covers it also starts earlier in the corpus (in a smaller
document, or earlier in the same one). Everything is judged on the input.

Parsing. A rolling hash of ``gram`` bytes runs over each text; in every window of ``width`` bytes the smallest hash,
the leftmost of equals, triggers. Consecutive windows with one trigger are a phrase: the bytes that these windows
cover. Equal windows have equal triggers at equal places, so repeats parse alike wherever they stand, and a phrase
is known by its trigger's hash, its extent around the trigger and a fingerprint of its bytes.

Ordering. The phrases, sorted by trigger and fingerprint and then by corpus position, play the part of the suffix
array of dictionary and parse: only equality and the earliest occurrence matter, so fingerprints may stand for
lexicographic ranks. Of equal phrases, all but the first are repeats as a whole. Phrases that share a trigger
but differ meet at the rims of longer repeats: they are cut into quarters by distance from the trigger, quarters
whose common bytes stand nowhere else are dropped, and the single windows of the others are sorted the same way.

Scale. Equal phrases are first resolved inside each block of texts that a task holds, so a passage that stands in a
third of all documents is a few rows of each task when it is shuffled. What is shuffled is one row per phrase
(about 1 for 35 bytes), one row per window at the rims, and the compressed texts, twice. Sorted rows stream through
a task; nothing is gathered but a document's own places.
Fingerprints have 64 bits under a 64-bit trigger hash.

Cases. Null and empty texts have no bytes. Documents with equal ids (ties) are ordered by their texts, null ids come first;
of wholly equal rows none counts as the earlier one. Ids that aren't whole numbers are numbered in their own order first.
Texts of any length are parsed in strides; a text is in memory as a whole. An empty table gives an empty result. Columns
other than id and text aren't read. Windows may be wider than their gram by up to ``SPAN`` bytes; more is an error.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import numbered, raw, written

WIDTH, GRAM = 100, 32
#: Bytes of text that are parsed at a time.
BLOCK = 1 << 20
#: Windows whose triggers are sought at a time: their places have 24 bits.
STRIDE = 1 << 23
#: How far a window may start before its trigger: 12 bits of a place.
SPAN = 4095
_POS = np.uint64((1 << 24) - 1)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BYTE = np.random.Generator(np.random.PCG64(20240607)).integers(0, 1 << 64, 256, dtype=np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(int(_BASE), -1, 1 << 64)
    up, down = np.ones(n + 1, np.uint64), np.ones(n + 1, np.uint64)
    up[1:], down[1:] = _BASE, np.uint64(inverse)
    return np.cumprod(up), np.cumprod(down)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def _least(grams: np.ndarray, span: int) -> np.ndarray:
    """Place of the least of every ``span`` neighbours, the leftmost of equals, by the upper 40 bits."""
    key = (grams & ~_POS) | np.arange(len(grams), dtype=np.uint64)
    low, size = key, 1
    while size * 2 <= span:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    if size < span:
        low = np.minimum(low[: len(key) - span + 1], low[span - size :][: len(key) - span + 1])
    return (low & _POS).astype(np.int64)


class Block:
    """Bytes of several texts, one after the other, with the hash of any substring."""

    _up, _down = _powers(1)

    def __init__(self, texts: list[bytes]):
        self.sizes = np.array([len(t) for t in texts], np.int64)
        self.ends = np.cumsum(self.sizes)
        self.starts = self.ends - self.sizes
        self.data = np.frombuffer(b"".join(texts), np.uint8)
        n = len(self.data)
        if len(Block._up) < n + 1:
            Block._up, Block._down = _powers(max(n, BLOCK * 2))
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[self.data] * Block._up[:n], out=sums[1:])
        self.sums = sums

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[end] - self.sums[start]) * Block._down[start])

    def phrases(self, width: int, gram: int):
        """(text, trigger, first window, last window, trigger hash) of each phrase, positions in the block."""
        n = len(self.data)
        none = np.zeros(0, np.int64)
        if n < width:
            return none, none, none, none, np.zeros(0, np.uint64)
        grams = _mixed((self.sums[gram:] - self.sums[:-gram]) * Block._down[: n - gram + 1])
        span = width - gram + 1
        at = np.concatenate([_least(grams[i : i + STRIDE + span - 1], span) + i for i in range(0, len(grams) - span + 1, STRIDE)])
        text = np.repeat(np.arange(len(self.sizes)), self.sizes)[: len(at)]
        ok = np.arange(len(at)) + width <= self.ends[text]
        where = np.flatnonzero(ok)
        if not len(where):
            return none, none, none, none, np.zeros(0, np.uint64)
        a, t = at[where], text[where]
        new = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (t[1:] != t[:-1])]))
        last = np.concatenate([new[1:], [len(where)]]) - 1
        return t[new], a[new], where[new], where[last], grams[a[new]]


def _blocks(batches, block: int):
    """Rows of the batches, in blocks of about that many bytes: (rows' columns, texts)."""
    for batch in batches:
        texts = [t or b"" for t in raw(batch.column("t"))]
        lo = size = 0
        for i, t in enumerate(texts):
            size += len(t)
            if size >= block or i == len(texts) - 1:
                yield batch.slice(lo, i + 1 - lo), texts[lo : i + 1]
                lo, size = i + 1, 0


#: place: offset of the trigger, how far before it the first and the last window start, and whether the row is known
#: to be a repeat. twin tells documents with equal ids apart and is there only if there are any.
def _schema(twin: bool, *more) -> pa.Schema:
    return pa.schema([("key", pa.int64()), ("print", pa.int64()), ("id", pa.int64()), *[("twin", pa.int64())] * twin, ("place", pa.int64()), *more])


def _sql(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {'long' if f.type == pa.int64() else 'binary'}" for f in schema)


def _place(at, left, right, done):
    return at.astype(np.int64) << 25 | left.astype(np.int64) << 13 | right.astype(np.int64) << 1 | done


def _extent(place):
    at = place >> 25
    return at - (place >> 13 & SPAN), at - (place >> 1 & SPAN)


def _again(key, print_, order, at):
    """Which rows have an equal (key, print) before them, by (order, at); rows of one place are one."""
    idx = np.lexsort((at, order, print_, key))
    k, p = key[idx], print_[idx]
    new = np.concatenate([[True], (k[1:] != k[:-1]) | (p[1:] != p[:-1])])
    lead = idx[np.maximum.accumulate(np.where(new, np.arange(len(idx)), 0))]
    out = np.zeros(len(idx), bool)
    out[idx] = (order[idx] != order[lead]) | (at[idx] != at[lead])
    return out


def _column(part, name):
    i = part.schema.get_field_index(name)
    return part.column(i).to_numpy(zero_copy_only=False) if i >= 0 else None


def _rows(part, t, at, left, right, key, prints) -> pa.RecordBatch:
    """One row per phrase; those with an equal one before them in the block get a key of their own and go anywhere."""
    ids, twins = _column(part, "id"), _column(part, "twin")
    same = twins if twins is not None else np.zeros(len(ids), np.int64)
    idx = np.lexsort((same, ids))
    order = np.empty(len(ids), np.int64)
    order[idx] = np.cumsum(np.concatenate([[0], (ids[idx][1:] != ids[idx][:-1]) | (same[idx][1:] != same[idx][:-1])]))
    done = _again(key, prints, order[t], at)
    alone = _mixed(ids[t].astype(np.uint64) * _BASE + at.astype(np.uint64))
    key = np.where(done, alone, key)
    columns = {"key": key.view(np.int64), "print": prints.view(np.int64), "id": ids[t], "place": _place(at, left, right, done)}
    schema = _schema(twins is not None)
    if twins is not None:
        columns["twin"] = twins[t]
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], pa.int64()) for f in schema], schema=schema)


def _parser(width: int, gram: int, size: int):
    def run(batches):
        for part, texts in _blocks(batches, size):
            b = Block(texts)
            t, a, first, last, key = b.phrases(width, gram)
            if len(t):
                shape = ((a - first) * (SPAN + 1) + (a - last)).astype(np.uint64)
                yield _rows(part, t, a - b.starts[t], a - first, a - last, key, _mixed(b.hashes(first, last + width) ^ (shape * _BASE)))

    return run


def _packer(batches):
    """Texts compressed, for a shuffle."""
    import zstandard

    pack = zstandard.ZstdCompressor(level=1).compress
    for batch in batches:
        i = batch.schema.get_field_index("t")
        yield batch.set_column(i, pa.field("t", pa.binary()), pa.array([pack(t or b"") for t in raw(batch.column(i))], pa.binary()))


def _unpacked(batch) -> list[bytes]:
    import zstandard

    return list(map(zstandard.ZstdDecompressor().decompress, raw(batch.column("t"))))


def _cutter(width: int, step: int, twin: bool):
    """The undecided phrases in quarters, of ``step`` window starts by their distance from the trigger: the bytes that
    all windows of such a quarter have in common are the key, and the bytes of all of them come along."""
    schema = _schema(twin, ("bytes", pa.binary()))

    def run(batches):
        for batch in batches:
            out = {f.name: [] for f in schema}
            ids, twins, lists = _column(batch, "id"), _column(batch, "twin"), batch.column("places").to_pylist()
            for i, (data, places) in enumerate(zip(_unpacked(batch), lists, strict=True)):
                b, place = Block([data]), np.unique(np.array(places, np.int64))
                lo, hi = _extent(place)
                a = place >> 25
                for j in range(int((a - lo).max()) // step + 1):
                    first, last = np.maximum(lo, a - step * j - step + 1), np.minimum(hi, a - step * j)
                    some = np.flatnonzero(first <= last)
                    core = a[some] - step * j
                    keys = _mixed(b.hashes(core, core + width - step + 1) ^ (np.full(len(core), j, np.uint64) * _BASE)).view(np.int64)
                    out["key"].append(keys)
                    out["print"].append(np.zeros(len(some), np.int64))
                    out["id"].append(np.full(len(some), ids[i]))
                    if twin:
                        out["twin"].append(np.full(len(some), twins[i]))
                    out["place"].append(first[some])
                    out["bytes"] += [data[x:y] for x, y in zip(first[some].tolist(), (last[some] + width).tolist(), strict=True)]
            if out["bytes"]:
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) if f.name == "bytes" else pa.array(np.concatenate(out[f.name]), f.type) for f in schema], schema=schema)

    return run


def _windows(width: int):
    """The windows of the quarters, as phrases of one window each."""

    def run(batches):
        for part in batches:
            if not part.num_rows:
                continue
            b = Block(raw(part.column("bytes")))
            n = b.sizes - width + 1
            of = np.repeat(np.arange(len(n)), n)
            nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            at = b.starts[of] + nth
            none = np.zeros(len(of), np.int64)
            yield _rows(part, of, _column(part, "place")[of] + nth, none, none, b.hashes(at, at + width), none.astype(np.uint64))

    return run


def _pruner(width: int):
    """What is left of each text without its repeats."""

    def run(batches):
        for batch in batches:
            out = []
            for data, places in zip(_unpacked(batch), batch.column("places").to_pylist(), strict=True):
                starts, ends = spans(places or [], width)
                pieces, at = [], 0
                for lo, hi in zip(starts, ends, strict=True):
                    pieces.append(data[at:lo])
                    at = hi
                kept = b"".join([*pieces, data[at:]])
                out.append((len(data), len(data) - len(kept), len(starts), hashlib.sha256(kept).hexdigest(), list(map(int, starts)), list(map(int, ends))))
            n, removed, count, sha, starts, ends = map(list, zip(*out, strict=True)) if out else [[]] * 6
            columns = {"row": batch.column("row"), "n_bytes": pa.array(n, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(count, pa.int64()), "kept_sha256": pa.array(sha, pa.string()), "starts": pa.array(starts, pa.list_(pa.int32())), "ends": pa.array(ends, pa.list_(pa.int32()))}
            yield pa.RecordBatch.from_pydict(columns)

    return run


def spans(places, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes that the repeated phrases at these places cover."""
    if not len(places):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    lo, hi = _extent(np.array(places, np.int64))
    idx = np.argsort(lo, kind="stable")
    lo, hi = lo[idx], np.maximum.accumulate(hi[idx] + width)
    new = np.concatenate([[True], lo[1:] > hi[:-1]])
    return lo[new], hi[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(lo) - 1]])]


def _resolved(rows: DataFrame, ids: list[str]) -> DataFrame:
    """rows with repeat (an equal phrase stands before it) and open (first of its kind, but not its trigger's only)."""
    kind = Window.partitionBy("key", "print").orderBy(*ids, "place")
    trigger = Window.partitionBy("key")
    rows = rows.repartition("key").withColumn("rank", F.rank().over(kind))
    rows = rows.withColumn("least", F.min("print").over(trigger)).withColumn("most", F.max("print").over(trigger))
    repeat = (F.col("rank") > 1) | (F.col("place").bitwiseAND(F.lit(1)) == 1)
    return rows.select(*ids, "place", repeat.alias("repeat"), (~repeat & (F.col("least") != F.col("most"))).alias("open")).where("repeat or open")


def repeats(docs: DataFrame, *, doc_id="doc_id", text="text", width: int = WIDTH, gram: int = GRAM, block: int = BLOCK) -> DataFrame:
    """One row per document: row (its id), n_bytes, n_removed, n_spans, kept_sha256, and the starts and ends of the
    removed runs of bytes."""
    if not 0 < gram <= width <= gram + SPAN:
        raise ValueError(f"width must be at least gram and at most gram + {SPAN}")
    null_id = -(1 << 63)
    rows = numbered(docs.select(F.col(doc_id).alias("row"), F.col(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("t")), "id")[0]
    rows = rows.select("row", F.coalesce(F.col("id").cast("long"), F.lit(null_id)).alias("id"), "t")
    twin = not rows.groupBy("id").count().where("count > 1").isEmpty()
    ids = ["id", "twin"] if twin else ["id"]
    if twin:
        rows = rows.withColumn("twin", F.xxhash64("t"))
    slim, plain = rows.select(*ids, "t"), _sql(_schema(twin))
    kind = docs.schema[doc_id].dataType.simpleString()
    head = ", ".join(f"{c} long" for c in ids)

    def by_document(places: DataFrame) -> DataFrame:
        return places.groupBy(*[F.col(c).alias(f"of_{c}") for c in ids]).agg(F.collect_list("place").alias("places"))

    def joined(texts: DataFrame, places: DataFrame, how: str) -> DataFrame:
        return texts.join(by_document(places), [F.col(c) == F.col(f"of_{c}") for c in ids], how)

    found = written(_resolved(slim.mapInArrow(_parser(width, gram, block), plain), ids), "repeats-phrases")
    packed = slim.mapInArrow(_packer, f"{head}, t binary")
    step = max(1, (width - gram + 4) // 4)
    cut = joined(packed, found.where("open"), "inner").select(*ids, "t", "places").mapInArrow(_cutter(width, step, twin), _sql(_schema(twin, ("bytes", pa.binary()))))
    core = Window.partitionBy("key")
    cut = cut.repartition("key").withColumn("spot", F.xxhash64(*ids, "place"))
    cut = cut.withColumn("least", F.min("spot").over(core)).withColumn("most", F.max("spot").over(core)).where("least != most")
    windows = cut.select(*ids, "place", "bytes").mapInArrow(_windows(width), plain)
    more = written(_resolved(windows, ids).where("repeat"), "repeats-windows")
    every = found.where("repeat").select(*ids, "place").unionByName(more.select(*ids, "place"))
    texts = rows.select("row", *ids, "t").mapInArrow(_packer, f"row {kind}, {head}, t binary")
    whole = joined(texts, every, "left").select("row", "t", "places")
    return whole.mapInArrow(_pruner(width), f"row {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, starts array<int>, ends array<int>")
