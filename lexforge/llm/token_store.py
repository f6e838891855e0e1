"""Token ids in files, coded by an adaptive context-mixing range coder.

Frames. The ids of documents, in ascending order of document ids, are gathered into frames of a few million ids. A frame
begins with its model: the distinct ids with their frequencies (order 0), the two best followers of each id (order 1) and
the best follower of each pair of ids (order 2), each where it saves more than it costs, with the class of its
probability, and the counts that the mixing starts from.

Blocks. A frame's ids are cut into blocks of ``BLOCK`` ids. Each block is reset to the frame's model, has no context
before its first id, and its own CRC-32, so a damaged or wanted block never needs another one.

Mixing. The classes of what order 2 and order 1 foresee select counts of how often the id was order 2's, order 1's first
or second, or none of them. These counts adapt within the block; they divide the interval between the orders. An id that
none of them foresees is coded by order 0. Contexts are compared as a whole, never by a hash alone.

Coder. A 64-bit range coder with 32-bit words; carries are added to the words before. The blocks of a frame run in
lockstep as the lanes of array operations.

Files. A row of the store is a frame: documents' ids and lengths, the model, the table of blocks, and the blocks. Spark
writes and reads rows of frames, so the store lives wherever Spark can write, and a lost task is written again.

Cases. Null and empty texts have no ids but the end id. Null document ids come first; equal ones (ties, repeated rows) are
ordered by their texts and all kept. Ids of any type are kept and ordered by that type. A text of any length is within one
frame, which may then be larger. An empty table makes an empty store. Ids beyond 2**32, or more than a million distinct
ones in a frame, are an error. Columns other than id and text aren't read.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import raw, shared_dir, written

BLOCK, LANES, END = 2048, 2048, 2
#: Bytes of text that a task codes (fewer where there are fewer for each core), and that it parses at a time; words that a
#: worker keeps the ids of.
PART, LEAST, CHUNK, KEPT = 256 << 20, 8 << 20, 12 << 20, 1_000_000
_MAGIC = b"LFT2"
#: Bits of a rank, of the order 0 frequencies, classes of a probability, and what a count grows by.
_WIDE, _ZERO, _CLASSES, _STEP = 20, 22, 8, 24
_NONE = (1 << _WIDE) - 1
_TILE = 16
_M16 = np.uint64(0xFFFF)
_SUMS = np.uint64(0x0001_0001_0001_0001)
_HALF, _WORD = np.uint64(1 << 32), np.uint64(32)


def _class(share: np.ndarray) -> np.ndarray:
    """1 to 7: the class of a probability."""
    return np.clip(1 + np.floor(-1.5 * np.log2(np.maximum(1 - share, 1e-9))), 1, _CLASSES - 1).astype(np.int64)


def _turned(rows: np.ndarray) -> np.ndarray:
    """Rows as columns, by tiles that a core's cache holds."""
    out = np.empty(rows.shape[::-1], rows.dtype)
    for k in range(0, len(rows), _TILE):
        out[:, k : k + _TILE] = rows[k : k + _TILE].T
    return out


def _shifted(ranks: np.ndarray, by: int, none: int) -> np.ndarray:
    """The ranks before each one, none at the beginning of a block."""
    out = np.full(len(ranks), none, np.int64)
    out[by:] = ranks[:-by] if by < len(ranks) else ranks[:0]
    for k in range(by):
        out[k::BLOCK] = none
    return out


def _pairs(ranks: np.ndarray, by: int) -> np.ndarray:
    """The ranks, each with as many as ``by`` before it in the higher bits, where a block has them."""
    pairs = ranks.astype(np.int64)
    for k in range(1, by + 1):
        pairs[k:] |= ranks[:-k].astype(np.int64) << k * _WIDE
    there = np.ones(len(ranks), bool)
    for k in range(by):
        there[k::BLOCK] = False
    return pairs[there]


def _followers(pairs: np.ndarray):
    """Of (context, follower) pairs: contexts, totals, and the first and second follower with their counts."""
    if not len(pairs):
        return (pairs, pairs, (pairs, pairs), (pairs, pairs))
    pairs.sort()
    new = np.flatnonzero(np.concatenate([[True], pairs[1:] != pairs[:-1]]))
    counts = np.diff(np.append(new, len(pairs)))
    pairs = pairs[new]
    own = pairs >> _WIDE
    at = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
    # the largest count, and of equal ones the smaller rank
    weight = counts << _WIDE | (_NONE - (pairs & _NONE))
    best = np.maximum.reduceat(weight, at)
    group = np.repeat(np.arange(len(at)), np.diff(np.append(at, len(own))))
    second = np.maximum.reduceat(np.where(weight == best[group], 0, weight), at)
    return own[at], np.add.reduceat(counts, at), (_NONE - (best & _NONE), best >> _WIDE), (_NONE - (second & _NONE), second >> _WIDE)


class Model:
    """What a frame foresees: built from its ids by the writer, from its bytes by the reader."""

    def __init__(self, alphabet, logs, one, two, prior):
        #: ids by rank; quantised logarithms of their counts
        self.alphabet, self.logs, self.one, self.two, self.prior = alphabet, logs, one, two, prior
        weights = np.exp2(logs / 8.0)
        room = (1 << _ZERO) - len(logs)
        ends = np.floor(np.cumsum(weights) / max(weights.sum(), 1e-300) * room).astype(np.int64) + np.arange(1, len(logs) + 1)
        self.cum = np.concatenate([[0], ends]).astype(np.uint64)
        # order 1 by rank: first follower, second, class, with room for order 2's follower before them
        context, first, second, cls = one
        self.first = np.full(len(alphabet) + 1, _NONE << 2 * _WIDE | _NONE << _WIDE, np.int64)
        self.first[context] = cls << 3 * _WIDE | second << 2 * _WIDE | first << _WIDE
        # order 2 in slots: the pair, follower, class; pairs of one slot but the first were left out by the writer
        keys, follower, cls = two
        self.bits = max(8, int(4 * len(keys) + 1).bit_length())
        self.slots = np.full(1 << self.bits, -1, np.int64)
        self.slots[self.slot(keys)] = cls << _WIDE | follower
        self.tags = np.full(1 << self.bits, -1, np.int64)
        self.tags[self.slot(keys)] = keys

    def slot(self, keys: np.ndarray) -> np.ndarray:
        x = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (x >> np.uint64(64 - self.bits)).view(np.int64)

    def foreseen(self, p2: np.ndarray, p1: np.ndarray):
        """What order 2 and order 1 (twice) foresee behind two ranks, in the three lowest fields of ``_WIDE`` bits, and the place of
        the mixing counts. No rank is the size of the alphabet."""
        e = self.first.take(p1, mode="clip")  # a damaged block has ranks of no id
        keys = p2 << _WIDE | p1
        at = self.slot(keys)
        f = np.where(self.tags.take(at) == keys, self.slots.take(at), _NONE)
        return e | f & _NONE, (f >> _WIDE) * _CLASSES + (e >> 3 * _WIDE)

    @classmethod
    def of(cls, ids: np.ndarray) -> tuple[Model, np.ndarray]:
        """The model of a frame's ids, and their ranks."""
        if len(ids) and int(ids.max()) < 1 << 22:  # no sort where the ids themselves can be counted
            counts = np.bincount(ids)
            alphabet = np.flatnonzero(counts)
            counts = counts[alphabet]
        else:
            alphabet, counts = np.unique(ids, return_counts=True)
        if len(alphabet) >= _NONE:
            raise ValueError("more than a million distinct ids in a frame")
        logs = np.round(8 * np.log2(np.maximum(counts, 1))).astype(np.int64)
        order = np.lexsort((alphabet, -logs))
        alphabet, logs, counts = alphabet[order].astype(np.int64), logs[order], counts[order]
        if len(ids) and int(alphabet.max()) < 1 << 22:
            place = np.zeros(int(alphabet.max()) + 1, np.int32)
            place[alphabet] = np.arange(len(alphabet))
            ranks = place[ids]
        else:
            sorted_ = np.argsort(alphabet)
            ranks = sorted_[np.searchsorted(alphabet, ids, sorter=sorted_)].astype(np.int32) if len(ids) else np.zeros(0, np.int32)
        none = (np.zeros(0, np.int64),) * 4
        if not len(ids):
            return cls(alphabet, logs, none, none[:3], np.full(_CLASSES**2, int(_SUMS) << 4, np.uint64)), ranks
        cost0 = -np.log2(counts / counts.sum())
        # order 1: a follower is worth its place if it saves more than some 32 bits
        context, total, (f, n), (g, m) = _followers(_pairs(ranks, 1))
        if len(context):
            keep = n * (cost0[f] + np.log2(n / total)) > 32
            g = np.where(m * (cost0[np.minimum(g, len(cost0) - 1)] + np.log2(np.maximum(m, 1) / total)) > 24, g, _NONE)
            one = context[keep], f[keep], g[keep], _class((n + np.where(g != _NONE, m, 0))[keep] / (total[keep] + 1))
        else:
            one = none
        share1 = np.zeros(len(alphabet) + 1)
        first1 = np.full(len(alphabet) + 1, _NONE, np.int64)
        share1[one[0]], first1[one[0]] = (n / total)[keep] if len(context) else 0, one[1]
        # order 2: where it saves more than some 48 bits against order 1 and order 0
        context, total, (f, n), _ = _followers(_pairs(ranks, 2))
        before = context & _NONE
        known = np.where(first1[before] == f, share1[before], 0)
        cost = np.minimum(cost0[f], -np.log2(np.maximum(known, 1e-9)) + 0.3)
        keep = np.flatnonzero(n * (cost + np.log2(n / (total + 1))) > 48)
        two = context[keep], f[keep], _class(n[keep] / (total[keep] + 1))
        # one pair for each slot: the first
        bits = max(8, int(4 * len(keep) + 1).bit_length())
        slot = ((two[0].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)
        alone = np.sort(np.unique(slot, return_index=True)[1])
        model = cls(alphabet, logs, one, tuple(x[alone] for x in two), np.zeros(_CLASSES**2, np.uint64))
        if model.bits != bits:  # fewer pairs, other slots: leave out what now shares one
            while True:
                alone = np.sort(np.unique(model.slot(model.two[0]), return_index=True)[1])
                if len(alone) == len(model.two[0]):
                    break
                model = cls(alphabet, logs, one, tuple(x[alone] for x in model.two), model.prior)
        return model, ranks

    def kinds(self, ranks: np.ndarray):
        """Which order foresees each rank (0: order 2, 1 and 2: order 1, 3: none), the places of its counts, and where its part of
        order 0's interval begins and how wide it is; all of an interval of one where another order foresees it."""
        kind, at, start, part = (np.empty(len(ranks), kind) for kind in (np.uint8, np.uint8, np.uint32, np.uint32))
        cum = self.cum.astype(np.uint32)
        wide = np.diff(cum)
        step = BLOCK * max(1, (1 << 17) // BLOCK)
        for lo in range(0, len(ranks), step):  # whole blocks
            r, here = ranks[lo : lo + step].astype(np.int64), slice(lo, lo + step)
            f, at[here] = self.foreseen(*(_shifted(r, by, len(self.alphabet)) for by in (2, 1)))
            two, one, other = (f >> by & _NONE != r for by in (0, _WIDE, 2 * _WIDE))
            rest = two & one & other
            kind[here] = two.view(np.uint8) + (two & one) + rest
            start[here], part[here] = np.where(rest, cum.take(r), np.uint32(0)), np.where(rest, wide.take(r), np.uint32(1))
        return kind, at, start, part

    def start(self, kind: np.ndarray, at: np.ndarray) -> None:
        """The counts that the mixing of every block starts from: the frame's, scaled down."""
        seen = np.bincount(at.astype(np.int64) * 4 + kind, minlength=4 * _CLASSES**2).reshape(-1, 4).astype(float)
        seen = (seen + 0.25) / (seen.sum(1, keepdims=True) + 1)
        counts = np.maximum(1, np.round(seen * 2000)).astype(np.uint64)
        self.prior = counts[:, 0] | counts[:, 1] << np.uint64(16) | counts[:, 2] << np.uint64(32) | counts[:, 3] << np.uint64(48)

    def dump(self) -> bytes:
        planes = []
        by_id = np.argsort(self.alphabet)
        columns = [np.diff(self.alphabet[by_id], prepend=0), self.logs[by_id], np.diff(self.one[0], prepend=0), *self.one[1:], np.diff(self.two[0] >> _WIDE, prepend=0), self.two[0] & _NONE, *self.two[1:]]
        for c in columns:  # bytes of equal weight together
            planes.append(np.ascontiguousarray(c.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())
        return struct.pack("<III", len(self.alphabet), len(self.one[0]), len(self.two[0])) + zlib.compress(b"".join(planes) + self.prior.astype("<u8").tobytes(), 9)

    @classmethod
    def load(cls, data: bytes) -> Model:
        a, b, c = struct.unpack_from("<III", data)
        flat, at, columns = zlib.decompress(data[12:]), 0, []
        for n in (a, a, b, b, b, b, c, c, c, c):
            columns.append(np.ascontiguousarray(np.frombuffer(flat, np.uint8, 4 * n, at).reshape(4, n).T).view("<u4").ravel().astype(np.int64))
            at += 4 * n
        prior = np.frombuffer(flat, "<u8", _CLASSES**2, at).astype(np.uint64)
        alphabet, logs = np.cumsum(columns[0]), columns[1]
        order = np.lexsort((alphabet, -logs))
        two = np.cumsum(columns[6]) << _WIDE | columns[7]
        return cls(alphabet[order], logs[order], (np.cumsum(columns[2]), *columns[3:6]), (two, *columns[8:10]), prior)


def _fade(mix: np.ndarray) -> None:
    """Halves the counts that have grown large, so that recent ids weigh more and no sum leaves its 16 bits."""
    big = np.flatnonzero((mix * _SUMS) >> np.uint64(48) > np.uint64(12_000))
    mix[big] = (mix[big] >> np.uint64(1) & np.uint64(0x7FFF_7FFF_7FFF_7FFF)) + _SUMS


def _lanes(size: np.ndarray) -> list[int]:
    """How many blocks have an id at each step; sizes must not grow."""
    return np.searchsorted(-size, -np.arange(int(size.max()) if len(size) else 0), side="left").tolist()


def encode(model: Model, ranks: np.ndarray) -> list[bytes]:
    """The coded bytes of each block of a frame's ranks."""
    n = -(-len(ranks) // BLOCK)
    size = np.minimum(BLOCK, len(ranks) - BLOCK * np.arange(n))
    kind, at, start, part = model.kinds(ranks)
    model.start(kind, at)
    steps = int(size.max()) if n else 0
    grid = lambda x: _turned((x if len(x) == n * BLOCK else np.pad(x, (0, n * BLOCK - len(x)))).reshape(n, BLOCK)[:, :steps])
    shift, place, start, part = grid(kind << 4), grid(at), grid(start), grid(part)
    del kind, at
    zero = np.zeros(49, np.uint64)
    zero[48] = _ZERO
    base = np.arange(n) * _CLASSES**2
    mix = np.tile(model.prior, n)
    low, width = np.zeros(n, np.uint64), np.full(n, (1 << 64) - 1, np.uint64)
    # coded words of all blocks as they come, first one in front of each block that takes its last carry; their blocks, and the last of each
    out, of = np.zeros(3 * n + 2 * len(ranks), np.uint64), np.zeros(3 * n + 2 * len(ranks), np.int32)
    of[:n] = last = np.arange(n)
    used = n

    def put(lo, add, w):
        nonlocal used
        lo += add
        over = (lo < add).nonzero()[0]  # a carry into the word before
        if len(over):
            out[last.take(over)] += np.uint64(1)
        short = (w < _HALF).nonzero()[0]
        if len(short):
            part, end = lo.take(short), used + len(short)
            out[used:end], of[used:end] = part >> _WORD, short
            last[short] = np.arange(used, end)
            used = end
            lo[short] = part << _WORD
            w[short] = w.take(short) << _WORD

    for t, m in enumerate(_lanes(size)):
        k = shift[t, :m]
        move = k.astype(np.uint64)
        c = base[:m] + place[t, :m]
        q = mix.take(c)
        sums = q * _SUMS
        own = q >> move & _M16
        lo, w = low[:m], width[:m]
        unit = w // (sums >> np.uint64(48))
        np.multiply(unit, own, out=w)
        put(lo, unit * ((sums - q >> move) & _M16), w)
        mix[c] = q + (np.uint64(_STEP) << move)
        w >>= zero.take(k)
        add = w * start[t, :m]
        w *= part[t, :m]
        put(lo, add, w)
        if t % 64 == 63:
            _fade(mix)
    of = np.concatenate([of[:used], np.repeat(np.arange(n, dtype=np.int32), 2)])
    out = np.concatenate([out[:used], np.stack([low >> _WORD, low & np.uint64(0xFFFFFFFF)], 1).ravel()])
    out = out[np.argsort(of.astype(np.uint16) if n <= 1 << 16 else of, kind="stable")]
    over = np.flatnonzero(out >> _WORD)
    while len(over):  # carries go left
        out[over] &= np.uint64(0xFFFFFFFF)
        out[over - 1] += np.uint64(1)
        over = over[out[over - 1] > 0xFFFFFFFF] - 1
    ends = np.cumsum(np.bincount(of, minlength=n))
    words = out.astype("<u4")
    return [words[a + 1 : b].tobytes() for a, b in zip([0, *ends.tolist()], ends.tolist())]  # noqa: B905


def decode(model: Model, data: list[bytes], size: np.ndarray) -> list[np.ndarray]:
    """The ranks of each block; sizes must not grow."""
    n = len(data)
    if not n:
        return []
    stride = max(map(len, data)) // 4 + 4
    words = np.zeros((n, stride), np.uint32)
    for k, d in enumerate(data):
        words[k, : len(d) // 4] = np.frombuffer(d, "<u4")
    flat = words.ravel()
    code = words[:, 0].astype(np.uint64) << _WORD | words[:, 1]
    width = np.full(n, (1 << 64) - 1, np.uint64)
    pos = np.arange(n) * stride + 2
    base = np.arange(n) * _CLASSES**2
    mix = np.tile(model.prior, n)
    p1, p2 = (np.full(n, len(model.alphabet), np.int64) for _ in range(2))
    out = np.zeros((int(size.max()), n), np.uint32)
    zero, cum, last = np.uint64(_ZERO), model.cum, np.uint64((1 << _ZERO) - 1)
    # the rank at each 65,536th of the order 0 interval: a search begins there
    coarse = (np.searchsorted(cum, np.arange(1 << 16, dtype=np.uint64) << np.uint64(_ZERO - 16), side="right") - 1).astype(np.int32)
    by = np.arange(4) * 16

    def take(c, w, short):
        p = pos.take(short)
        c[short] = c.take(short) << _WORD | flat.take(p, mode="clip")
        pos[short] = p + 1
        w[short] = w.take(short) << _WORD

    for t, m in enumerate(_lanes(size)):
        x, c = model.foreseen(p2[:m], p1[:m])
        c += base[:m]
        q = mix.take(c)
        sums = q * _SUMS
        v, w = code[:m], width[:m]
        unit = w // (sums >> np.uint64(48))
        k = (v >= unit * (sums & _M16)).view(np.uint8) + (v >= unit * (sums >> np.uint64(16) & _M16)) + (v >= unit * (sums >> np.uint64(32) & _M16))
        move = by.take(k).view(np.uint64)
        np.multiply(unit, q >> move & _M16, out=w)
        v -= unit * (sums - q >> move & _M16)
        take(v, w, (w < _HALF).nonzero()[0])
        mix[c] = q + (np.uint64(_STEP) << move)
        x >>= k * np.uint8(_WIDE)
        x &= _NONE
        rest = (k == 3).nonzero()[0]
        if len(rest):
            w, c = width.take(rest) >> zero, code.take(rest)
            v = np.minimum(c // w, last)
            r = coarse.take((v >> np.uint64(_ZERO - 16)).view(np.int64))
            end = cum.take(r + 1, mode="clip")
            far = (end <= v).nonzero()[0]
            if len(far):
                r[far] = found = np.minimum(np.searchsorted(cum, v.take(far), side="right") - 1, len(cum) - 2)
                end[far] = cum.take(found + 1)
            start = cum.take(r)
            c -= w * start
            w *= end - start
            code[rest], width[rest], x[rest] = c, w, r
            take(code, width, rest.take((w < _HALF).nonzero()[0]))
        out[t, :m] = x
        p2[:m], p1[:m] = p1[:m], x
        if t % 64 == 63:
            _fade(mix)
    return [ranks[:m] for ranks, m in zip(_turned(out), size.tolist(), strict=True)]


def frame(lengths: np.ndarray, ids: np.ndarray) -> bytes:
    """A frame of documents' ids: magic, counts, lengths, model, table of blocks (bytes, CRC-32), blocks."""
    model, ranks = Model.of(ids)
    coded = encode(model, ranks)
    index = zlib.compress(lengths.astype("<u4").tobytes(), 1)
    held = model.dump()
    crc = [zlib.crc32(ids[i : i + BLOCK].astype("<u4")) for i in range(0, len(ids), BLOCK)]
    head = np.array([(len(c), x) for c, x in zip(coded, crc, strict=True)], "<u4").reshape(-1, 2)
    return b"".join([_MAGIC, struct.pack("<IIQII", len(lengths), len(coded), len(ids), len(index), len(held)), index, held, head.tobytes(), *coded])


def unframe(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """lengths and ids of a frame; raises if a block isn't what was written."""
    if data[:4] != _MAGIC:
        raise ValueError("not a frame")
    docs, blocks, total, size, held = struct.unpack_from("<IIQII", data, 4)
    at = 28
    index = zlib.decompress(data[at : at + size])
    model = Model.load(data[at + size : at + size + held])
    at += size + held
    head = np.frombuffer(data, "<u4", blocks * 2, at).reshape(-1, 2).astype(np.int64)
    ends = at + blocks * 8 + np.cumsum(head[:, 0])
    coded = [data[e - b : e] for e, b in zip(ends.tolist(), head[:, 0].tolist(), strict=True)]
    sizes = np.minimum(BLOCK, total - BLOCK * np.arange(blocks))
    ids = np.zeros(total, np.uint32)
    for lo in range(0, blocks, LANES):
        for k, ranks in enumerate(decode(model, coded[lo : lo + LANES], sizes[lo : lo + LANES]), lo):
            found = ids[BLOCK * k : BLOCK * k + len(ranks)]
            found[:] = model.alphabet.take(ranks, mode="clip")
            if zlib.crc32(found) != head[k, 1]:
                raise ValueError(f"block {k} is damaged")
    return np.frombuffer(index, "<u4", docs).astype(np.int64), ids


class Merges:
    """The merges of a byte-pair model over many words at once: in each round every word that is not done makes its best
    merge, the leftmost of equals, as it would alone."""

    def __init__(self, model: dict):
        self.vocab, self.suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        if model.get("continuing_subword_prefix") or model.get("dropout"):
            raise ValueError("not a model of plain merges")
        pairs = [m if isinstance(m, list) else m.split(" ", 1) for m in model["merges"]]
        ids = np.array([(self.vocab[a], self.vocab[b], self.vocab[a + b]) for a, b in pairs], np.int64).reshape(-1, 3)
        keys = ids[:, 0] << 32 | ids[:, 1]
        self.bits = max(10, (8 * len(keys)).bit_length())
        self.keys, self.rank, self.made_by = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int64), ids[:, 2].copy()
        left, slot = np.arange(len(keys)), self._slot(keys)
        while len(left):  # the next free slot for what finds its own taken
            free = self.keys[slot] == -1
            _, first = np.unique(np.where(free, slot, -1 - np.arange(len(slot))), return_index=True)
            first = first[free[first]]
            at, k = slot[first], left[first]
            self.keys[at], self.rank[at] = keys[k], k
            rest = np.ones(len(left), bool)
            rest[first] = False
            left, slot = left[rest], (slot[rest] + 1) & (1 << self.bits) - 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each pair, -1 if it is no merge."""
        slot = self._slot(keys)
        out = np.where(self.keys.take(slot) == keys, slot, -1)
        open_ = np.flatnonzero((out < 0) & (self.keys.take(slot) >= 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & (1 << self.bits) - 1
            there = self.keys.take(slot[open_])
            hit = there == keys[open_]
            out[open_[hit]] = slot[open_[hit]]
            open_ = open_[~hit & (there >= 0)]
        return out

    def run(self, symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols left of each word (given one word after the other, with their sizes, at most ``_LONG``), and the new sizes."""
        begin, counts = np.cumsum(sizes) - sizes, np.zeros(len(sizes), np.int64)
        parts, units = [], []
        for low, high in pairwise((0, *_WIDTHS)):  # words of similar sizes together
            unit = np.flatnonzero((sizes > low) & (sizes <= high))
            for k in range(0, len(unit), _TOGETHER):
                u = unit[k : k + _TOGETHER]
                part, counts[u] = self._columns(symbols, begin[u], sizes[u], high)
                parts.append(part)
                units.append(u)
        if not parts:
            return np.zeros(0, np.int64), counts
        unit = np.concatenate(units)
        held = counts[unit]
        out = np.empty(int(held.sum()), np.int64)
        out[np.repeat((np.cumsum(counts) - counts)[unit] - np.cumsum(held) + held, held) + np.arange(len(out))] = np.concatenate(parts)
        return out, counts

    def _columns(self, symbols: np.ndarray, begin: np.ndarray, sizes: np.ndarray, high: int) -> tuple[np.ndarray, np.ndarray]:
        """run() for words of at most ``high`` symbols, each a column: a row for each place and one of no symbol behind. A place
        knows the places of the symbols left before and behind it, and the rank of the pair that begins there."""
        n, none = np.int64(len(begin)), (1 << 31) - 1
        row = np.arange(high + 1)[:, None]
        held = np.where(row < sizes, symbols.take(np.minimum(begin + row, len(symbols) - 1)), none)
        order = np.full((high + 1, n), _NEVER)
        order[:-1] = self._order(held[:-1].ravel(), held[1:].ravel(), np.repeat(np.arange(high), n)).reshape(high, n)
        before, behind = np.repeat((row - 1).astype(np.int8), n, 1), np.repeat((row + 1).astype(np.int8), n, 1)
        before[0] = high
        held, order, before, behind = (x.ravel() for x in (held, order, before, behind))
        column = np.arange(n)
        while len(column):
            best = order.reshape(high + 1, n)[:high].min(0) if len(column) == n else order.reshape(high + 1, n)[:high].take(column, 1).min(0)
            more = (best != _NEVER).nonzero()[0]
            column, best = column.take(more), best.take(more)
            place = best & 63
            at, made = place * n + column, self.made_by.take(best >> 6)
            gone = behind.take(at) * n + column
            after = behind.take(gone)
            held[at], held[gone], order[gone] = made, none, _NEVER
            behind[at] = after
            far = after * n + column
            before[far] = place
            order[at] = self._order(made, held.take(far), place)
            place = before.take(at).astype(np.int64)
            near = place * n + column
            order[near] = np.where(place == high, _NEVER, self._order(held.take(near), made, place))
        held = held.reshape(high + 1, n)[:high].T
        left = held != none
        return held[left], left.sum(1)

    def _order(self, left: np.ndarray, right: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Which pair comes first: by its merge, then by its place; none if it is no merge."""
        slot = self.find(left << 32 | right)
        return np.where(slot >= 0, self.rank.take(slot) << 6 | place, _NEVER)


#: Bytes of a word that merges run over; longer words are the library's. Rows of columns of words, and how many at a time.
_LONG, _TOGETHER = 48, 1 << 14
_WIDTHS = (1, 4, 6, 8, 10, 12, 16, 24, _LONG)
_NEVER = 1 << 62
_LETTER = np.array([65 <= b <= 90 or 97 <= b <= 122 for b in range(256)])
_DIGIT = np.array([48 <= b <= 57 for b in range(256)])
#: Printable ASCII but what may begin a contraction or a token of its own.
_MARK = np.array([33 <= b <= 126 and chr(b) not in "'<" for b in range(256)]) & ~_LETTER & ~_DIGIT
#: Second bytes of the letters from U+00C0 to U+00FF.
_SECOND = np.array([0x80 <= b <= 0xBF and b not in (0x97, 0xB7) for b in range(256)])


class Encoder:
    """Ids of texts under a tokenizer that drops white space: those of the parts between it, one after the other. Simple
    words (letters to U+00FF, digits and marks), which every step of the tokenizer leaves whole but for case, or cuts into
    runs of letters, runs of marks, and digits, are encoded by the merges alone, many at a time; all others by the library."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        # every kind of ASCII white space must part words and leave no id
        for c in " \t\n\x0b\f\r":
            if self.model.encode(f"a{c}b{c}", add_special_tokens=False).ids != self.model.encode("a b", add_special_tokens=False).ids:
                raise ValueError("this tokenizer keeps white space")
        self._forget()
        self.short = False
        sample = ["Wort,", "\u00c9t\u00e9!!", "na\u00efve", "ABC.", "stra\u00dfe;:", "a", "\u00ff?", "The", "internationalisation...", "x86_64", "(a+b)|2024--", "``q\"s\"", "\u00c0B\u00e9#$%&*/=>@[\\]^{}~"]
        try:
            self._prepare()
            simple, ids, counts = self._merged(pa.array(sample).cast(pa.binary()))
            ends = np.cumsum(counts)
            found = [ids[e - n : e].tolist() for e, n in zip(ends, counts, strict=True)]
            # if a sample differs, the short way is shut
            self.short = simple.all() and found == [self.model.encode(w, add_special_tokens=False).ids for w in sample]
        except (KeyError, ValueError, TypeError, AttributeError):
            pass

    def _prepare(self) -> None:
        self.merges = Merges(json.loads(self.model.to_str())["model"])
        shown = {b: self.model.pre_tokenizer.pre_tokenize_str(chr(b))[0][0] for b in range(33, 127)}
        for c in range(0xC0, 0x100):
            if c not in (0xD7, 0xF7):
                shown.update(zip(chr(c).encode(), self.model.pre_tokenizer.pre_tokenize_str(chr(c))[0][0], strict=True))
        self.inner, self.final = np.full(256, -1, np.int64), np.full(256, -1, np.int64)
        for b, c in shown.items():
            self.inner[b], self.final[b] = self.merges.vocab[c], self.merges.vocab[c + self.merges.suffix]

    def _merged(self, words: pa.BinaryArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which words are simple, and the ids of these, one word after the other, with their numbers."""
        ends = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
        data = np.frombuffer(words.buffers()[2], np.uint8)[ends[0] : ends[-1]]
        sizes, starts = np.diff(ends), ends[:-1] - ends[0]
        head = np.zeros(len(data), bool)
        head[starts] = True
        second = (np.roll(data, 1) == 0xC3) & ~head & _SECOND[data]
        letter = _LETTER[data] | second | (data == 0xC3) & _SECOND[np.roll(data, -1)] & ~np.roll(head, -1)
        mark, digit = _MARK[data], _DIGIT[data]
        simple = np.logical_and.reduceat(letter | mark | digit, starts) & (sizes <= _LONG)
        use = np.repeat(simple, sizes)
        low = (data + np.where((data >= 65) & (data <= 90) | second & (data < 0x9F), np.uint8(32), np.uint8(0)))[use]
        mark, digit, head = mark[use], digit[use], head[use]
        # a word's units: its runs of letters or of marks, and its digits
        begin = np.flatnonzero(head | digit | np.roll(digit, 1) | (mark != np.roll(mark, 1)))
        units = np.diff(np.append(begin, len(low)))
        symbols = self.inner[low]
        if not len(units):
            return simple, np.zeros(0, np.int64), np.zeros(0, np.int64)
        last = begin + units - 1
        symbols[last] = self.final[low[last]]
        ids, counts = self.merges.run(symbols, units)
        return simple, ids, np.add.reduceat(counts, np.flatnonzero(head[begin]))

    def _forget(self) -> None:
        """No words known; else, by the number of a word: where its ids are and how many."""
        self.known = pa.array([b""], pa.binary())
        self.begin, self.count, self.flat, self.used = np.zeros(1 << 12, np.int32), np.zeros(1 << 12, np.int32), np.zeros(1 << 14, np.uint32), 0

    def _learn(self, words: pa.BinaryArray) -> None:
        """Encodes words that aren't known: their numbers follow."""
        simple, ids, counts = self._merged(words) if self.short else (np.zeros(len(words), bool), np.zeros(0, np.int64), np.zeros(0, np.int64))
        hard = np.flatnonzero(~simple)
        found = [e.ids for e in self.model.encode_batch_fast([w.decode() for w in raw(words.take(pa.array(hard)))], add_special_tokens=False)]
        ids = np.concatenate([ids, np.array([i for x in found for i in x], np.int64)]).astype(np.uint32)
        counts = np.concatenate([counts, np.array([len(x) for x in found], np.int64)])
        first, last = len(self.known), len(self.known) + len(counts)
        if last > len(self.begin):
            grow = max(last, 2 * len(self.begin))
            self.begin, self.count = (np.resize(x, grow) for x in (self.begin, self.count))
        if self.used + len(ids) > len(self.flat):
            self.flat = np.resize(self.flat, max(self.used + len(ids), 2 * len(self.flat)))
        number = first + np.concatenate([np.flatnonzero(simple), hard])
        self.begin[number], self.count[number] = self.used + np.cumsum(counts) - counts, counts
        self.flat[self.used : self.used + len(ids)] = ids
        self.used += len(ids)

    def ids(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """The ids of an Arrow column of texts, one text after the other, and how many each text has."""
        import pyarrow.compute as pc

        parts = pc.ascii_split_whitespace(texts)
        if len(self.known) > KEPT or self.used > 8 * KEPT:
            self._forget()
        # numbered behind the known words, which keep their numbers
        words = pa.chunked_array([self.known, pc.list_flatten(parts).cast(pa.binary())]).dictionary_encode().chunk(1)
        if len(words.dictionary) > len(self.known):
            self._learn(words.dictionary.slice(len(self.known)))
            self.known = words.dictionary
        at = words.indices.to_numpy()
        n = self.count.take(at)
        ends = np.cumsum(n, dtype=np.int32)  # a slice has far fewer ids than 2**31
        out = self.flat.take(np.arange(ends[-1] if len(ends) else 0, dtype=np.int32) + np.repeat(self.begin.take(at) - ends + n, n))
        upto = np.concatenate([[0], ends]).astype(np.int64)[np.cumsum(pc.list_value_length(parts).to_numpy())]
        return out, np.diff(upto, prepend=0)


@lru_cache(maxsize=1)
def _encoder(path: str) -> Encoder:
    """One for each worker, with the words that it has met, whatever the number of its tasks."""
    return Encoder(path)


def _slices(batches, size: int):
    """Rows of about so many bytes of text at a time."""
    for batch in batches:
        lengths = np.cumsum(np.array(batch.column("n")))
        lo = 0
        while lo < batch.num_rows:
            before = lengths[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(lengths, before + size, side="right")))
            yield batch.slice(lo, hi - lo)
            lo = hi


def _writer(path: str, most: int):
    def run(batches):
        from pyspark import TaskContext

        part, encoder = TaskContext.get().partitionId(), _encoder(path)
        keys, lengths, ids, held, number = [], [], [], 0, 0

        def flush():
            data = frame(np.concatenate(lengths), np.concatenate(ids))
            names = pa.concat_arrays(keys)
            ends = pa.array([0, len(names)], pa.int32())
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([held], pa.int64()), pa.ListArray.from_arrays(ends, names), pa.array([data], pa.binary())], names=["part", "frame", "n_tokens", "doc_ids", "data"])

        for rows in _slices(batches, CHUNK):
            bare, counts = encoder.ids(rows.column("t"))
            lens = counts + 1
            ends = np.cumsum(lens)
            found = np.empty(len(bare) + len(lens), np.uint32)
            place = np.ones(len(found), bool)
            place[ends - 1] = False
            found[place], found[ends - 1] = bare, END
            lo = 0
            while lo < len(lens):  # frames end between documents
                before = int(ends[lo - 1]) if lo else 0
                hi = int(np.searchsorted(ends, before + most - held, side="right"))
                if hi == lo and not held:
                    hi = lo + 1
                if hi > lo:
                    keys.append(rows.column("id").slice(lo, hi - lo))
                    lengths.append(lens[lo:hi])
                    ids.append(found[before : ends[hi - 1]])
                    held += int(ends[hi - 1]) - before
                if hi < len(lens):
                    yield flush()
                    keys, lengths, ids, held, number = [], [], [], 0, number + 1
                lo = hi
        if held:
            yield flush()

    return run


def write(docs: DataFrame, tokenizer: str, *, doc_id="doc_id", text="text", part: int = PART, least: int = LEAST) -> str:
    """Writes the store and returns its path: one file per range of document ids, frames in order within it."""
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    rows = rows.withColumn("n", F.octet_length("t").cast("long"))
    size = rows.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    n = max(1, -(-size // part), min(-(-size // least), 4 * spark.sparkContext.defaultParallelism))
    # the beginnings of texts part a hot id, in the order of the texts
    dealt = rows.repartitionByRange(n, F.col("id"), F.substring("t", 1, 32)).sortWithinPartitions("id", "t")
    path = f"{shared_dir(spark)}/lexforge/token-store-{uuid.uuid4().hex}"
    kind = docs.schema[doc_id].dataType.simpleString()
    dealt.mapInArrow(_writer(tokenizer, BLOCK * LANES), f"part int, frame int, n_tokens long, doc_ids array<{kind}>, data binary").write.parquet(path)
    return path


def _reader(batches):
    for batch in batches:
        for k in range(batch.num_rows):
            lengths, ids = unframe(batch.column("data")[k].as_py())
            ends = np.cumsum(lengths)
            starts = ends - lengths
            crc = [zlib.crc32(ids[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
            same = lambda name: pa.array(np.full(len(lengths), batch.column(name)[k].as_py()), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("doc_ids")[k].values, pa.array(starts), pa.array(lengths), pa.array(crc, pa.int64()), same("part"), same("frame")], names=["doc_id", "local", "n_tokens", "ids_crc32", "part", "frame"])


def _ids(batches):
    for batch in batches:
        for k, data in enumerate(batch.column("data").to_pylist()):
            lengths, ids = unframe(data)
            ends = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("doc_ids")[k].values, pa.ListArray.from_arrays(pa.array(ends), pa.array(ids.astype(np.int64)))], names=["doc_id", "ids"])


def _kind(store: DataFrame) -> str:
    return store.schema["doc_ids"].dataType.elementType.simpleString()


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id and ids (with the end id) of every document of a store."""
    store = spark.read.parquet(path)
    return store.select("doc_ids", "data").mapInArrow(_ids, f"doc_id {_kind(store)}, ids array<long>")


def digest(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from a store's files."""
    store = spark.read.parquet(path)
    # one row per frame: sums within a part, then over parts
    parts = store.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select(F.col("part").alias("of"), before.alias("before"))
    within = F.coalesce(F.sum("n_tokens").over(Window.partitionBy("part").orderBy("frame").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    frames = store.select("part", "frame", within.alias("within")).join(parts, F.col("part") == F.col("of"))
    offsets = written(frames.select(F.col("part").alias("p"), F.col("frame").alias("f"), (F.col("before") + F.col("within")).alias("offset")), "token-offsets")
    rows = store.select("part", "frame", "doc_ids", "data").mapInArrow(_reader, f"doc_id {_kind(store)}, local long, n_tokens long, ids_crc32 long, part int, frame int")
    rows = rows.join(offsets, (F.col("part") == F.col("p")) & (F.col("frame") == F.col("f")))
    return rows.select("doc_id", (F.col("offset") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")
