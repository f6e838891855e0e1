"""N-gram Jaccard join: documents whose sets of word shingles have a Jaccard similarity of at least ``percent`` %.

Jaccard distance is a metric, but documents that share nothing all lie at distance 1 from each other, so no pivot
tells them apart and no window would leave any of them out. The regions are therefore found in two steps.

1. Seeds. Equal sets are one node. Shingles are dealt by hash into classes, a few more than two linked sets of that
size may differ by, so some classes of two linked sets are equal. (band of sizes, class, its shingles) are keys; sets
at the rim of a band, whose partners may lie in the band below, have keys in both. Nodes that share too few keys with
any other node to have a link are dropped, and the rest fall into regions: connected by keys.

2. Regions are joined exactly as a metric space. Pivots get the exact distance to all members. Members within the limit
are linked to the pivot. Each member but the pivots belongs to its nearest pivot's Voronoi cell and is replicated to every
cell whose pivot is at most twice the limit farther: by the triangle inequality each link then lies within a cell. Members
that share nothing with any pivot form a cell of their own, with a window of one limit. Cells are regions in turn. Where
pivots don't part a region, its members are one component but for some; these are compared with all members that the
windows of all pivots leave.

A region of up to ``REGION`` sets and ``SHINGLES`` shingles is joined so by one task (``Region``). A larger one is joined by
the same steps as tables: pivots are dealt to all parts of their region, distances are one row of work for each member,
and cells are tables of the next round, until they fit a task (``_distributed``). What ``ROUNDS`` rounds leave whole is dealt into
blocks, and every block of members outside the largest component meets every block in a task of its own: no link is lost,
and members of one component never meet. Links are kept as component labels, one row for a document, never as pairs.

Cases. Shingles and sets stand as 64-bit hashes. A null or empty text has an empty set and is linked with nothing; one with
fewer words than a shingle has its whole sequence as its only shingle. Null ids count as one smallest id. Repeated rows and
exact copies are one node. A similarity of just the limit links (ties). A text of any length is one row whose set is an
array in memory. Ids that aren't whole numbers are numbered in their own order first. Empty tables give empty results.
Columns may have any names: only id and text are read, and ``representatives`` carries rows in a struct.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WHOLE, numbered, raw, restored, written

#: Bounds of a region that one task joins; the documents parsed at a time, in bytes; word hashes that a worker keeps.
REGION, SHINGLES, BLOCK, KEPT = 20_000, 8_000_000, 1 << 20, 300_000
#: Members of regions that may be sent to all executors, at 24 bytes each.
SENT = 200_000
#: Pivots of a region or cell, and rounds of distributed pivots.
PIVOTS, ROUNDS = 8, 4
#: Places that the rows of one id are dealt out to.
APART = 4096
NULL_ID = -(1 << 63)
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


class Words(dict):
    """64-bit hashes of words."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= KEPT:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word)
        return found


def shingled(texts: list[bytes], width: int, known: Words) -> tuple[np.ndarray, np.ndarray]:
    """(text, shingle) of the distinct shingles of each text, sorted by both."""
    lists = [t.lower().split() for t in texts]  # of bytes: ASCII letters and white space only
    n = np.array(list(map(len, lists)), np.int64)
    total = int(n.sum())
    if not total:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = np.fromiter((known[w] for ws in lists for w in ws), np.uint64, total)
    text = np.repeat(np.arange(len(texts)), n)
    left = np.repeat(np.cumsum(n), n) - np.arange(total)  # words from here to the text's end
    value = np.zeros(total, np.uint64)
    size = np.minimum(width, np.repeat(n, n))
    for k in range(width):
        there = np.flatnonzero((k < size) & (left > k))
        value[there] = mixed(value[there] * _A + h[there + k] + _B)
    starts = np.flatnonzero(left >= size)
    value, text = mixed(value[starts] + size[starts].astype(np.uint64)), text[starts]
    order = np.lexsort((value, text))
    value, text = value[order], text[order]
    new = np.concatenate([[True], (value[1:] != value[:-1]) | (text[1:] != text[:-1])])
    return text[new], value[new]


def fingerprints(text: np.ndarray, value: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Number of shingles and 64-bit fingerprint of each set."""
    n = np.bincount(text, minlength=count)
    one, two = _sums(text, value, count), _sums(text, mixed(value ^ _B), count)
    return n, mixed(one * _A + mixed(two + n.astype(np.uint64)))


def _sums(slot, value, count) -> np.ndarray:
    """Sums modulo 2**64 by slot; the halves add up exactly as doubles."""
    low = np.bincount(slot, (value & np.uint64(0xFFFFFFFF)).astype(np.float64), count).astype(np.uint64)
    high = np.bincount(slot, (value >> np.uint64(32)).astype(np.float64), count).astype(np.uint64)
    return low + (high << np.uint64(32))


class Bands:
    """Bands of set sizes, and the classes that shingles are dealt into in each."""

    def __init__(self, percent: int, most: int = 1 << 31):
        s = percent / 100
        slack = max(0.25, 4 * np.exp(-s / (1 - s) / 1.5))
        edges, classes, differ = [1], [], []
        while edges[-1] < most:
            lo = edges[-1]
            hi = max(lo + 1, -(-lo * 3 // 2))
            d = (hi - 1) * (100 - percent) // percent  # linked sets, the smaller below hi, differ by that much at most
            edges.append(hi)
            differ.append(d)
            classes.append(d + 1 + int(np.ceil(slack * d)) if d else 0)
        self.edges, self.classes, self.differ, self.percent = np.array(edges), np.array(classes), np.array(differ), percent

    def of(self, n: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.edges, n, side="right") - 1

    def below(self, n: np.ndarray) -> np.ndarray:
        """Whether sets of n may be linked with smaller ones of the band below."""
        b = self.of(n)
        return (b > 0) & (n * self.percent <= (self.edges[b] - 1) * 100)


def seeds(text, value, n, nodes, bands: Bands):
    """(key, node, need) rows, of some text's set each: the classes of each set; need: keys that it shares with some other if it has a link."""
    out = []
    band = bands.of(np.maximum(n, 1))
    for shift, chosen in ((0, n > 0), (1, bands.below(n) & (n > 0))):
        b = np.maximum(band - shift, 0)
        k = np.where(chosen, bands.classes[b], 0)  # none where linked sets can't differ
        first = np.cumsum(k) - k
        total = int(k.sum())
        if not total:
            continue
        use = np.flatnonzero(k[text] > 0)
        t, v = text[use], value[use]
        slot = first[t] + (mixed(v ^ _A) % k[t].astype(np.uint64)).astype(np.int64)
        sums, size = _sums(slot, v, total), np.bincount(slot, minlength=total)
        owner = np.repeat(np.arange(len(n)), k)
        cls = np.arange(total) - first[owner]
        empty = np.bincount(owner, size == 0, len(n)).astype(np.int64)
        spare = k - bands.differ[b]  # classes that no difference hits, at least
        need = np.maximum(1, spare - empty)
        # empty classes are keys only of sets that may have no other class in common
        rows = np.flatnonzero((size > 0) | (empty >= spare)[owner])
        o = owner[rows]
        where = b[o].astype(np.uint64) * np.uint64(1 << 32) + cls[rows].astype(np.uint64)
        key = mixed(mixed(sums[rows] + size[rows].astype(np.uint64)) ^ (where * _A))
        out.append((key, nodes[o], np.where(empty[o] >= spare[o], 1, need[o]) * 256 + b[o]))
    return out


def windows(far: np.ndarray, limit: float) -> list[np.ndarray]:
    """The members of each pivot's cell, of their distances to all pivots, and last those that are far from every pivot."""
    least, tiny = far.min(1, initial=1.0), 1e-9
    cells = [np.flatnonzero((far[:, p] <= least + 2 * limit + tiny) & (least < 1)) for p in range(far.shape[1])]
    return [*cells, np.flatnonzero(least >= 1 - limit - tiny)]


class Region:
    """Sets of one region, joined in memory."""

    def __init__(self, sets: list[np.ndarray], percent: int):
        self.m, self.percent, self.limit = len(sets), percent, 1 - percent / 100
        self.size = np.array([len(s) for s in sets], np.int64)
        self.begin = np.cumsum(self.size) - self.size
        flat = np.concatenate(sets)
        _, self.column = np.unique(flat, return_inverse=True)
        owner = np.repeat(np.arange(self.m), self.size)
        self.rows = owner[np.argsort(self.column, kind="stable")]
        ends = np.cumsum(np.bincount(self.column))
        self.ends, self.starts = ends, np.concatenate([[0], ends[:-1]])
        self.label = np.arange(self.m)
        self.pivots = 0

    def shared(self, x: int) -> np.ndarray:
        """Size of the intersection of x with every set."""
        cols = self.column[self.begin[x] : self.begin[x] + self.size[x]]
        n = self.ends[cols] - self.starts[cols]
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.starts[cols], n)
        return np.bincount(self.rows[at], minlength=self.m)

    def compare(self, x: int, members: np.ndarray) -> np.ndarray:
        """Distances of x to members; those within the limit get its label."""
        both = self.shared(x)[members]
        union = self.size[x] + self.size[members] - both
        near = members[100 * both >= self.percent * union]
        for old in np.unique(self.label[near]):
            if old != self.label[x]:
                self.label[self.label == old] = self.label[x]
        return 1 - both / union

    def solve(self, members: np.ndarray) -> None:
        if len(members) < 2 or (self.label[members] == self.label[members[0]]).all():
            return
        at = np.unique(np.linspace(0, len(members) - 1, PIVOTS).astype(int))
        self.pivots += len(at)
        far = np.stack([self.compare(members[p], members) for p in at], 1)
        rest = np.delete(np.arange(len(members)), at)  # pivots are compared with all members
        cells = [rest[cell] for cell in windows(far[rest], self.limit)]
        if sum(map(len, cells)) > 2 * len(members):
            return self.sweep(members[rest], far[rest])
        for cell in cells:
            self.solve(members[cell])

    def sweep(self, members: np.ndarray, far: np.ndarray) -> None:
        """Compares members outside the largest component until every two members are compared, linked by others, or
        kept apart by a pivot's window."""
        if not len(members):
            return
        done = np.zeros(len(members), bool)
        while True:
            labels = self.label[members]
            values, counts = np.unique(labels, return_counts=True)
            todo = np.flatnonzero((labels != values[counts.argmax()]) & ~done)
            if not len(todo):
                return
            for i in todo:
                x = members[i]
                done[i] = True
                other = self.label[members] != self.label[x]
                fits = (self.percent * self.size[members] <= 100 * self.size[x]) & (self.percent * self.size[x] <= 100 * self.size[members])
                fits &= (np.abs(far - far[i]) <= self.limit + 1e-9).all(1)
                if (other & fits).any():
                    self.compare(x, members)


def link(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Component label of each set."""
    region = Region(sets, percent)
    region.solve(np.arange(region.m))
    return region.label


def _texts(batches, size: int):
    for batch in batches:
        texts = [t or b"" for t in raw(batch.column("t"))]
        lo = used = 0
        for i, t in enumerate(texts):
            used += len(t)
            if used >= size or i == len(texts) - 1:
                yield batch.slice(lo, i + 1 - lo), texts[lo : i + 1]
                lo, used = i + 1, 0


def _parsed(width: int, percent: int):
    """Of each text a row of its own (p, key: its id, node, need: the number of its shingles, h), and the keys of its set,
    if no text of the block before it has the same (key, node, need)."""

    def run(batches):
        known, bands = Words(), Bands(percent)
        for part, texts in _texts(batches, BLOCK):
            text, value = shingled(texts, width, known)
            n, node = fingerprints(text, value, len(texts))
            yield _rows(True, part.column("id"), node, n, part.column("h"))
            _, first = np.unique(node, return_index=True)
            only = np.zeros(len(texts), bool)
            only[first] = True
            here = only[text]
            for key, nodes, need in seeds(text[here], value[here], np.where(only, n, 0), node, bands):
                yield _rows(False, pa.array(key.view(np.int64)), nodes, need, None)

    return run


def _rows(own: bool, key, node, need, h) -> pa.RecordBatch:
    h = pa.array(np.zeros(len(node), np.int64)) if h is None else h
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(node), own)), key, pa.array(node.view(np.int64)), pa.array(need.astype(np.int64)), h], names=["p", "key", "node", "need", "h"])


def _sets(width: int):
    """The sets of the nodes that are asked for: part, node, bytes."""

    def run(batches):
        known = Words()
        for part, texts in _texts(batches, BLOCK):
            text, value = shingled(texts, width, known)
            n, node = fingerprints(text, value, len(texts))
            ends = np.cumsum(n)
            asked = part.column("node").to_numpy()
            rows = [(i, value[ends[i] - n[i] : ends[i]].tobytes()) for i in np.flatnonzero(node.view(np.int64) == asked)]
            if rows:
                at = pa.array([i for i, _ in rows])
                yield pa.RecordBatch.from_arrays([part.column("region").take(at), part.column("node").take(at), pa.array([b for _, b in rows], pa.binary())], names=["region", "node", "set"])

    return run


def _linker(percent: int):
    """Rows sorted by part, one part after the other: node and label of its component within the part."""

    def run(batches):
        now, nodes, sets = None, [], []

        def flush():
            if len(nodes) > 1:
                label = link(sets, percent)
                ids = np.array(nodes, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), now)), pa.array(ids[label]), pa.array(ids)], names=["part", "label", "node"])

        for batch in batches:
            for p, node, data in zip(batch.column("part").to_pylist(), batch.column("node").to_pylist(), batch.column("set").to_pylist(), strict=True):
                if p != now:
                    yield from flush()
                    now, nodes, sets = p, [], []
                if not nodes or nodes[-1] != node:
                    nodes.append(node)
                    sets.append(np.frombuffer(data, np.uint64))
        yield from flush()

    return run


def components(edges: DataFrame) -> DataFrame:
    """node, label (a node of its component, the same for all) over edges (a, b); an edge of a node to itself is one.

    Each round points every node to the least of itself and its neighbours, goes on to where that one points, and
    contracts the graph to the nodes that were pointed to. So edges get fewer from round to round. What a round leaves
    is written, and the lineage stays short."""
    edges = written(edges.select("a", "b").distinct(), "jaccard-edges")
    labels = written(edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().select("node", F.col("node").alias("label")), "jaccard-labels")
    edges = edges.where("a != b")
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("v"), F.least("a", "b").alias("to"))
        least = written(least, "jaccard-least")
        onward = least.join(least.toDF("w", "further"), F.col("to") == F.col("w"), "left").select("v", F.coalesce("further", "to").alias("to"))
        onward = written(onward, "jaccard-onward")
        found = labels.join(onward, F.col("label") == F.col("v"), "left")
        labels = written(found.select("node", F.coalesce("to", "label").alias("label")), "jaccard-labels")
        left, right = onward.toDF("va", "ta"), onward.toDF("vb", "tb")
        left_over = edges.join(left, F.col("a") == F.col("va")).join(right, F.col("b") == F.col("vb")).where("ta != tb")
        edges = written(left_over.select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct(), "jaccard-edges")
    return labels


def join(docs: DataFrame, *, doc_id="doc_id", text="text", width: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: id (null ids as NULL_ID), n_shingles, node (its set's fingerprint), component_id (the
    smallest id reachable by links). Ids are whole numbers here; ``report`` takes any."""
    return _joined(docs, doc_id, text, width, percent).select("id", F.col("n").alias("n_shingles"), "node", F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("component")).alias("component_id"))


def _key(doc_id: str):
    return F.coalesce(F.col(doc_id).cast("long"), F.lit(NULL_ID))


def _hash(text: str):
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _met(rows: DataFrame) -> DataFrame:
    """Rows of keys with two nodes or more, with the key's least node: extremes are partial sums, a hot key is one of them."""
    found = rows.groupBy("key").agg(F.min("node").alias("least"), F.max("node").alias("most")).where("least != most")
    return rows.join(found.select(F.col("key").alias("of"), "least"), F.col("key") == F.col("of")).drop("of")


def _joined(docs: DataFrame, doc_id: str, text: str, width: int, percent: int) -> DataFrame:
    """id, h (its text's hash), n, node, component and the component's label of each document."""
    spark = docs.sparkSession
    texts = docs.select(_key(doc_id).alias("id"), _hash(text).alias("h"), F.col(text).alias("t"))
    # texts are parsed once: documents and keys leave in one shuffle and are told apart behind it
    parsed = texts.mapInArrow(_parsed(width, percent), "p boolean, key long, node long, need long, h long")
    # a document's row needs no others: those of one id, as all without one, are dealt out by their place
    parsed = parsed.withColumn("apart", F.when(F.col("p"), F.monotonically_increasing_id() % APART))
    same = Window.partitionBy("p", "key", "apart")
    met = parsed.repartition("p", "key", "apart").withColumn("least", F.min("node").over(same)).withColumn("most", F.max("node").over(same))
    both = written(met.where("p or least != most").select("key", "node", "need", "h", "p"), "jaccard-parsed", by="p")
    prints = both.where("p").select(F.col("key").alias("id"), "h", F.col("need").alias("n"), "node")
    rows = written(both.where("not p").select("key", "node", "need").distinct(), "jaccard-keys")
    for _ in range(2):  # nodes with too few keys in common go, and then keys with a single node
        enough = rows.select("key", "node", "need").withColumn("has", F.count(F.lit(1)).over(Window.partitionBy("node", "need"))).where("has >= shiftright(need, 8)")
        rows = _met(enough.drop("has"))
    # linked nodes share many keys: a key's nodes hang on its least node, and equal links are one
    regions = components(rows.select(F.col("least").alias("a"), F.col("node").alias("b")))

    one = prints.groupBy("node").agg(F.min("id").alias("id"), F.min("n").alias("n"))
    members = written(regions.join(one, "node").select("node", "id", "n", F.col("label").alias("region")), "jaccard-members")
    sizes = members.groupBy("region").agg(F.count("*").alias("m"), F.sum("n").alias("total"))
    large = written(sizes.where(_too_large()).select("region"), "jaccard-large")

    def sets_of(wanted: DataFrame) -> DataFrame:
        wanted = wanted.select("id", "node", "region")
        if wanted.count() <= SENT:  # else the texts are shuffled
            wanted = F.broadcast(wanted)
        return texts.select("id", "t").join(wanted, "id").select("t", "node", "region").mapInArrow(_sets(width), "region long, node long, set binary")

    def linked_of(parts: DataFrame) -> DataFrame:
        dealt = parts.select("part", "node", "set").repartition("part").sortWithinPartitions("part", "node")
        return dealt.mapInArrow(_linker(percent), "part long, label long, node long").select("label", "node")

    small = sets_of(members.join(large, "region", "left_anti")).withColumnRenamed("region", "part")
    links = [written(linked_of(small), "jaccard-linked")]
    if not large.isEmpty():
        found, parts = _distributed(written(sets_of(members.join(large, "region", "left_semi")), "jaccard-sets"), percent)
        links += found + [written(linked_of(part), "jaccard-linked") for part in parts]
    every = links[0]
    for more in links[1:]:
        every = every.unionByName(more)
    whole = components(every.select(F.col("label").alias("a"), F.col("node").alias("b")))

    classes = one.join(whole, "node", "left").select("node", "id", F.coalesce("label", "node").alias("label"))
    least = classes.groupBy("label").agg(F.min("id").alias("component"))
    classes = written(classes.join(least, "label").select("node", "component", "label"), "jaccard-components")
    return prints.join(classes, "node")


def _too_large():
    return (F.col("m") > REGION) | (F.col("total") > SHINGLES)


def _measured(sets: DataFrame) -> DataFrame:
    return sets.groupBy("region").agg(F.count(F.lit(1)).alias("m"), (F.sum(F.length("set")) / 8).alias("total"))


def _distributed(sets: DataFrame, percent: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """Links (label, node) of large regions (region, node, set), by rounds of pivots, and (part, node, set) tables that single
    tasks join: cells that fit one, and blocks of what no round parts."""
    links, parts, whole = [], [], []
    for turn in range(ROUNDS):
        # pivots: the members of least hashes; every part of their region gets them
        picks = [F.min_by(F.struct("node", "set"), F.xxhash64("node", F.lit(turn * PIVOTS + j))) for j in range(PIVOTS)]
        chunks = F.ceil(F.greatest(F.col("m") / REGION, F.col("total") / SHINGLES)).cast("int")
        sizes = written(_measured(sets).withColumn("chunks", chunks), "jaccard-sizes")
        pivots = sets.groupBy("region").agg(F.array_distinct(F.array(*picks)).alias("x")).select("region", F.posexplode("x").alias("pivot", "x"))
        pivots = pivots.join(sizes, "region").select("region", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), "pivot", "x.node", "x.set")
        rows = sets.join(sizes, "region").select("region", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int").alias("chunk"), F.lit(-1).alias("pivot"), "node", "set")
        dealt = pivots.unionByName(rows).repartition("region", "chunk").sortWithinPartitions("region", "chunk", F.desc("pivot"))
        found = written(dealt.mapInArrow(_celler(percent), "region long, cell int, label long, node long, set binary"), "jaccard-cells")
        links.append(found.where("label is not null").select("label", "node"))
        cells = found.where("cell is not null")
        parted = cells.groupBy("region").agg(F.count(F.lit(1)).alias("now")).join(sizes, "region").where("now <= 2 * m").select("region")
        parted = written(parted, "jaccard-parted")
        left = written(sets.join(parted, "region", "left_anti").join(cells.select("region").distinct(), "region", "left_semi"), "jaccard-whole")
        if not left.isEmpty():
            whole.append(left)
        cells = cells.join(parted, "region", "left_semi").select(F.xxhash64("region", F.lit(turn), "cell").alias("region"), "node", "set")
        large = written(_measured(cells).where(_too_large()).select("region"), "jaccard-large")
        parts.append(cells.join(large, "region", "left_anti").withColumnRenamed("region", "part"))
        if large.isEmpty():
            break
        sets = written(cells.join(large, "region", "left_semi"), "jaccard-sets")
    else:
        whole.append(sets)
    every = links[0]
    for more in links[1:]:
        every = every.unionByName(more)
    return links, parts + [_blocks(left, every) for left in whole]


def _celler(percent: int):
    """Rows by region and chunk, pivots first: the label (a pivot) of members within its limit, and the cells of members."""

    def run(batches):
        limit, now, pivots = 1 - percent / 100, None, []
        for batch in batches:
            out = []
            columns = [batch.column(c).to_pylist() for c in ("region", "chunk", "pivot", "node", "set")]
            for region, chunk, pivot, node, data in zip(*columns, strict=True):
                if now != (region, chunk):
                    now, pivots = (region, chunk), []
                x = np.frombuffer(data, np.uint64)
                if pivot >= 0:
                    pivots.append((node, x))
                    continue
                both = np.array([len(np.intersect1d(x, q, assume_unique=True)) for _, q in pivots])
                union = np.array([len(q) for _, q in pivots]) + len(x) - both
                out += [(region, None, q, node, None) for (q, _), b, u in zip(pivots, both, union, strict=True) if 100 * b >= percent * u]
                if node not in [q for q, _ in pivots]:  # pivots are compared with all members
                    out += [(region, k, None, node, data) for k, cell in enumerate(windows((1 - both / union)[None, :], limit)) if len(cell)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(map(list, zip(*out, strict=True)), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["region", "cell", "label", "node", "set"])

    return run


def _blocks(sets: DataFrame, links: DataFrame) -> DataFrame:
    """Regions in blocks: each block of members outside the region's largest component meets every block of it."""
    labels = components(links.select(F.col("label").alias("a"), F.col("node").alias("b"))).select(F.col("node").alias("of"), "label")
    rows = written(sets.join(labels, F.col("node") == F.col("of"), "left").select("region", "node", "set", F.coalesce("label", "node").alias("label")), "jaccard-labelled")
    counted = rows.groupBy("region", "label").agg(F.count(F.lit(1)).alias("n"), (F.sum(F.length("set")) / 8).alias("size"))
    totals = counted.groupBy("region").agg(F.max(F.struct("n", "label", "size")).alias("main"), F.sum("n").alias("m"), F.sum("size").alias("total"))
    need = lambda m, size: F.ceil(F.greatest(2 * m / REGION, 2 * size / SHINGLES)).cast("int")
    inner, outer = need(F.col("main.n"), F.col("main.size")), need(F.col("m") - F.col("main.n"), F.col("total") - F.col("main.size"))
    totals = totals.select(F.col("region").alias("r"), F.col("main.label").alias("most"), inner.alias("inner"), outer.alias("outer")).where("outer > 0")
    rows = rows.join(totals, F.col("region") == F.col("r"))
    main = F.col("label") == F.col("most")
    own = F.when(main, F.pmod(F.xxhash64("node"), F.col("inner")) + F.col("outer")).otherwise(F.pmod(F.xxhash64("node"), F.col("outer")))
    # blocks below outer are those outside; a main block meets these, one outside meets all
    other = F.sequence(F.lit(0), F.when(main, F.col("outer") - 1).otherwise(F.col("outer") + F.col("inner") - 1))
    rows = rows.select("region", "node", "set", own.alias("own"), F.explode(other).alias("other"))
    return rows.select(F.xxhash64("region", F.least("own", "other"), F.greatest("own", "other")).alias("part"), "node", "set")


def report(docs: DataFrame, *, doc_id="doc_id", text="text", **options) -> DataFrame:
    """doc_id, n_shingles, component_id of every document."""
    slim, names = numbered(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "doc_id")
    given = lambda c: F.when(F.col(c) != NULL_ID, F.col(c)).alias
    found = join(slim, **options).select(given("id")("doc_id"), "n_shingles", given("component_id")("component_id"))
    return found if names is None else restored(found, names, "doc_id", "component_id")


def representatives(docs: DataFrame, *, doc_id="doc_id", text="text", width: int = 5, percent: int = 80, by_id: bool = True) -> DataFrame:
    """docs with one row of each group, and all rows without words: that of the smallest id, null ids first; of rows with
    one id the one of the least hash of its text. By id, of the rows that stay with one (not null) id only one does."""
    if dict(docs.dtypes)[doc_id] not in WHOLE:
        rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.struct(*[F.col(c) for c in docs.columns]).alias("row"))
        return representatives(numbered(rows, "doc_id")[0], width=width, percent=percent, by_id=by_id).select("row.*")
    found = written(_joined(docs, doc_id, text, width, percent).select("id", "h", "n", "label"), "jaccard-found")
    best = found.where("n > 0").groupBy("label").agg(F.min(F.struct("id", "h")).alias("best")).select("best.id", "best.h")
    if by_id:
        best = best.where(F.col("id") == NULL_ID).unionByName(best.where(F.col("id") != NULL_ID).groupBy("id").agg(F.min("h").alias("h")))
    chosen = best.unionByName(found.where("n = 0").select("id", "h").distinct())
    rows = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"), _key(doc_id).alias("id"), _hash(text).alias("h"))
    left = rows.join(chosen, ["id", "h"], "left_semi")
    copies = found.where("n > 0").groupBy("id", "h").count().where("count > 1").select("id", "h")
    if not copies.isEmpty():
        once = left.join(copies, ["id", "h"], "left_semi").groupBy("id", "h").agg(F.first("row").alias("row"))
        left = left.join(copies, ["id", "h"], "left_anti").select("row").unionByName(once.select("row"))
    return left.select("row.*")
