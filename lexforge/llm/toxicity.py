"""Toxicity by maximum-scoring segment search.

Training. Tokens (words in lower case, and the first letters of long ones) are counted by the toxic and the other labelled
documents that have them, near copies once: those of one label whose ``LEAST`` least hashes of 3-word windows all agree. A
token's score is its log-odds ratio with an informative Dirichlet prior: half a count and the token's share of all counts,
so a rare token stays near 0. Tokens whose ratio is significant, either way, have this score; all others have one score
together, that of their pooled counts, and at most -``LEAST_COST``, so that a text without toxic words loses by its length.

Scan. In one pass over a text's scores, every maximal segment with a positive sum is found (a token that no segment can
be joined with any more closes it), in time linear in the text. By extreme-value theory, a text of n tokens without toxic
passages has K n exp(-lambda S) segments of score S or more by chance; lambda solves sum(p exp(lambda s)) = 1 over the
scores of other documents, and K is estimated from their best segments S: K n exp(-lambda S) has a mean of 1 over them. lambda is at most ``MOST_LAMBDA``.
Segments for which this is small are the toxic passages.

Calibration. A document's evidence is the largest sum of lambda S - ln(K n) over its r best segments, and ln(r!), for
any r. A logistic curve over it, taken within ``EVIDENCE`` and fitted on a histogram of the training documents' evidence, is the score.

Bounds. Training takes labelled documents of at most ``MAX_TRAIN`` ids, the lowest by hash. That bounds the model, which
is all that reaches the driver and the executors: significance is tested where the counts are, and every token that
passes is part of it. Scoring is a scan without a shuffle.

Cases. Null and empty texts have no tokens and get the score of no evidence. Null ids are held out or not as an empty string
would be, and have no labels. Labels, languages, sources and ids are not part of a score. An id with both labels is toxic;
repeated rows are scored one by one and train once, like near copies (ties by the least text). A text of any length is one
row, scanned once. Without labels of both kinds, or with empty tables, every document has the training set's share of toxic
ones, or 0. Columns may have any names: only id, text and label are read.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bind, hash60, raw, words, written
from .quality import windows

MAX_TRAIN = 100_000
#: Strength of the prior in tokens (a hundredth of all at most), significance in standard deviations, lengths of stems,
#: chance of a random segment, least cost of a token without a score, hashes by which copies are known.
PRIOR, SIGNIFICANT, STEMS, CHANCE, LEAST_COST, LEAST = 2000.0, 3.5, (5, 4), 0.05, 0.02, 4
THRESHOLD = 0.7
#: Largest lambda: with few toxic tokens among the others the equation's root is so large that a single token would count as a
#: certain passage. Evidence beyond these ends is as good as certain, so it is at the ends for the curve.
MOST_LAMBDA, EVIDENCE = 2.0, (-20.0, 60.0)
#: ASCII letters, digits, apostrophes and whatever isn't ASCII belong to tokens.
_TOKEN = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or 48 <= c <= 57 or c == 39 or c >= 128 else 32 for c in range(256))


def within(evidence: float) -> float:
    return max(EVIDENCE[0], min(EVIDENCE[1], evidence))


def tokens(data: bytes) -> list[bytes]:
    return data.translate(_TOKEN).split()


def stems(token: bytes) -> list[bytes]:
    """The first letters of a longer token, marked."""
    letters = token.decode("utf-8", "replace")
    return [letters[:n].encode() + b"*" for n in STEMS if len(letters) > n]


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def training(docs: DataFrame, labels: DataFrame, *, doc_id="doc_id", text="text", label="toxic", most: int = MAX_TRAIN) -> DataFrame:
    """t, y of the labelled documents to learn from: not held out, and the lowest hashes if there are too many."""
    marks = labels.select(F.col(doc_id).alias("id"), F.col(label).cast("int").alias("y")).where(F.col("id").isNotNull() & F.col("y").isin(0, 1) & ~held_out(F.col("id")))
    marks = marks.groupBy("id").agg(F.max("y").alias("y"))
    n = marks.count()
    if n > most:
        marks = marks.where(hash60(F.concat(F.lit("toxic:"), F.col("id").cast("string"))) < int(most / n * (1 << 60)))
    # at most about ``most`` ids and marks go to the executors
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("t")).join(F.broadcast(marks), "id").select("t", "y")
    # copies of one toxic text would make all its words look toxic
    least = bind(words(F.col("t")), lambda w: F.slice(F.sort_array(F.array_distinct(windows(w))), 1, LEAST))
    return rows.withColumn("copy", F.when(F.size(least) == LEAST, F.xxhash64(least)).otherwise(F.xxhash64("t"))).groupBy("copy", "y").agg(F.min("t").alias("t")).select("t", "y")


def _counter(batches):
    """token, toxic, other: how many toxic and other texts of a batch have each."""
    for batch in batches:
        both = (Counter(), Counter())
        for data, y in zip(raw(batch.column("t")), batch.column("y").to_pylist(), strict=True):
            here = set(tokens(data or b""))
            both[y].update(here)
            both[y].update({s for w in here for s in stems(w)})
        names = list(both[0] | both[1])
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array([both[1][w] for w in names], pa.int64()), pa.array([both[0][w] for w in names], pa.int64())], names=["token", "toxic", "other"])


class Model:
    """Scores of tokens, the cost of others, and the calibration."""

    def __init__(self, scores: dict[bytes, float], cost: float, lam: float, k: float = 0.1, curve=(0.0, 0.0)):
        self.scores, self.cost, self.lam, self.k, self.curve = scores, cost, lam, k, curve

    def score(self, token: bytes) -> float | None:
        if (s := self.scores.get(token)) is None:
            s = next((self.scores[x] for x in stems(token) if x in self.scores), None)
        return s

    def segments(self, words: list[bytes]) -> list[tuple[float, int, int]]:
        """(sum, first, last) of all maximal scoring segments, in order; linear in the number of words."""
        known: dict[bytes, float] = {}
        out: list[list[float]] = []  # sum before, sum after, first, last, the nearest piece on the left that began lower
        total = 0.0
        for i, w in enumerate(words):
            if (s := known.get(w)) is None:
                s = self.score(w)
                s = known[w] = -self.cost if s is None else s
            if s <= 0:
                total += s
                continue
            piece = [total, total + s, i, i, -1]
            total += s
            # a piece joins the nearest one that began lower, and all in between, unless that one ended as high
            while True:
                j = len(out) - 1
                while j >= 0 and out[j][0] >= piece[0]:
                    j = out[j][4]
                if j < 0 or out[j][1] >= piece[1]:
                    piece[4] = j
                    out.append(piece)
                    break
                piece = [out[j][0], piece[1], out[j][2], piece[3], -1]
                del out[j:]
        return [(b - a, int(f), int(t)) for a, b, f, t, _ in out]

    def evidence(self, words: list[bytes]) -> tuple[float, list[tuple[int, int]]]:
        """Calibrated evidence of a text, and the word ranges of its significant segments."""
        found = self.segments(words)
        base = math.log(self.k * (len(words) + 1))
        if not found:
            return -base, []
        each = [(self.lam * s - base, f, t) for s, f, t in found]
        # chance of such a segment: 1 - exp(-exp(-x))
        sure = [(x, f, t) for x, f, t in each if -math.expm1(-math.exp(-x)) < CHANCE]
        # the best r of all segments together are as rare as r of them in any order: a factor of r!
        best, total = -math.inf, 0.0
        for r, x in enumerate(sorted((x for x, _, _ in each), reverse=True), 1):
            total += x
            best = max(best, total + math.lgamma(r + 1))
        return best, [(f, t) for _, f, t in sure]

    def probability(self, evidence: float) -> float:
        a, b = self.curve
        z = max(-40.0, min(40.0, a * within(evidence) + b))
        return 1 / (1 + math.exp(-z))


def _scored(counts: DataFrame, toxic: float, other: float) -> DataFrame:
    """counts with delta, the log-odds with a Dirichlet prior, and z, its standard deviations."""
    every = toxic + other
    strength = min(PRIOR, every / 100)
    prior = F.lit(0.5) + F.lit(strength / every) * (F.col("toxic") + F.col("other"))
    odds = lambda n, total: F.log((n + prior) / (F.lit(total + strength) - n - prior))
    rows = counts.withColumn("delta", odds(F.col("toxic"), toxic) - odds(F.col("other"), other))
    return rows.withColumn("z", F.col("delta") / F.sqrt(1 / (F.col("toxic") + prior) + 1 / (F.col("other") + prior)))


def _lambda(values: list[tuple[float, float]], cost: float, rest: float, most: float = MOST_LAMBDA) -> float:
    """The positive root of sum(p exp(x s)) = 1 for scores s of probability p, and -cost for the rest; at most ``most``."""
    f = lambda x: sum(p * math.exp(min(x * s, 700)) for s, p in values) + rest * math.exp(-x * cost) - 1
    lo, hi = 1e-6, 1e-6
    while f(hi) < 0 and hi < 64:
        lo, hi = hi, hi * 2
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if f(mid) < 0 else (lo, mid)
    return min(hi, most)


def fit(docs: DataFrame, labels: DataFrame, **options) -> Model:
    """The model of the labelled documents that aren't held out."""
    rows = written(training(docs, labels, **options), "toxicity-training")
    counts = rows.mapInArrow(_counter, "token binary, toxic long, other long").groupBy("token").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    counts = written(counts.withColumn("whole", ~F.col("token").cast("string").endswith("*")), "toxicity-counts")
    toxic, other = (float(x or 0) for x in counts.where("whole").agg(F.sum("toxic"), F.sum("other")).first())
    if not toxic or not other:
        return Model({}, 1.0, 1.0, 1.0, (0.0, -40.0 if not toxic else 40.0))
    tested = _scored(counts, toxic, other).where(F.abs("z") > SIGNIFICANT)
    top = [(bytes(r.token), r.toxic, r.other, r.delta) for r in tested.select("token", "toxic", "other", "delta").orderBy("token").collect()]
    scores = {t: d for t, _, _, d in top}
    plain = [(y, n, d) for t, y, n, d in top if not t.endswith(b"*")]
    rest = toxic - sum(y for y, _, _ in plain), other - sum(n for _, n, _ in plain)
    cost = max(LEAST_COST, -math.log((rest[0] + 0.5) / (toxic + 1) * (other + 1) / (rest[1] + 0.5)))
    share = [(d, (n + 0.5) / other) for _, n, d in plain]
    model = Model(scores, cost, _lambda(share, cost, max(0.0, 1 - sum(p for _, p in share))))
    spark = docs.sparkSession
    first = spark.sparkContext.broadcast(model)

    def chance(batches):
        """texts, and the sum of n exp(-lambda S), of the other documents."""
        for batch in batches:
            values = []
            for data, y in zip(raw(batch.column("t")), batch.column("y").to_pylist(), strict=True):
                if not y:
                    words = tokens(data or b"")
                    best = max((s for s, _, _ in first.value.segments(words)), default=0.0)
                    values.append((len(words) + 1) * math.exp(-first.value.lam * best))
            yield pa.RecordBatch.from_arrays([pa.array([len(values)], pa.int64()), pa.array([math.fsum(values)], pa.float64())], names=["n", "total"])

    n, total = rows.mapInArrow(chance, "n long, total double").agg(F.sum("n"), F.sum("total")).first()
    model.k = n / total if total else model.k
    sent = spark.sparkContext.broadcast(model)

    def evidence(batches):
        for batch in batches:
            bins = Counter()
            for data, y in zip(raw(batch.column("t")), batch.column("y").to_pylist(), strict=True):
                bins[y, round(4 * within(sent.value.evidence(tokens(data or b""))[0]))] += 1
            yield pa.RecordBatch.from_arrays([pa.array([y for y, _ in bins], pa.int32()), pa.array([b for _, b in bins], pa.int32()), pa.array(list(bins.values()), pa.int64())], names=["y", "bin", "n"])

    found = rows.mapInArrow(evidence, "y int, bin int, n long").groupBy("y", "bin").agg(F.sum("n").alias("n")).collect()
    model.curve = _logistic(np.array([r.bin / 4 for r in found]), np.array([r.y for r in found]), np.array([float(r.n) for r in found]))
    return model


def _logistic(x, y, n) -> tuple[float, float]:
    """Slope and intercept, by Newton's method with a small penalty on the slope."""
    # soft labels, after Platt, keep the curve finite when the classes are apart
    pos, neg = n[y == 1].sum(), n[y == 0].sum()
    want = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    w = np.zeros(2)
    design = np.stack([x, np.ones_like(x)], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -40, 40)))
        gradient = design.T @ (n * (want - p)) - np.array([1e-2, 1e-6]) * w
        hessian = (design * (n * p * (1 - p))[:, None]).T @ design + np.diag([1e-2, 1e-6])
        step = np.linalg.solve(hessian, gradient)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def scored(docs: DataFrame, model: Model, *, doc_id="doc_id", text="text") -> DataFrame:
    """doc_id, score and passages (byte ranges of the tokens of significant segments in the text) of every document."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches):
        import re

        model = sent.value
        for batch in batches:
            scores, passages = [], []
            for data in raw(batch.column("t")):
                x, segments = model.evidence(tokens(data or b""))
                scores.append(model.probability(x))
                at = [m.span() for m in re.finditer(rb"[^ ]+", data.translate(_TOKEN))] if segments else []
                passages.append([{"start": at[f][0], "end": at[t][1]} for f, t in segments])
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(scores, pa.float64()), pa.array(passages, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))], names=["doc_id", "score", "passages"])

    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("t"))
    return rows.mapInArrow(run, f"doc_id {kind}, score double, passages array<struct<start:int,end:int>>")


def report(docs: DataFrame, labels: DataFrame, *, threshold: float = THRESHOLD, **options) -> DataFrame:
    """doc_id, held_out, score, predicted, passages of every document."""
    model = fit(docs, labels, **options)
    names = {k: v for k, v in options.items() if k in ("doc_id", "text")}
    rows = scored(docs, model, **names)
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "passages")
