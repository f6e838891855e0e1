"""The most frequent words, exactly, without shuffling the whole vocabulary.

A count of everything shuffles every distinct word of every task, most of them once or twice in the corpus. Here counters of
hash buckets say first which words can be among those asked for, and only these are counted:

1. One counter for each bucket of words: at most ``buckets`` small rows from a task, whatever the vocabulary. A counter is at
   least the count of each word in its bucket.
2. Words of the buckets with the largest counters, ``SPARE`` for each row asked for, are counted exactly. The limit-th of these
   counts, or the minimum count, is a threshold that no word asked for lies below.
3. Buckets that reach the threshold and aren't counted yet are counted as well; mostly there are none.

The corpus is read and segmented once for each step. That pays where the vocabulary, as on the web, grows with the corpus and the
words asked for are more frequent than a bucket is on average: the words in it divided by ``buckets``. Below that all
buckets pass, and nothing is saved. What is sent to all executors is numbers of buckets, bounded by ``buckets``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources import io
from . import counts as C

#: Buckets at least, and for each row asked for; the buckets counted first for each row asked for.
BUCKETS, EACH, SPARE = 1 << 16, 64, 2


def _words(corpus: DataFrame, o: C.Options) -> DataFrame:
    """word of every occurrence that survives folding and filters."""
    rows = T.normalized(C.scanned(corpus, o).select(o.text), o.text, o.normalization)
    each = rows.select(F.explode(T.words(F.col(o.text))).alias("word")).select(C.folded(F.col("word"), o).alias("word"))
    return each.where(C.survives(F.col("word"), o))


def top_counts(corpus: DataFrame, o: C.Options = C.Options(), min_count: int = 1, limit: int = 0, buckets: int | None = None) -> DataFrame:
    """word, count as ``counts.ranked`` gives them: the most frequent first, then by word; all that reach the minimum if the limit is 0."""
    if not limit and min_count == 1:
        return C.ranked(C.word_counts(corpus, o))
    buckets = buckets or max(BUCKETS, EACH * limit)
    words = _words(corpus, o).withColumn("bucket", F.pmod(F.xxhash64("word"), F.lit(buckets)).cast("int"))
    sketch = io.stored(words.groupBy("bucket").agg(F.count(F.lit(1)).alias("most")).where(F.col("most") >= min_count), "sketch")

    def counted(chosen: DataFrame) -> DataFrame:
        # at most one row for each bucket
        each = words.join(F.broadcast(chosen.select("bucket")), "bucket", "left_semi")
        return io.stored(each.groupBy("word").agg(F.count(F.lit(1)).alias("count")), "counted")

    if not limit:
        return C.ranked(counted(sketch), min_count)
    first = sketch.orderBy(F.desc("most"), "bucket").limit(SPARE * limit)
    rows = counted(first)
    last = C.ranked(rows, 1, limit).agg(F.count(F.lit(1)).alias("n"), F.min("count").alias("least")).first()
    threshold = max(min_count, last.least) if last.n == limit else min_count
    left = sketch.where(F.col("most") >= threshold).join(F.broadcast(first.select("bucket")), "bucket", "left_anti")
    if not left.isEmpty():
        rows = rows.unionByName(counted(left))
    return C.ranked(rows, threshold, limit)
