"""Mixing sources to target weights with hash-threshold histograms.

Every source gets a target number of words: weights share the words of all documents, no target exceeds ``cap`` times
its source's words, and what is cut off is shared again by weight. A target of q whole sources and a remainder takes
every document q times and some once more. Those are the documents whose hash lies under a threshold.

A threshold comes from nested histograms: words by source and leading hash bits give the bucket in which the budget
ends; only this bucket is counted again by the next bits, and at last by whole hashes. Documents larger than the words
still missing are passed over, and the gap that is left is filled the same way ``fills`` times. All decisions are
then comparisons of a document's own hash and size with its source's thresholds: a filter, without a sort or a
shuffle of documents. A hot source is one row per bucket after partial aggregation.

A hash stands for an id and its text, so rows share one only if both are equal. Where such a group as a whole doesn't fit
what is left, though each of its rows does, a threshold ends at it; the group is then passed over, and the next fill goes
on behind it.

Null and empty texts have size 0 and are never taken; a source with such texts only has target 0. A null source is a
source of its own, the last. Rows of equal id and text share a hash and are taken together; a null id is an id like
others. The result depends on the rows alone, not on their order or partitions. Of a text of any length only its words are
counted and its digest taken; one larger than what is missing is passed over. Empty tables give empty results. Other columns
may have any names: only id, text and source are read, and ``mixed`` carries rows in a struct.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import hash60, n_words, written

WEIGHTS, CAP, FILLS = (1, 2, 3), 3, 3
#: Sources up to which what is known of them goes to all executors; beyond, joins are shuffles by source.
SENT = 20_000
#: Hash bits that each level of histograms looks at; together all 60.
LEVELS = (12, 12, 36)
END = 1 << 60


def key_of(source: Column) -> Column:
    """A source's key: never null, the null source after all others."""
    return F.when(source.isNull(), "1").otherwise(F.concat(F.lit("0"), source.cast("string")))


def hash_of(doc_id: Column, text: Column) -> Column:
    digest = F.md5(F.coalesce(text, F.lit("")).cast("binary"))
    return hash60(F.concat(F.lit("mix:"), F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), digest))


def targets(sizes: DataFrame, weights=WEIGHTS, cap=CAP) -> DataFrame:
    """k, source_size, target of every source of (k, size); one row for a source."""
    totals = sizes.groupBy("k").agg(F.sum("size").alias("source_size"))
    # one row per source from here on
    by_key = Window.partitionBy().orderBy("k")
    everything = Window.partitionBy()
    place = F.pmod(F.row_number().over(by_key) - 1, F.lit(len(weights)))
    weight = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), place + 1)
    rows = totals.withColumn("w", weight).withColumn("most", F.col("source_size") * cap)
    filling = Window.partitionBy().orderBy(F.col("most").cast("double") / F.col("w"), "k").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("left", F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(filling), F.lit(0)))
    rows = rows.withColumn("w_left", F.sum("w").over(everything) - F.coalesce(F.sum("w").over(filling), F.lit(0)))
    rows = rows.withColumn("share", F.col("left").cast("double") / F.col("w_left"))
    # sources stop at their cap one after the other; the first that doesn't has the share of all that are left
    open_ = F.col("most").cast("double") > F.col("w") * F.col("share")
    level = F.min(F.when(open_, F.struct(F.col("most").cast("double") / F.col("w"), "k", "share"))).over(everything)["share"]
    target = F.when(open_, F.col("w") * level).otherwise(F.col("most").cast("double"))
    return rows.select("k", "source_size", target.alias("target"))


def _threshold(rows: DataFrame, gaps: DataFrame, sent) -> DataFrame:
    """k, t: hashes below t are those whose running sum of sizes, in hash order, stays within the source's gap."""
    todo = gaps.select("k", F.col("gap").alias("room"), F.lit(0).cast("long").alias("prefix"))
    done = 0
    for bits in LEVELS:
        rest = 60 - done - bits
        inside = rows.join(sent(todo), "k")
        if done:
            inside = inside.where(F.shiftright("h", 60 - done) == F.col("prefix"))
        counted = inside.groupBy("k", "room", F.shiftright("h", rest).alias("b")).agg(F.sum("size").alias("n"))
        upto = Window.partitionBy("k").orderBy("b")
        counted = counted.withColumn("sum", F.sum("n").over(upto)).where("sum > room")
        todo = counted.groupBy("k").agg(F.min(F.struct("b", F.expr("room - (sum - n)").alias("room"))).alias("x")).select("k", "x.room", F.col("x.b").alias("prefix"))
        done += bits
    # no bucket goes beyond the budget: all fit
    return gaps.select("k").join(todo.select("k", "prefix"), "k", "left").select("k", F.coalesce("prefix", F.lit(END)).alias("t"))


def plan(docs: DataFrame, *, doc_id="doc_id", text="text", source="source", weights=WEIGHTS, cap=CAP, fills=FILLS) -> DataFrame:
    """One row per source: k, source_size, target, times (whole copies), and the gaps and thresholds of each fill."""
    sizes = written(docs.select(key_of(F.col(source)).alias("k"), hash_of(F.col(doc_id), F.col(text)).alias("h"), n_words(F.col(text)).alias("size")), "mix-sizes")
    goal = targets(sizes, weights, cap)
    times = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    goal = goal.withColumn("times", times)
    gap = F.floor(F.col("target") - F.col("times") * F.col("source_size")).cast("long")
    goal = written(goal.withColumn("gap", gap).withColumn("steps", F.expr("cast(array() as array<struct<gap:bigint,t:bigint>>)")), "mix-targets")
    sent = F.broadcast if goal.count() <= SENT else lambda df: df  # one row per source
    for fill in range(fills):
        found = sizes.join(sent(goal.where("gap > 0").select("k", "gap", "steps")), "k").where((F.col("size") > 0) & (F.col("size") <= F.col("gap")) & ~_taken() & ~_passed_over())
        rows = found.select("k", "h", "size")
        at = _threshold(rows, goal.where("gap > 0").select("k", "gap"), sent)
        got = found.select("k", "h", "size").join(sent(at), "k").where("h < t").groupBy("k").agg(F.sum("size").alias("got"))
        now = goal.join(at, "k", "left").join(got, "k", "left")
        step = F.when(F.col("t").isNull(), F.col("steps")).otherwise(F.concat("steps", F.array(F.struct("gap", "t"))))
        goal = written(now.select("k", "source_size", "target", "times", (F.col("gap") - F.coalesce("got", F.lit(0))).alias("gap"), step.alias("steps")), f"mix-fill{fill}")
    return goal


def _passed_over() -> Column:
    """Whether a threshold ended at a document's own hash: its group didn't fit. Thresholds rise from step to step, so no
    earlier step has taken it, and no later one does."""
    return F.exists("steps", lambda s: F.col("h") == s["t"])


def _taken() -> Column:
    """Whether a document is taken once more: one of its source's steps has room for its size, and its hash is low."""
    return F.exists("steps", lambda s: (F.col("size") <= s["gap"]) & (F.col("h") < s["t"])) & ~_passed_over()


def mix(docs: DataFrame, *, doc_id="doc_id", text="text", source="source", **options) -> DataFrame:
    """The documents as (row, k, h, size, source_size, target, copies): row has all columns of docs."""
    goal = plan(docs, doc_id=doc_id, text=text, source=source, **options).select("k", "source_size", "target", "times", "steps")
    rows = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"), key_of(F.col(source)).alias("k"), hash_of(F.col(doc_id), F.col(text)).alias("h"), n_words(F.col(text)).alias("size"))
    copies = F.when(F.col("size") == 0, 0).otherwise(F.col("times") + _taken().cast("long"))
    return rows.join(goal, "k").withColumn("copies", copies.cast("int")).drop("times", "steps")


def report(docs: DataFrame, *, doc_id="doc_id", text="text", source="source", **options) -> DataFrame:
    """doc_id, size, source_size, target, taken of every document."""
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(source).alias("source"))
    goal = plan(slim, **options).select("k", "source_size", "target", "times", "steps")
    rows = slim.select("doc_id", key_of(F.col("source")).alias("k"), hash_of(F.col("doc_id"), F.col("text")).alias("h"), n_words(F.col("text")).alias("size"))
    taken = F.when(F.col("size") == 0, 0).otherwise((F.col("times") + _taken().cast("long")) * F.col("size"))
    return rows.join(goal, "k").select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mixture itself: each document as often as it is taken, with the columns of docs."""
    rows = mix(docs, **options).where("copies > 0")
    return rows.select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).select("row.*")


#: sized: a relation (doc_id, source, size, digest), the last the md5 of the text. All of op1's result.
SQL = f"""
d AS (SELECT *, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS k,
        CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || digest), 1, 15) AS BIGINT) AS h FROM sized),
s0 AS (SELECT k, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY k),
s1 AS (SELECT *, CAST(1 + (row_number() OVER (ORDER BY k) - 1) % 3 AS BIGINT) AS w, {CAP} * source_size AS most FROM s0),
s2 AS (SELECT *, sum(source_size) OVER () - coalesce(sum(most) OVER f, 0) AS l, sum(w) OVER () - coalesce(sum(w) OVER f, 0) AS wl FROM s1
        WINDOW f AS (ORDER BY CAST(most AS DOUBLE) / w, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s3 AS (SELECT *, CAST(l AS DOUBLE) / CAST(wl AS DOUBLE) AS share FROM s2),
s4 AS (SELECT *, (SELECT share FROM s3 WHERE CAST(most AS DOUBLE) > w * share ORDER BY CAST(most AS DOUBLE) / w, k LIMIT 1) AS lvl FROM s3),
g0 AS (SELECT k, source_size, CASE WHEN CAST(most AS DOUBLE) > w * share THEN w * lvl ELSE CAST(most AS DOUBLE) END AS target FROM s4),
g1 AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS times FROM g0),
x0 AS (SELECT d.doc_id, d.k, d.h, d.size, g1.source_size, g1.target, g1.times, CAST(floor(target - times * source_size) AS BIGINT) AS gap, FALSE AS extra, FALSE AS passed FROM d JOIN g1 USING (k)),
""" + ",\n".join(
    f"""y{i} AS (SELECT *, NOT extra AND NOT passed AND size > 0 AND size <= gap AS ok FROM x{i}),
z{i} AS (SELECT *, sum(CASE WHEN ok THEN size ELSE 0 END) OVER (PARTITION BY k ORDER BY h) AS upto FROM y{i}),
x{i + 1} AS (SELECT doc_id, k, h, size, source_size, target, times, CAST(gap - sum(CASE WHEN ok AND upto <= gap THEN size ELSE 0 END) OVER (PARTITION BY k) AS BIGINT) AS gap, extra OR (ok AND upto <= gap) AS extra, passed OR coalesce(h = min(CASE WHEN ok AND upto > gap THEN h END) OVER (PARTITION BY k), FALSE) AS passed FROM z{i})"""
    for i in range(FILLS)
)
