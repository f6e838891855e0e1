"""Sharding by extendible hashing.

A shard is a prefix of the bits of a document's hash. Words of a directory: a bucket that holds more bytes than the
limit is split on one more bit, and only such buckets are; every other keeps its short prefix. The directory comes
from histograms of bytes by the next ``bits`` hash bits, summed for each shorter prefix by windows that leave one row for
each bucket; documents of the buckets
that are still too large are counted again by the bits that follow. Documents find their shard by an equi-join of
their hash bits with the directory, never by a sort.

Cases. Documents with equal ids share a hash, and no bit can part them (ties): such a shard, or one that is a single very
long document, may exceed the limit, which ``over_limit`` says. Null and empty texts weigh nothing. Rows with a null id
share one hash. Repeated rows are all assigned. An empty table has no shards. Columns may have any names but for
``sharded``, where a column named shard is replaced.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import hash60, written

LIMIT = 32 << 20
BITS = 12


def hash_of(doc_id: Column) -> Column:
    return hash60(F.concat(F.lit("shard:"), F.coalesce(doc_id.cast("string"), F.lit(""))))


def _name(h: Column, depth: Column) -> Column:
    """The first depth of 60 bits, as a string of 0 and 1."""
    return F.substring(F.lpad(F.conv(h.cast("string"), 10, 2), 60, "0"), F.lit(1), depth)


def directory(sizes: DataFrame, limit: int = LIMIT, bits: int = BITS) -> list[DataFrame]:
    """The directory of (h, bytes), one table for each round of histograms: cell (the hash bits so far), depth,
    shard_bytes; depth is null where the next table goes on."""
    rounds = []
    rows, done = sizes.select("h", "bytes"), 0
    while True:
        upto = min(60, done + bits)
        cells = written(rows.groupBy(F.shiftright("h", 60 - upto).alias("cell")).agg(F.sum("bytes").alias("bytes")), f"shard-cells{done}")
        # the bits up to here are known to be too few; a part of the cells holds at most 2**bits of them
        depths = range(0 if done == 0 else done + 1, upto + 1)
        found = cells.withColumn("part", F.shiftright("cell", upto - done)).repartition("part")
        for d in depths:
            found = found.withColumn(f"bytes{d}", F.sum("bytes").over(Window.partitionBy("part", F.shiftright("cell", upto - d))))
        fits = [F.when((F.col(f"bytes{d}") <= limit) | F.lit(d == 60), F.struct(F.lit(d).alias("depth"), F.col(f"bytes{d}").alias("shard_bytes"))) for d in depths]
        found = found.withColumn("x", F.coalesce(*fits)).select("cell", F.col("x.depth").alias("depth"), F.col("x.shard_bytes").alias("shard_bytes"))
        found = written(found, f"shard-directory{done}")
        rounds.append(found)
        large = found.where("depth is null").select("cell")
        if upto == 60 or large.isEmpty():
            return rounds
        rows = rows.withColumn("cell", F.shiftright("h", 60 - upto)).join(large, "cell", "left_semi").select("h", "bytes")
        done = upto


def _assigned(rows: DataFrame, limit: int, bits: int) -> DataFrame:
    """rows (with h and bytes) with shard, depth, shard_bytes, over_limit."""
    out, found = rows, []
    for i, cells in enumerate(directory(rows, limit, bits)):
        upto = min(60, (i + 1) * bits)
        cells = cells.where("depth is not null").select(F.col("cell").alias(f"cell{i}"), F.col("depth").alias(f"depth{i}"), F.col("shard_bytes").alias(f"bytes{i}"))
        out = out.withColumn(f"cell{i}", F.shiftright("h", 60 - upto)).join(cells, f"cell{i}", "left")
        found.append(i)
    depth = reduce(lambda a, b: F.coalesce(a, b), [F.col(f"depth{i}") for i in found])
    total = reduce(lambda a, b: F.coalesce(a, b), [F.col(f"bytes{i}") for i in found])
    return out.select(*rows.columns, _name(F.col("h"), depth).alias("shard"), depth.cast("int").alias("depth"), total.cast("long").alias("shard_bytes"), (total > limit).alias("over_limit"))


def report(docs: DataFrame, *, doc_id="doc_id", text="text", limit: int = LIMIT, bits: int = BITS) -> DataFrame:
    """doc_id, n_bytes, shard, depth, shard_bytes, over_limit of every document."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), hash_of(F.col(doc_id)).alias("h"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("bytes"))
    return _assigned(written(rows, "shard-sizes"), limit, bits).select("doc_id", F.col("bytes").alias("n_bytes"), "shard", "depth", "shard_bytes", "over_limit")


def sharded(docs: DataFrame, *, doc_id="doc_id", text="text", limit: int = LIMIT, bits: int = BITS) -> DataFrame:
    """docs with their shard, a string of bits; a column named shard is replaced."""
    rows = docs.select(F.struct(*[F.col(c) for c in docs.columns if c != "shard"]).alias("row"), hash_of(F.col(doc_id)).alias("h"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("bytes"))
    return _assigned(rows, limit, bits).select("row.*", "shard")


def write(docs: DataFrame, path: str, *, tasks: int | None = None, **options) -> None:
    """Writes docs as Parquet under path, a folder for each shard and one file in it: a shard is within its limit, so the
    file of one task is. A shard over the limit is cut where its rows allow it by Spark's maxRecordsPerFile, if set."""
    rows = sharded(docs, **options)
    n = tasks or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows.repartition(n, "shard").write.partitionBy("shard").parquet(path)


def sql(limit: int) -> str:
    """The directory and each document's place in it, as DuckDB SQL."""
    return SQL.replace(f"<= {LIMIT})", f"<= {limit})")


#: Of a relation docs (doc_id, text); depths beyond 40 aren't looked at.
SQL = f"""
b AS (SELECT doc_id, CAST(coalesce(strlen(text), 0) AS BIGINT) AS n_bytes,
        CAST('0x' || substr(md5('shard:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h FROM docs),
t AS (SELECT d, h >> (60 - d) AS p, CAST(sum(n_bytes) AS BIGINT) AS s FROM b, range(0, 41) r(d) GROUP BY 1, 2),
f AS (SELECT b.*, (SELECT min(struct_pack(d := t.d, s := t.s)) FROM t WHERE t.p = b.h >> (60 - t.d) AND t.s <= {LIMIT}) AS x FROM b)
"""
