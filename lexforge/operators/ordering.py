"""Numbers in a global order, and joins with hot keys, without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources import io


def numbered(rows: DataFrame, by: str, order: list[str | Column], out: str = "k") -> DataFrame:
    """rows with their number within each value of a column, from 1, in an order (ties in any order). The rows are sorted by
    ranges and written; what stands before a range is a sum over one row for each range and value, so numbering is as
    parallel as the sort, for any types."""
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    rows = rows.repartitionByRange(F.col(by), *order).sortWithinPartitions(F.col(by), *order)
    table = io.stored(rows.withColumn("_at", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright(F.col("_at"), 33)
    sizes = table.groupBy(F.col(by).alias("_of"), part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("_of").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("_of", "_part", (before - F.col("_first") + 1).alias("_shift"))
    table = table.join(sizes, F.col(by).eqNullSafe(F.col("_of")) & (part == F.col("_part")))
    return table.withColumn(out, F.col("_at") + F.col("_shift")).drop("_of", "_part", "_shift", "_at")


def spread_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, deal: Column, share: int) -> DataFrame:
    """left joined with the one row of right that has its key. Keys of more than ``share`` rows of left are dealt out by a hash,
    and their row of right is copied as often, so that no task gets a whole hot key."""
    copies = left.groupBy(F.col(left_key).alias("_spread_key")).agg(F.ceil(F.count(F.lit(1)) / F.lit(share)).cast("int").alias("_spread_copies"))
    hot = copies.where("_spread_copies > 1").select(F.col("_spread_key").alias("_spread_hot"), F.col("_spread_copies").alias("_spread_of"))
    dealt = left.join(hot, F.col(left_key) == F.col("_spread_hot"), "left").withColumn("_spread_copy", F.pmod(F.xxhash64(deal), F.coalesce("_spread_of", F.lit(1))).cast("int"))
    rows = right.join(copies, F.col(right_key) == F.col("_spread_key")).withColumn("_spread_at", F.explode(F.sequence(F.lit(0), F.col("_spread_copies") - 1)))
    return dealt.join(rows, (F.col(left_key) == F.col(right_key)) & (F.col("_spread_copy") == F.col("_spread_at"))).drop("_spread_key", "_spread_copies", "_spread_hot", "_spread_of", "_spread_copy", "_spread_at")
