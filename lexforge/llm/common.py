"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import uuid
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.io import shared_folder

#: A word of the contracts: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


#: Spark's switch to drop a query's shuffle files, on all executors, once it has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Folders of the tables that ``scratch`` will delete, of the innermost scope last; of each thread its own.
_scopes: ContextVar[tuple[list[str], ...]] = ContextVar("scopes", default=())


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, which a cluster has to set."""
    return shared_folder(spark)


def written(df: DataFrame, name: str, by: str | None = None, keep: bool = False) -> DataFrame:
    """df, in folders by a column if one is given, as a Parquet table in the shared folder, read back: cuts the lineage and survives lost executors. The write's
    shuffle files go with its end, as nothing reads them again. The table is for the caller to delete, by ``scratch`` (which leaves
    those to keep) or by hand."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lexforge/{name}-{uuid.uuid4().hex}"
    out = df.write.mode("errorifexists")
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        (out.partitionBy(by) if by else out).parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)
    if _scopes.get() and not keep:
        _scopes.get()[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


#: Types of ids that operators order and keep as they are.
WHOLE = ("tinyint", "smallint", "int", "bigint")


def numbered(rows: DataFrame, doc_id: str) -> tuple[DataFrame, DataFrame | None]:
    """rows with whole numbers for ids, in the order of the ids' own type, and the table (number, name) of them; rows as they
    are and none, if they are whole numbers already. Null ids stay null."""
    if dict(rows.dtypes)[doc_id] in WHOLE:
        return rows, None
    distinct = rows.select(F.col(doc_id).alias("name")).where("name is not null").distinct()
    # ranges in order, rows in order within them; written, so that a number never changes
    dealt = distinct.repartitionByRange(F.col("name")).sortWithinPartitions("name")
    names = written(dealt.select(F.monotonically_increasing_id().alias("number"), "name"), "numbers")
    out = rows.join(names, F.col(doc_id) == F.col("name"), "left").drop("name").withColumn(doc_id, F.col("number")).drop("number")
    return out, names


def restored(rows: DataFrame, names: DataFrame, *columns: str) -> DataFrame:
    """rows with the names of the numbers in these columns."""
    for c in columns:
        order = rows.columns
        rows = rows.join(names.select(F.col("number").alias("__number"), F.col("name").alias("__name")), F.col(c) == F.col("__number"), "left")
        rows = rows.withColumn(c, F.col("__name")).select(*order)
    return rows


@contextmanager
def scratch(spark: SparkSession):
    """Deletes the tables written inside once it is left: results that read them must be written before."""
    paths: list[str] = []
    token = _scopes.set((*_scopes.get(), paths))
    try:
        yield
    finally:
        _scopes.reset(token)
        for path in paths:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def words(text: Column) -> Column:
    """The words of a text, in order; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def n_words(text: Column) -> Column:
    """How many words a text has; 0 for null."""
    return F.size(words(text)).cast("long")


def bind(value: Column, body) -> Column:
    """body(value) with value evaluated once: a lambda's body would evaluate what it captures for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def hash60(key: Column) -> Column:
    """60 bits of md5 of a string as a long; the same in any engine and any run."""
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 15), 16, 10).cast("long")


def raw(column) -> list:
    """Bytes, or None, of each row of an Arrow string column."""
    return column.cast(pa.large_binary()).to_pylist()


def table(batch: pa.RecordBatch | None, schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if not isinstance(columns[f.name], pa.Array) else columns[f.name].cast(f.type) for f in schema], schema=schema)
