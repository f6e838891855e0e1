"""Incremental counts over a growing corpus folder: the same results as the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import counts as C
from ..sources import files
from .keyed import Counts

#: The state store of running counts: on disk, as state grows with the vocabulary.
_STORE = "spark.sql.streaming.stateStore.providerClass"
STATE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read(spark: SparkSession, path: str, schema, format: str = "parquet", files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.format(format).schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def _checked(o: C.Options) -> None:
    if o.max_documents is not None:
        raise ValueError("a stream has no first documents")


def word_counts(stream: DataFrame, o: C.Options = C.Options()) -> DataFrame:
    """Running word counts; the state grows with the vocabulary, so use the RocksDB store for large ones."""
    _checked(o)
    return C.word_counts(stream, o)


def counted(spark: SparkSession, path: str, schema, checkpoint: str, table: str, o: C.Options = C.Options(), **options) -> DataFrame:
    """Counts every new file of a folder once and adds it to the counts table. A batch that is run again after a
    failure is counted once; the table merges its batches as they come (``keyed``)."""
    _checked(o)
    kept = Counts(spark, table)
    query = read(spark, path, schema, **options).writeStream.foreachBatch(lambda batch, number: kept.add(C.word_counts(batch, o), number) and None)
    query = query.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return kept.read()


def running(spark: SparkSession, path: str, schema, checkpoint: str, table: str, o: C.Options = C.Options(), **options) -> DataFrame:
    """The same with the engine's own state, kept by RocksDB: raw words are its keys, and every trigger replaces the table of counts
    (Parquet) by the folded and filtered ones, whole. For vocabularies that are written faster than batches are merged."""
    _checked(o)
    raw = C.raw_counts(read(spark, path, schema, **options), o)

    def replaced(batch: DataFrame, number: int) -> None:
        with files.replacing(table, True, spark) as staged:
            C.kept(batch, o).write.parquet(str(staged))

    before = spark.conf.get(_STORE, None)
    spark.conf.set(_STORE, STATE)
    try:
        query = raw.writeStream.outputMode("complete").foreachBatch(replaced).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.unset(_STORE) if before is None else spark.conf.set(_STORE, before)
    return spark.read.parquet(table)
