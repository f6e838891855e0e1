"""Tables of SQLite files as a Spark source: filters go to the database, ranges of the key to tasks of their own.

A table with row numbers is cut into equal ranges of these; one without is cut at keys, which one pass over the key's index
finds, inside the database. Every task reads its range in batches of ``CHUNK`` rows, so neither the driver nor a task
ever holds the table. The file has to be readable by all executors, or is sent to them once (``ship``).
"""

from __future__ import annotations

import os
import sqlite3
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as D
from pyspark.sql.types import BinaryType, DoubleType, LongType, StringType, StructType

from .files import Place

#: Rows of a batch, and bytes of the file for each task unless the number of tasks is given.
CHUNK, SHARE = 50_000, 32 << 20
NAME = "sqlite_table"
_PUSHED = {D.EqualTo: "=", D.GreaterThan: ">", D.GreaterThanOrEqual: ">=", D.LessThan: "<", D.LessThanOrEqual: "<="}


def _name(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def _type(declared: str):
    """The type of a column, by the database's own rules of affinity."""
    kind = declared.upper()
    if "INT" in kind:
        return LongType()
    if any(x in kind for x in ("CHAR", "CLOB", "TEXT")):
        return StringType()
    return BinaryType() if "BLOB" in kind or not kind else DoubleType()


_ARROW = {LongType(): (pa.int64(), int), StringType(): (pa.string(), str), DoubleType(): (pa.float64(), float), BinaryType(): (pa.binary(), bytes)}


class Range(D.InputPartition):
    """A task's part: a condition on the key, and its values."""

    def __init__(self, condition: str, values: tuple):
        super().__init__((condition, values))
        self.condition, self.values = condition, values


class Source(D.DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> StructType:
        with _opened(self.options["path"]) as db:
            columns = db.execute(f"PRAGMA table_info({_name(self.options['table'])})").fetchall()
        if not columns:
            raise ValueError(f"{self.options['path']} has no table {self.options['table']}")
        out = StructType()
        for _, name, declared, *_ in columns:
            out = out.add(name, _type(declared))
        return out

    def reader(self, schema: StructType) -> Reader:
        return Reader(dict(self.options), schema)


class _opened:
    """A database that is only read."""

    def __init__(self, path: str):
        self.path = path

    def __enter__(self) -> sqlite3.Connection:
        self.db = sqlite3.connect(f"file:{self.path}?mode=ro", uri=True)
        return self.db

    def __exit__(self, *_) -> None:
        self.db.close()


class Reader(D.DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.options, self.fields = options, schema
        self.where: list[str] = []
        self.values: list = []

    def pushFilters(self, filters: list[D.Filter]):
        kinds = {f.name: f.dataType for f in self.fields}
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            kind = kinds.get(column)
            fits = lambda x, kind=kind: type(x) is int and kind == LongType() or type(x) is str and kind == StringType() and "\0" not in x
            if isinstance(f, D.IsNotNull) and kind is not None:
                self.where.append(f"{_name(column)} IS NOT NULL")
            elif type(f) in _PUSHED and fits(f.value):
                self.where.append(f"{_name(column)} {_PUSHED[type(f)]} ?")
                self.values.append(f.value)
            elif isinstance(f, D.In) and f.value and all(map(fits, f.value)):
                self.where.append(f"{_name(column)} IN ({', '.join('?' * len(f.value))})")
                self.values += f.value
            else:
                yield f

    def partitions(self) -> list[Range]:
        table, path = _name(self.options["table"]), self.options["path"]
        parts = int(self.options.get("partitions") or max(1, min(10_000, os.path.getsize(path) // SHARE)))
        with _opened(path) as db:
            try:
                key = "rowid"
                low, high = db.execute(f"SELECT min(rowid), max(rowid) FROM {table}").fetchone()
                if low is None:
                    return [Range("1 = 1", ())]
                step = max(1, -(-(high - low + 1) // parts))
                cuts = list(range(low + step, high + 1, step))
            except sqlite3.OperationalError:  # a table without row numbers is kept in the order of its key
                key = next(_name(name) for _, name, _, _, _, nth in db.execute(f"PRAGMA table_info({table})") if nth == 1)
                n = db.execute(f"SELECT count(*) FROM {table}").fetchone()[0]
                step = max(1, -(-n // parts))
                rows = f"SELECT {key} AS k, row_number() OVER (ORDER BY {key}) AS n FROM {table}"
                cuts = sorted({k for (k,) in db.execute(f"SELECT k FROM ({rows}) WHERE n > 1 AND (n - 1) % ? = 0 ORDER BY n", (step,))})
        ends = [None, *cuts, None]
        out = []
        for a, b in zip(ends, ends[1:], strict=False):
            bounds = [(f"{key} >= ?", a)] * (a is not None) + [(f"{key} < ?", b)] * (b is not None)
            out.append(Range(" AND ".join(c for c, _ in bounds) or "1 = 1", tuple(v for _, v in bounds)))
        return out

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        path = self.options["path"]
        if self.options.get("shipped"):
            from pyspark import SparkFiles

            path = SparkFiles.get(self.options["shipped"])
        columns = ", ".join(_name(f.name) for f in self.fields)
        where = " AND ".join([partition.condition, *self.where])
        kinds = [_ARROW[f.dataType] for f in self.fields]
        schema = pa.schema([(f.name, k) for f, (k, _) in zip(self.fields, kinds, strict=True)])
        with _opened(path) as db:
            rows = db.execute(f"SELECT {columns} FROM {_name(self.options['table'])} WHERE {where}", (*partition.values, *self.values))
            while chunk := rows.fetchmany(CHUNK):
                cols = [pa.array([None if x is None else as_(x) for x in c], k) for c, (k, as_) in zip(zip(*chunk, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(cols, schema=schema)


def read_table(spark: SparkSession, path: str, table: str, *, partitions: int | None = None, ship: bool | None = None) -> DataFrame:
    """A table of a database. ``ship`` sends the file to the executors; by default if the session isn't a local one or the path
    names another file system."""
    remote = "://" in path and not path.startswith("file:")
    ship = (remote or not spark.sparkContext.master.startswith("local")) if ship is None else ship
    options = {"path": path.removeprefix("file://"), "table": table}
    if ship:
        from pyspark import SparkFiles

        # under a name of its own, as Spark takes a name once in a session; in the folder that Spark deletes at its end
        options["shipped"] = f"{uuid.uuid4().hex}.db"
        options["path"] = f"{SparkFiles.getRootDirectory()}/ship/{options['shipped']}"
        os.makedirs(os.path.dirname(options["path"]), exist_ok=True)
        place = Place(path, spark)
        place.fs.copyToLocalFile(False, place.path, spark._jvm.org.apache.hadoop.fs.Path(f"file://{options['path']}"), True)
        spark.sparkContext.addFile(options["path"])
    if partitions:
        options["partitions"] = str(partitions)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Source)
    return spark.read.format(NAME).options(**options).load()
