"""Files and folders on whatever file system a path names, by the file system classes that Spark itself uses.

Targets are replaced in two steps: what is new is written beside the target under a hidden name, and takes its place by renaming
once it is whole; the old target is set aside for that moment and comes back if the renaming fails. So a failing write
leaves the old target as it was. A process that dies between the two renamings leaves it under ``.<name>.old-<id>``.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that are copied at a time.
BUFFER = 1 << 20


class Place:
    """A path and its file system."""

    def __init__(self, path: str, spark: SparkSession | None = None):
        self.spark = spark or SparkSession.active()
        self.jvm = self.spark._jvm
        self.path = self.jvm.org.apache.hadoop.fs.Path(path)
        self.fs = self.path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def __str__(self) -> str:
        return self.path.toString()

    @property
    def name(self) -> str:
        return self.path.getName()

    def beside(self, name: str) -> Place:
        parent = self.path.getParent()
        return Place(self.jvm.org.apache.hadoop.fs.Path(parent, name).toString() if parent else name, self.spark)

    def inside(self, name: str) -> Place:
        return Place(self.jvm.org.apache.hadoop.fs.Path(self.path, name).toString(), self.spark)

    def exists(self) -> bool:
        return self.fs.exists(self.path)

    def is_folder(self) -> bool:
        return self.exists() and self.fs.getFileStatus(self.path).isDirectory()

    def entries(self) -> list[tuple[str, int, bool]]:
        """name, size and whether it is a folder, of what a folder holds, by name."""
        found = [(s.getPath().getName(), s.getLen(), s.isDirectory()) for s in self.fs.listStatus(self.path)]
        return sorted(found)

    def read(self) -> bytes:
        """The content of a small file."""
        stream = self.fs.open(self.path)
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def delete(self) -> None:
        self.fs.delete(self.path, True)

    def rename(self, to: Place) -> None:
        if not self.fs.rename(self.path, to.path):
            raise OSError(f"{self} can't become {to}")

    def make_parent(self) -> None:
        if self.path.getParent() is not None:
            self.fs.mkdirs(self.path.getParent())


def refuse(target: Place, overwrite: bool) -> None:
    if target.exists() and not overwrite:
        raise FileExistsError(f"{target} exists; pass overwrite")


@contextmanager
def replacing(path: str, overwrite: bool = False, spark: SparkSession | None = None) -> Iterator[Place]:
    """A place to write to that becomes the target when the block ends well; else it is deleted and the target stays."""
    target = Place(path, spark)
    refuse(target, overwrite)
    target.make_parent()
    mark = uuid.uuid4().hex
    staged, aside = target.beside(f".{target.name}.new-{mark}"), target.beside(f".{target.name}.old-{mark}")
    try:
        yield staged
        refuse(target, overwrite)
        there = target.exists()
        if there:
            target.rename(aside)
        try:
            staged.rename(target)
        except BaseException:
            if there:
                aside.rename(target)
            raise
        if there:
            aside.delete()
    finally:
        if staged.exists():
            staged.delete()


def write_text(text: str, path: str, overwrite: bool = False, spark: SparkSession | None = None) -> None:
    """A small text as a file."""
    with replacing(path, overwrite, spark) as staged:
        _copied(staged, text.encode())


def _copied(to: Place, head: bytes = b"", parts: list[tuple[Place, int]] = (), tail: bytes = b"") -> None:
    """A file of a beginning, the first bytes of other files, and an end. Bytes go through, rows don't."""
    # no checksum files beside the target
    to.fs.setWriteChecksum(False)
    out = to.fs.create(to.path, True)
    try:
        out.write(head)
        for part, size in parts:
            stream = part.fs.open(part.path, BUFFER)
            try:
                to.jvm.org.apache.commons.io.IOUtils.copyLarge(stream, out, 0, size)
            finally:
                stream.close()
        out.write(tail)
    finally:
        out.close()
        to.fs.setWriteChecksum(True)


def write_lines(lines: DataFrame, path: str, *, overwrite: bool = False, between: str = "\n", head: str = "", tail: str | None = None, parts: bool = False) -> int:
    """The values of a string column in the order of its rows, and how many they are. Null is an empty line.

    Spark's own writer makes one part of each partition of the sorted rows, in order, under its commit protocol, so a task that is
    run again leaves one part. With ``parts`` the target is the folder of these, each value followed by a line feed (or by
    ``between``). Else their bytes are copied, one part after the other, to one file that begins with ``head``; with a
    ``tail`` it comes in place of what would stand behind the last value.
    """
    spark = lines.sparkSession
    (column,) = lines.columns
    from pyspark.sql import Observation

    seen = Observation()
    lines = lines.select(F.coalesce(F.col(column), F.lit("")).alias("value")).observe(seen, F.count(F.lit(1)).alias("n"))
    with replacing(path, overwrite, spark) as staged:
        if parts:
            lines.write.option("lineSep", between).text(str(staged))
            return seen.get["n"]
        folder = staged.beside(staged.name + ".parts")
        try:
            lines.write.option("lineSep", between).text(str(folder))
            found = [(folder.inside(name), size) for name, size, _ in folder.entries() if name.startswith("part-") and size]
            if tail is not None and found:
                found[-1] = found[-1][0], found[-1][1] - len(between.encode())
            _copied(staged, head.encode(), found, (tail or "").encode())
        finally:
            folder.delete()
    return seen.get["n"]
