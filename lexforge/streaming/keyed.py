"""A durable table of counts by key that batches are added to, each exactly once.

Every batch is a segment: a Parquet folder of its own. A manifest names the segments that count, with their batches, and only a
manifest makes a segment count; manifests are numbered, each written beside its place and renamed to it, so a number is
taken once and whole. A batch that a manifest covers already is passed over, one that failed on its way left a folder that nothing
names and is written anew.

Segments have levels. When a level has ``FAN`` of them, their sum becomes one segment of the next level, by another manifest:
after n batches a reader adds up fewer than FAN segments on each of log(n) levels, and each count is written once a level. A crash
during a merge leaves the old segments in the manifest. Segments that the last ``KEPT`` manifests don't name are deleted by
``vacuum``, which a merge runs; until then readers of an older state go on.

One writer at a time: a second one finds its manifest's number taken and fails, without harm.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import files

FAN, KEPT = 8, 3


class Counts:
    """The table at a path. keys: its key columns; count is the column that is added up."""

    def __init__(self, spark: SparkSession, path: str, keys: tuple[str, ...] = ("word",), count: str = "count", fan: int = FAN):
        if fan < 2:
            raise ValueError("fan must be at least 2")
        self.spark, self.path, self.keys, self.count, self.fan = spark, path.rstrip("/"), tuple(keys), count, fan

    # --- manifests ---

    def _place(self, *names: str) -> files.Place:
        return files.Place("/".join((self.path, *names)), self.spark)

    def _numbers(self) -> list[int]:
        folder = self._place("manifests")
        return [int(name.removesuffix(".json")) for name, _, _ in folder.entries() if name.endswith(".json") and not name.startswith(".")] if folder.exists() else []

    def _manifest(self, number: int) -> dict:
        return json.loads(self._place("manifests", f"{number:012}.json").read())

    def state(self) -> tuple[int, list[dict]]:
        """The last manifest's number and its segments: folder, first and last batch, level. 0 and none of a new table."""
        numbers = self._numbers()
        return (max(numbers), self._manifest(max(numbers))["segments"]) if numbers else (0, [])

    def _commit(self, number: int, segments: list[dict]) -> None:
        """Makes a manifest the one after number; fails if another writer has done so."""
        target = self._place("manifests", f"{number + 1:012}.json")
        staged = self._place("manifests", f".{number + 1:012}-{uuid.uuid4().hex}.json")
        target.make_parent()
        files._copied(staged, json.dumps({"schema": self._schema, "segments": segments}).encode())
        try:
            files.refuse(target, False)
            staged.rename(target)
        finally:
            if staged.exists():
                staged.delete()

    # --- writing ---

    def _segment(self, rows: DataFrame, first: int, last: int, level: int) -> dict:
        folder = f"segments/{level}-{first}-{last}-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{folder}")
        self._schema = rows.schema.simpleString()
        return {"folder": folder, "first": first, "last": last, "level": level}

    def add(self, rows: DataFrame, batch: int) -> bool:
        """Adds a batch's counts, unless the table has them; whether it did. Batches come in the order of their numbers."""
        number, segments = self.state()
        if segments and batch <= max(s["last"] for s in segments):
            return False
        rows = rows.select(*self.keys, F.col(self.count).cast("long").alias(self.count))
        self._commit(number, [*segments, self._segment(rows, batch, batch, 0)])
        self.merge()
        return True

    def merge(self) -> None:
        """Merges full levels."""
        number, segments = self.state()
        level = 0
        while any(s["level"] >= level for s in segments):
            full = [s for s in segments if s["level"] == level]
            if len(full) >= self.fan:
                new = self._segment(self._summed(full), full[0]["first"], full[-1]["last"], level + 1)
                segments = sorted([new, *(s for s in segments if s not in full)], key=lambda s: s["first"])
                self._commit(number, segments)
                number += 1
                self.vacuum()
            level += 1

    def vacuum(self) -> None:
        """Deletes what no manifest but older ones than the last KEPT names, and those manifests."""
        numbers = sorted(self._numbers())
        named = {s["folder"].rpartition("/")[2] for n in numbers[-KEPT:] for s in self._manifest(n)["segments"]}
        folder = self._place("segments")
        for name, _, _ in folder.entries() if folder.exists() else []:
            if name not in named:
                folder.inside(name).delete()
        for n in numbers[:-KEPT]:
            self._place("manifests", f"{n:012}.json").delete()

    # --- reading ---

    def _summed(self, segments: list[dict]) -> DataFrame:
        rows = self.spark.read.parquet(*[f"{self.path}/{s['folder']}" for s in segments])
        return rows.groupBy(*self.keys).agg(F.sum(self.count).cast("long").alias(self.count))

    def read(self) -> DataFrame:
        """The counts of all batches so far."""
        _, segments = self.state()
        if not segments:
            raise FileNotFoundError(f"{self.path} has no batch yet")
        if len(segments) == 1:
            return self.spark.read.parquet(f"{self.path}/{segments[0]['folder']}")
        return self._summed(segments)
