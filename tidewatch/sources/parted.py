"""Tables of Parquet files kept by parts of a key hash, so that a write touches only the parts that its keys fall into.

A folder holds data/<write>/part=<n> and versions/<n>, one small text file per version that names, for each
part, the folder that holds it. A version's file is created only if it doesn't exist: of two writers that
started from the same version the second gets a Conflict and may try again; its data were never visible.
That holds where the file system creates files atomically (local, HDFS). Readers see whole versions.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Conflict(RuntimeError):
    """Another writer has made the version that this write was to become."""


def part_of(key: str, parts: int) -> Column:
    """The part of a key: the first 32 bits of its md5, so that other engines agree on it."""
    return (F.conv(F.left(F.md5(F.col(key).cast("string")), F.lit(8)), 16, 10).cast("long") % parts).cast("int")


def parts_for(n_bytes: int, target: int = 256 << 20) -> int:
    return max(1, -(-n_bytes // target))


@dataclass(frozen=True)
class Version:
    number: int
    parts: int
    #: part -> folder below the table's
    folders: dict[int, str]


class PartedTable:
    def __init__(self, spark: SparkSession, root: str, key: str):
        self.spark, self.root, self.key = spark, root.rstrip("/"), key

    def _path(self, place: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(place)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def version(self) -> Version | None:
        """The last version; one listing and one small file."""
        path, fs = self._path(f"{self.root}/versions")
        found = [int(n) for n in (f.getPath().getName() for f in fs.listStatus(path)) if n.isdigit()] if fs.exists(path) else []
        if not found:
            return None
        text = self.spark.read.option("wholetext", True).text(f"{self.root}/versions/{max(found)}").first()[0]
        said = json.loads(text)
        return Version(max(found), said["parts"], {int(k): v for k, v in said["folders"].items()})

    def read(self, only: set[int] | None = None, at: Version | None = None) -> DataFrame | None:
        """The table, or the parts named; None if there is no version, or nothing of these parts."""
        at = at or self.version()
        paths = sorted(f"{self.root}/{f}/part={p}" for p, f in at.folders.items() if only is None or p in only) if at else []
        return self.spark.read.parquet(*paths) if paths else None

    def _commit(self, number: int, parts: int, folders: dict[int, str]) -> Version:
        path, fs = self._path(f"{self.root}/versions/{number}")
        try:
            out = fs.create(path, False)
        except Exception as e:
            if "already exists" in str(e).lower() or "AlreadyExists" in str(e):
                raise Conflict(f"version {number} of {self.root} exists") from e
            raise
        out.write(bytearray(json.dumps({"parts": parts, "folders": {str(k): v for k, v in folders.items()}}).encode()))
        out.close()
        return Version(number, parts, folders)

    def _write(self, rows: DataFrame, parts: int, split: int) -> dict[int, str]:
        """Write rows by part, each part by `split` tasks; says which parts have any."""
        folder = f"data/{uuid.uuid4().hex}"
        placed = rows.withColumn("part", part_of(self.key, parts))
        spread = placed.repartition("part", F.pmod(F.xxhash64(self.key), F.lit(split)))
        spread.write.partitionBy("part").parquet(f"{self.root}/{folder}")
        path, fs = self._path(f"{self.root}/{folder}")
        names = [f.getPath().getName() for f in fs.listStatus(path)]
        return {int(n.removeprefix("part=")): folder for n in names if n.startswith("part=")}

    def create(self, rows: DataFrame, parts: int, split: int = 1) -> Version:
        """The first version; a Conflict if there is one."""
        if parts < 1 or split < 1:
            raise ValueError("parts and split must be positive")
        return self._commit(0, parts, self._write(rows, parts, split))

    def rewrite(self, keys: DataFrame, change: Callable[[DataFrame | None], DataFrame], at: Version | None = None, split: int = 1) -> list[int]:
        """Rewrite the parts that keys fall into with what `change` makes of their rows; says which these are.

        Nothing else is read or written. `at` is the version that the change was decided on; where another has
        come since, the write fails with a Conflict. No keys, no version. The driver holds a number per part.
        """
        at = at or self.version()
        if at is None:
            raise ValueError(f"{self.root} has no version")
        touched = {r.part for r in keys.select(part_of(self.key, at.parts).alias("part")).distinct().collect()}
        if touched:
            written = self._write(change(self.read(touched, at)), at.parts, split)
            stray = set(written) - touched
            if stray:
                raise ValueError(f"rows outside the parts that the keys fall into: {sorted(stray)}")
            self._commit(at.number + 1, at.parts, {**{p: f for p, f in at.folders.items() if p not in touched}, **written})
        return sorted(touched)

    def merge(self, incoming: DataFrame, merge: Callable[[DataFrame | None, DataFrame], DataFrame], parts: int = 16, tries: int = 3, keys: DataFrame | None = None) -> list[int]:
        """Merge rows into the table: merge(rows of the parts touched or None, incoming) gives what stays. A Conflict is tried again on the version that caused it.

        `keys` are the keys of incoming, where they are at hand already: rows of other keys then stay as they are and
        aren't given to merge.
        """
        for left in range(tries, 0, -1):
            at = self.version()
            try:
                if at is None:
                    return sorted(self.create(merge(None, incoming), parts).folders)
                if keys is None:
                    return self.rewrite(incoming, lambda now: merge(now, incoming), at)
                own = keys.select(self.key)
                beside = lambda now: now.join(own, self.key, "left_anti").unionByName(merge(now.join(own, self.key, "left_semi"), incoming), allowMissingColumns=True)  # noqa: E731, B023
                return self.rewrite(own, lambda now: merge(None, incoming) if now is None else beside(now), at)  # noqa: B023
            except Conflict:
                if left == 1:
                    raise
        return []

    def delete(self, gone: DataFrame, at: Version | None = None) -> list[int]:
        """Delete the rows of these keys, rewriting only the parts that hold any of them."""
        at = at or self.version()
        if at is None:
            return []
        keys = gone.select(self.key).distinct()
        asked = {r.part for r in keys.select(part_of(self.key, at.parts).alias("part")).distinct().collect()}
        held = self.read(asked, at)
        if held is None:
            return []
        return self.rewrite(keys.join(held.select(self.key), self.key, "left_semi"), lambda now: now.join(keys, self.key, "left_anti"), at)

    def drop_old(self, keep: int = 2) -> None:
        """Delete versions but the last ones, and data that none of those names. Not while another writer is at work."""
        path, fs = self._path(f"{self.root}/versions")
        numbers = sorted(int(f.getPath().getName()) for f in fs.listStatus(path) if f.getPath().getName().isdigit())
        live: set[str] = set()
        for n in numbers[-keep:]:
            text = self.spark.read.option("wholetext", True).text(f"{self.root}/versions/{n}").first()[0]
            live |= set(json.loads(text)["folders"].values())
        for n in numbers[:-keep]:
            fs.delete(self._path(f"{self.root}/versions/{n}")[0], False)
        data, _ = self._path(f"{self.root}/data")
        for f in fs.listStatus(data):
            if f"data/{f.getPath().getName()}" not in live:
                fs.delete(f.getPath(), True)
