"""Tables of one memory in a folder: versions written aside, then named by a numbered pointer.

A reader sees the version the highest pointer names, so a change of several tables is
seen whole or not at all; old versions stay until :meth:`Store.vacuum`.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession


class ConflictError(RuntimeError):
    """Another writer was faster; nothing has changed."""


class Store:
    """Named tables below ``folder`` (any file system Spark can reach)."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def _numbers(self, ending: str) -> list[int]:
        if not self._fs.exists(self._path(self.folder)):
            return []
        names = [f.getPath().getName() for f in self._fs.listStatus(self._path(self.folder))]
        return [int(n[1 : -len(ending)]) for n in names if n.startswith("v") and n.endswith(ending)]

    def _current(self) -> int:
        return max(self._numbers(".json"), default=0)

    def _pointer(self, number: int | None = None) -> dict[str, str]:
        number = self._current() if number is None else number
        if not number:
            return {}
        return json.loads("".join(r["value"] for r in self.spark.read.text(f"{self.folder}/v{number:09d}.json").collect()))

    def tables(self) -> list[str]:
        return sorted(self._pointer())

    def read(self, name: str) -> DataFrame | None:
        path = self._pointer().get(name)
        return None if path is None else self.spark.read.parquet(path)

    def write(self, **tables: DataFrame) -> None:
        """Replace some tables at once; each may be computed from the versions before."""
        base = self._current()
        fresh = {}
        for name, df in tables.items():
            fresh[name] = f"{self.folder}/{name}/{uuid.uuid4().hex}"
            df.write.parquet(fresh[name])
        # The claim is made without overwriting, so one writer gets each number; a reader sees no pointer before it is whole.
        claim = self._path(f"{self.folder}/v{base + 1:09d}.claim")
        try:
            self._fs.create(claim, False).close()
        except Exception as e:
            raise ConflictError(f"version {base + 1} of {self.folder} is another writer's; read again and repeat, or unlock() after a broken write") from e
        if self._current() != base:
            raise ConflictError(f"{self.folder} has changed since it was read")
        aside = self._path(f"{self.folder}/.next-{uuid.uuid4().hex}")
        out = self._fs.create(aside)
        out.write(bytearray(json.dumps(self._pointer(base) | fresh).encode()))
        out.close()
        if not self._fs.rename(aside, self._path(f"{self.folder}/v{base + 1:09d}.json")):
            raise OSError("the pointer couldn't be put in place")

    def unlock(self) -> None:
        """Drop claims of writers that broke off; only when no one is writing."""
        done = set(self._numbers(".json"))
        for n in self._numbers(".claim"):
            if n not in done:
                self._fs.delete(self._path(f"{self.folder}/v{n:09d}.claim"), False)

    def vacuum(self) -> int:
        """Delete versions that no pointer names; returns how many."""
        live, gone = set(self._pointer().values()), 0
        for name in self.tables():
            for status in self._fs.listStatus(self._path(f"{self.folder}/{name}")):
                if not any(status.getPath().toString().endswith(p.removeprefix("file://")) for p in live):
                    self._fs.delete(status.getPath(), True)
                    gone += 1
        return gone
