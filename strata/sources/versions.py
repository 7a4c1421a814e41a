"""Tables that are replaced as a whole or created once, and never seen half-written.

A table is a folder of versions. A version's rows are written to a folder of
its own, then an entry in the log names it; only that entry makes it the
current one. Whoever reads finds the newest entry and reads its folder, so a
write that ends half-way (a lost driver, a failing task) leaves the table as it
was, and readers of the old version are not disturbed by a new one. The entry
is created only if it does not exist, so of two writers one is told.

An entry also has the fingerprint of the files the version was made from. A
table that is created once is thereby known to be stale when an input changes,
instead of answering from an old snapshot for ever.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession

_LOG = "_log"


class Conflict(RuntimeError):
    """Another writer made the version in the meantime."""


class VersionedTable:
    """A table in ``path``; see the module."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    # ---------------------------------------------------------------- files
    def _fs(self, path: str):
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark._jsc.hadoopConfiguration()), target

    def _names(self, folder: str) -> list[str]:
        fs, target = self._fs(folder)
        return sorted(s.getPath().getName() for s in fs.listStatus(target)) if fs.exists(target) else []

    def _entries(self) -> list[dict]:
        """Complete log entries, oldest first; one that is still being written does not count."""
        out = []
        for name in self._names(f"{self.path}/{_LOG}"):
            if not name.endswith(".json"):
                continue
            fs, target = self._fs(f"{self.path}/{_LOG}/{name}")
            stream = fs.open(target)
            try:
                text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            finally:
                stream.close()
            try:
                out.append(json.loads(text))
            except ValueError:
                continue
        return out

    def fingerprint(self, inputs: Iterable[DataFrame]) -> str:
        """A digest of the names, sizes and times of the files that ``inputs`` read."""
        seen = []
        for df in inputs:
            for file in df.inputFiles():
                fs, target = self._fs(file)
                status = fs.getFileStatus(target)
                seen.append(f"{status.getPath()}|{status.getLen()}|{status.getModificationTime()}")
        return hashlib.sha256("\n".join(sorted(set(seen))).encode()).hexdigest()

    # --------------------------------------------------------------- reading
    @property
    def version(self) -> int | None:
        entries = self._entries()
        return entries[-1]["version"] if entries else None

    def read(self, version: int | None = None) -> DataFrame:
        """The current rows, or those of an earlier version that is still kept."""
        found = [e for e in self._entries() if version is None or e["version"] == version]
        if not found:
            raise FileNotFoundError(f"{self.path} has no version {'yet' if version is None else version}")
        return self.spark.read.parquet(f"{self.path}/{found[-1]['folder']}")

    def is_stale(self, inputs: Iterable[DataFrame]) -> bool:
        """There is no version, or it was made from other files than ``inputs`` read now."""
        entries = self._entries()
        return not entries or entries[-1]["inputs"] != self.fingerprint(inputs)

    # --------------------------------------------------------------- writing
    def replace(self, df: DataFrame, inputs: Iterable[DataFrame] = (), partition_by: Iterable[str] = ()) -> int:
        """Write ``df`` as the next version, and make it the current one once it is complete.

        ``df`` may read the table's current version. Its inputs are taken down before
        it is written, so that a change meanwhile makes the result stale, not fresh.
        """
        inputs = self.fingerprint(inputs)
        number = (self.version or 0) + 1
        folder = f"v{number:08d}-{uuid.uuid4().hex}"
        writer = df.write.mode("error")
        if list(partition_by):
            writer = writer.partitionBy(*partition_by)
        writer.parquet(f"{self.path}/{folder}")
        fs, target = self._fs(f"{self.path}/{_LOG}/{number:08d}.json")
        try:
            stream = fs.create(target, False)
        except Exception as e:
            if "AlreadyExists" in str(e) or "already exists" in str(e):
                raise Conflict(f"version {number} of {self.path} was made by another writer") from e
            raise
        stream.write(bytearray(json.dumps({"version": number, "folder": folder, "inputs": inputs}).encode()))
        stream.close()
        return number

    def create_once(self, build: Callable[[], DataFrame], inputs: Iterable[DataFrame] = ()) -> DataFrame:
        """The table's rows; ``build`` is asked for them only if there are none or they are stale.
        Another writer's version made meanwhile is taken as it is."""
        inputs = list(inputs)
        if self.is_stale(inputs):
            try:
                self.replace(build(), inputs)
            except Conflict:
                pass
        return self.read()

    def vacuum(self, keep: int = 1) -> list[str]:
        """Delete the folders of all but the newest ``keep`` versions, and those of writes that did
        not end (run it while nothing writes); the folders' names."""
        entries = self._entries()
        kept = {e["folder"] for e in entries[-keep:]}
        gone = [n for n in self._names(self.path) if n != _LOG and n not in kept]
        for name in gone:
            fs, target = self._fs(f"{self.path}/{name}")
            fs.delete(target, True)
        for e in entries[:-keep]:
            fs, target = self._fs(f"{self.path}/{_LOG}/{e['version']:08d}.json")
            fs.delete(target, False)
        return gone
