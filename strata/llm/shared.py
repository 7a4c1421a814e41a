"""Tables in the shared folder the session names in ``spark.checkpoint.dir``.

An intermediate result that several jobs read, or that must not be recomputed
with other bounds, is written once as Parquet and read back. That cuts its
lineage: after the loss of an executor only files are read again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from strata.session import ensure_checkpoint_dir, note_table

FILE_BYTES = 8 << 20


class Scratch:
    """A folder of its own for the tables of one operator call; ``strata.session.release_tables`` deletes it."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = note_table(spark, f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}")
        self._n = 0

    def path(self, name: str) -> str:
        self._n += 1
        return f"{self.root}/{self._n:03d}-{name}"

    def table(self, df: DataFrame, name: str, files: int | None = None) -> DataFrame:
        """``df`` written once, by ``files`` tasks at most, and read back."""
        path = self.path(name)
        (df if files is None else df.coalesce(files)).write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def files(self, *tables: DataFrame) -> int:
        """How many tasks write a table about as large as ``tables`` together: 8 MB each, and no fewer than there are cores.
        However many partitions a shuffle has, a small table is then not cut into as many files."""
        paths = [self.spark._jvm.org.apache.hadoop.fs.Path(t._scratch_path) for t in tables]
        conf = self.spark._jsc.hadoopConfiguration()
        size = sum(p.getFileSystem(conf).getContentSummary(p).getLength() for p in paths)
        return max(self.spark.sparkContext.defaultParallelism, -(-size // FILE_BYTES))

    def drop(self, df: DataFrame) -> None:
        """Delete the files of a table that nothing reads any more."""
        remove(self.spark, df._scratch_path)


def remove(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
