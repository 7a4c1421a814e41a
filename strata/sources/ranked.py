"""Results whose order is kept with them.

Files have no order that a reader could rely on: Spark deals them to tasks by
size. An ordered result therefore carries each row's position, is dealt out by
ranges of it and sorted, a file or two per range, none longer than an even share. A page of it reads only the files
and row groups whose positions overlap; reading it all in order is a merge of
sorted ranges.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.operators.ordered import with_global_index
from strata.session import ensure_checkpoint_dir


def write_ranked(df: DataFrame, order: Sequence[Column], path: str | None = None, position: str = "position", ranges: int | None = None) -> str:
    """Store ``df`` in ``order`` (total: ends with a unique key) with 1-based ``position``; the folder."""
    spark = df.sparkSession
    path = path or f"{ensure_checkpoint_dir(spark).rstrip('/')}/tables/ranked-{uuid.uuid4().hex}"
    ranked = with_global_index(df, order, position, num_partitions=ranges).withColumn(position, F.col(position) + 1)
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # range bounds come from a sample, so a range may be longer than others; its file is not
    share = max(1, -(-ranked.count() // ranges))
    ranked.repartitionByRange(ranges, position).sortWithinPartitions(position).write.option("maxRecordsPerFile", share).mode("error").parquet(path)
    return path


def read_ranked(spark: SparkSession, path: str, first: int | None = None, last: int | None = None, position: str = "position") -> DataFrame:
    """The stored rows in order, or those from position ``first`` to ``last``."""
    rows = spark.read.parquet(path)
    if first is not None:
        rows = rows.where(F.col(position) >= first)
    if last is not None:
        rows = rows.where(F.col(position) <= last)
    return rows.orderBy(position)
