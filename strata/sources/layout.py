"""Tables stored for the filters that will be asked of them.

Rows go to one folder per value of the partition columns and are sorted inside
it, dealt out by ranges of the sort columns. A filter on partition columns
leaves whole folders out, one on the leading sort columns leaves out files and
row groups by their minimum and maximum. Null partition values have a folder of
their own and come back as nulls (so do empty strings, which folders cannot tell
from them).
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from strata.operators.ordered import _num_ranges
from strata.session import ensure_checkpoint_dir

#: how the columns' order and types are kept beside the rows
SCHEMA_FILE = "_layout"


def write_layout(df: DataFrame, partition_by: Sequence[str], sort_by: Sequence[str], path: str | None = None, ranges: int | None = None) -> str:
    """Write ``df`` once and return its folder (of its own in the shared checkpoint folder if none is named).

    ``ranges``: tasks the rows are dealt to, by default as many as the size of the tables
    read asks for, and the shuffle partitions at least. Rows are dealt by the partition columns and the sort columns together, so a value
    that holds much of the table is split over many files, while a small one is
    in few.
    """
    spark = df.sparkSession
    path = path or f"{ensure_checkpoint_dir(spark).rstrip('/')}/tables/layout-{uuid.uuid4().hex}"
    ranges = _num_ranges(df, ranges)
    order = [*partition_by, *(c for c in sort_by if c not in partition_by)]
    df.repartitionByRange(ranges, *order).sortWithinPartitions(*order).write.partitionBy(*partition_by).mode("error").parquet(path)
    spark.createDataFrame([(df.schema.json(),)], "schema string").coalesce(1).write.mode("overwrite").json(f"{path}/{SCHEMA_FILE}")
    return path


def read_layout(spark: SparkSession, path: str) -> DataFrame:
    """The table written by :func:`write_layout`, with its columns in their order and types."""
    kept = spark.read.schema("schema string").json(f"{path}/{SCHEMA_FILE}").first()["schema"]
    schema = T.StructType.fromJson(json.loads(kept))
    return spark.read.schema(schema).parquet(path).select(*schema.names)
