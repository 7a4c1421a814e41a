"""Table sinks: the write modes the reference notebooks use.

* replace (``CREATE OR REPLACE TABLE AS`` / drop-then-create / overwrite)
* create once (``CREATE TABLE IF NOT EXISTS AS``: keep an existing table)
* insert into a declared schema (columns cast to the declared types)
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Select and cast ``df`` to a declared schema, by column name."""
    return df.select(*[df[f.name].cast(f.dataType).alias(f.name) for f in schema.fields])


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite",
                  partition_by: Sequence[str] | None = None) -> None:
    """``mode``: 'overwrite' (replace), 'ignore' (create once), 'append'."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def save_table(df: DataFrame, name: str, mode: str = "overwrite",
               schema: T.StructType | None = None) -> None:
    """Catalog table write; ``schema`` casts to a declared table layout first."""
    if schema is not None:
        df = conform(df, schema)
    df.write.mode(mode).saveAsTable(name)


def declare_table(spark: SparkSession, name: str, schema: T.StructType) -> None:
    """An empty table with a declared layout; one of that name is replaced."""
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    spark.createDataFrame([], schema).write.saveAsTable(name)


def insert_into(df: DataFrame, name: str) -> None:
    """Append to a declared table: columns by name, cast to its types."""
    conform(df, df.sparkSession.table(name).schema).write.insertInto(name)
