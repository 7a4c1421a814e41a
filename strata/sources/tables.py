"""Table access. Operators take DataFrames; this is the only place paths live."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLE_NAMES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
               "events", "documents", "embeddings", "pages", "benchmark", "labels",
               "conversations")


class Tables:
    """Lazy parquet readers for one data folder.

    Nothing is read until a plan runs; Catalyst prunes columns and pushes
    filters into each scan, so handing a whole table to an operator is free.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")
        self._memo: dict = {}

    def memo(self, key, build):
        """Build a derived relation once per ``Tables`` (i.e. per query plan),
        so a fixture used by several branches is planned and materialized once."""
        if key not in self._memo:
            self._memo[key] = build()
        return self._memo[key]

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in TABLE_NAMES:
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.root}/{name}.parquet")

    def table(self, name: str) -> DataFrame:
        return getattr(self, name)


class CatalogTables(Tables):
    """The same tables by name from the session's catalog (``database.table``)."""

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in TABLE_NAMES:
            raise AttributeError(name)
        return self.spark.table(f"{self.root}.{name}")
