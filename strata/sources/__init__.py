from strata.sources.sinks import conform, save_table, write_parquet
from strata.sources.tables import TABLE_NAMES, Tables

__all__ = ["TABLE_NAMES", "Tables", "conform", "save_table", "write_parquet"]
