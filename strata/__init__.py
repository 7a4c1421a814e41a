"""strata: deterministic, parameterised Spark DataFrame operators for
validity-period joins, ordered rule cascades, performance tables across
cut-offs, workload apportionment, quota sampling, banded dealing, calendar
assignment and batch text enrichment."""

__version__ = "0.1.0"
