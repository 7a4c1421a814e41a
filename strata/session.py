"""Spark session defaults and lineage helpers.

Operators never build a session themselves; they take DataFrames. This module
is for entry points (tests, bench, the driver contract) and for the one
lineage-cutting helper the ordered operators need.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

# Settings that matter for the operators' plans at scale:
#  * AQE re-plans joins from measured stage sizes (size-checked broadcast,
#    partition coalescing) and splits skewed join partitions.
#  * forceOptimizeSkewedJoin lets AQE split a hot join partition even when the
#    split costs an extra shuffle for the aggregate above it; the aggregate then
#    runs partial (map-side) before that shuffle, so a key holding a third of
#    all rows is spread over many tasks instead of one.
SCALE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(master: str = "local[*]", shuffle_partitions: int = 8,
                  app: str = "strata", extra: dict | None = None) -> SparkSession:
    """Session for tests and the bench (local mode, UI off)."""
    builder = (SparkSession.builder.master(master).appName(app)
               .config("spark.ui.enabled", "false")
               .config("spark.ui.showConsoleProgress", "false")
               .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
               .config("spark.driver.memory", "16g"))
    for k, v in {**SCALE_CONF, **(extra or {})}.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder, creating a scratch one only when
    the session names none *and* runs in one JVM (``local``, ``local[n]``: tests, bench).

    On a cluster the folder must be shared storage named by the cluster in
    ``spark.checkpoint.dir``; a machine-local temp folder would not survive the
    loss of the executor that wrote it, so we refuse to invent one there.
    """
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return configured
    if sc.master != "local" and not sc.master.startswith("local["):  # local-cluster has executors of its own
        raise RuntimeError("spark.checkpoint.dir is not set; point it at shared storage")
    path = tempfile.mkdtemp(prefix="strata-ckpt-")
    sc.setCheckpointDir(path)
    return path


# folders of the tables that each application has written here and not released
_WRITTEN: dict[str, list[str]] = {}


def release_tables(spark: SparkSession) -> int:
    """Delete the tables written for this application so far (:func:`materialize`,
    :func:`note_table`), and forget them; their number. For a caller that has stored or
    used its results: DataFrames that read these tables can no longer run."""
    paths = _WRITTEN.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    return len(paths)


def note_table(spark: SparkSession, path: str) -> str:
    """Have :func:`release_tables` delete ``path`` as well."""
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once as a parquet table in the shared checkpoint folder and
    return a DataFrame reading it back: the lineage is cut there.

    Used where several branches of a plan read the same intermediate, and where
    they must see the *same* rows (e.g. a range partitioning whose sampled
    bounds would move if recomputed). Unlike ``DataFrame.checkpoint``, which
    runs its plan once for the action and again to write Java-serialized rows,
    this is a single job writing columnar files; the read-back has exact size
    statistics for the planner, and a lost executor only costs re-reading
    files from shared storage.
    """
    return materialize_counted(df)[0]


def materialize_counted(df: DataFrame) -> tuple[DataFrame, int]:
    """:func:`materialize` that also returns the row count, observed as a
    metric of the write job itself (no second job to count)."""
    root = ensure_checkpoint_dir(df.sparkSession).rstrip("/")
    path = note_table(df.sparkSession, f"{root}/tables/{uuid.uuid4().hex}")
    obs = Observation(f"rows_{uuid.uuid4().hex[:8]}")
    df.observe(obs, F.count(F.lit(1)).alias("n")).write.mode("error").parquet(path)
    return df.sparkSession.read.parquet(path), int(obs.get["n"])
