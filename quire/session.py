"""Session helpers: building a local session for tests and resolving the
shared checkpoint folder a cluster names in ``spark.checkpoint.dir``."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def _default_heap() -> str:
    """60% of physical memory, at most 16g (local mode: the driver is the
    only JVM)."""
    try:
        with open("/proc/meminfo") as f:
            kb = int(next(line for line in f if line.startswith("MemTotal")).split()[1])
        return f"{max(1, min(16, int(kb / 1024 / 1024 * 0.6)))}g"
    except (OSError, StopIteration, ValueError):
        return "4g"


def build_session(master: str | None = None, partitions: int | None = None) -> SparkSession:
    """Local session used by tests and bench. On a cluster, use the session
    the platform hands you; nothing here is required by the library."""
    cpus = os.environ.get("BENCH_CPUS", "8")
    master = master or f"local[{cpus}]"
    partitions = partitions or int(cpus)
    spark = (
        SparkSession.builder.master(master)
        .appName("quire")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.driver.memory", os.environ.get("QUIRE_DRIVER_MEMORY", _default_heap()))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named in ``spark.checkpoint.dir``. Only a session in
    one process (tests, bench) may leave it unset; it then gets a folder of
    its own. On a cluster an unset folder is an error."""
    sc = spark.sparkContext
    d = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not d:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = tempfile.mkdtemp(prefix="quire-ckpt-", dir="/tmp")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(d)
    return d


_DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint (survives executor loss); never localCheckpoint. The
    files of the shuffles that led to it are dropped once it is written (Spark
    4.1 and later), not when the driver happens to collect its garbage."""
    spark = df.sparkSession
    checkpoint_dir(spark)
    before = spark.conf.get(_DROP_SHUFFLES, None)
    try:
        spark.conf.set(_DROP_SHUFFLES, "true")
        own = df.select("*")  # a plan of its own: nothing else reads its shuffles
    finally:
        if before is None:
            spark.conf.unset(_DROP_SHUFFLES)
        else:
            spark.conf.set(_DROP_SHUFFLES, before)
    return own.checkpoint(eager=True)
