"""Session settings and shared storage."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spark removes an execution's shuffle files when it ends; what a written table was made from is not needed again.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_written: list[tuple[SparkSession, str]] = []


def local_session(cores: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and the bench; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("corpusmill")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def reachable(spark: SparkSession) -> SparkSession:
    """Let Python workers on machines that have this folder import the package, wherever the driver was started.

    Elsewhere ship it with --py-files; the entry is harmless there.
    """
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    have = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in have:
        env["PYTHONPATH"] = os.pathsep.join([*have, root])
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or one of our own where that is unset and all tasks run in this process (tests)."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        own = sc.getConf().get("spark.checkpoint.dir")
        if not own and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(own or os.path.join(tempfile.gettempdir(), "corpusmill-shared"))
    return sc.getCheckpointDir()


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Cut the lineage: write df as parquet into the shared folder and read it back. Removed when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/mill-{tag}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before) if before is not None else spark.conf.unset(CLEANUP)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def discard(path_or_df: DataFrame | str) -> None:
    """Remove a materialized table ahead of time."""
    names = [path_or_df] if isinstance(path_or_df, str) else path_or_df.inputFiles()
    for spark, path in list(_written):
        if any(path.rpartition("/")[2] in n for n in names):
            _remove(spark, path)
            _written.remove((spark, path))


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the JVM is gone; the folder's owner clears it
        pass


@atexit.register
def _cleanup() -> None:
    for spark, path in _written:
        _remove(spark, path)
    _written.clear()


def held(df: DataFrame, limit_rows: int = 200_000) -> DataFrame:
    """df as the side of a join that every task holds, where it is small enough; else as it is, to be shuffled. For rows of a few
    short values, so that the limit stands for some 20 MB. df is planned twice; give it written where that is dear."""
    return F.broadcast(df) if small_enough(df, limit_rows) else df


def small_enough(df: DataFrame, limit_rows: int) -> bool:
    """True when df has at most limit_rows rows, found without reading more than limit_rows + 1 of them."""
    return df.limit(limit_rows + 1).count() <= limit_rows
