"""Session helpers.

The library never hard-codes cluster sizing: shuffle partitions, broadcast
threshold and checkpoint folder come from the session. These helpers only fill
in values that are unset (local tests, bench).
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile

from pyspark.sql import SparkSession


def local_session(cores: int | None = None, shuffle_partitions: int | None = None,
                  app: str = "paysift") -> SparkSession:
    """A local session configured the way the tests and the bench expect."""
    cores = cores or int(os.environ.get("BENCH_CPUS", "8"))
    parts = shuffle_partitions or cores * 2
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )


def shuffle_partitions(spark: SparkSession) -> int:
    """``spark.sql.shuffle.partitions`` as a number (falls back to the default parallelism)."""
    try:
        return int(spark.conf.get("spark.sql.shuffle.partitions"))
    except (TypeError, ValueError):
        return spark.sparkContext.defaultParallelism


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared checkpoint folder named by the cluster (``spark.checkpoint.dir``).

    On a cluster this must be a shared file system path and is read from the
    session; without it an error is raised, because executors do not share a
    local folder. Only a local master (tests, bench) gets a scratch folder, one
    per session, removed when the process ends."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
        d = tempfile.mkdtemp(prefix="paysift-ckpt-")
        atexit.register(shutil.rmtree, d, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", d)
    spark.sparkContext.setCheckpointDir(d)
    return d


_SCRATCH: list[tuple] = []


def scratch(spark: SparkSession, path: str) -> str:
    """Name a scratch table of this session: it is removed when the driver process ends.

    Results are lazy, so a table may be read as long as the process lives. A driver that dies
    leaves its tables in the checkpoint folder, which the cluster cleans by age."""
    if not _SCRATCH:
        atexit.register(remove_scratch)
    _SCRATCH.append((spark._jvm, spark._jsc.hadoopConfiguration(), path))
    return path


def remove_scratch() -> None:
    """Remove all scratch tables named so far."""
    while _SCRATCH:
        jvm, conf, path = _SCRATCH.pop()
        try:
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(conf).delete(p, True)
        except Exception:  # noqa: BLE001  the JVM may be gone at exit; nothing depends on this
            return
