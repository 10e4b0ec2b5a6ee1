"""SparkSession construction and shared-storage helpers."""

from __future__ import annotations

import os
import tempfile

from pyspark import SparkConf
from pyspark.sql import SparkSession


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "issuelens") -> SparkSession:
    """Session with the settings every job here assumes.

    A session that runs is used as it is, but for the arguments given.  For a
    new one, spark-submit's settings hold and the values here fill in what
    is unset.  A UTC time zone keeps timestamps identical on every executor.
    """
    spark = SparkSession.getActiveSession()
    if spark is None:
        submitted = SparkConf()
        wanted = {
            "spark.sql.session.timeZone": "UTC",
            "spark.sql.execution.arrow.pyspark.enabled": "true",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        }
        if (master or submitted.get("spark.master", "local")).startswith("local"):
            wanted["spark.driver.memory"] = "16g"  # one JVM does all the work
        b = SparkSession.builder.appName(app_name)
        if master:
            b = b.master(master)
        spark = b.config(map={k: v for k, v in wanted.items() if not submitted.contains(k)}).getOrCreate()
    if shuffle_partitions:
        spark.conf.set("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    The cluster's setting always wins.  Where it is unset, a local run gets a
    private folder; on a cluster that is an error, as each machine would
    write a folder of its own.
    """
    current = spark.conf.get("spark.checkpoint.dir", None)
    if not current:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        current = tempfile.mkdtemp(prefix="issuelens-ckpt-")
        spark.conf.set("spark.checkpoint.dir", current)
    spark.sparkContext.setCheckpointDir(current)
    return current


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path for intermediate tables in the shared checkpoint folder."""
    base = ensure_checkpoint_dir(spark)
    return f"{base.rstrip('/')}/{name}"


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``issuelens`` importable in every Python worker (once per app).

    Zips the package's sources on the driver and registers the archive
    with ``addPyFile`` (what ``--py-files`` does at submit time), so UDFs,
    ``mapInArrow`` kernels and ``foreachBatch`` bodies resolve on executors
    whatever their working directory.
    """
    import zipfile

    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg)
    out = os.path.join(tempfile.mkdtemp(prefix="issuelens-code-"), "issuelens.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for dirpath, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(dirpath, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(out)
    _SHIPPED.add(sc.applicationId)
