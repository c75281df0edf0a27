"""Session helpers: defaults for local runs and the reliable checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession


def build_session(app_name: str = "clauselake", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings the operators expect (UTC, AQE, Arrow).

    Shuffle partitions are left to the cluster unless given: AQE coalesces small
    ones and splits skewed ones at run time.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # Parsing makes few bytes costly: merge small partitions only down to one per core.
        "spark.sql.adaptive.coalescePartitions.parallelismFirst": "true",
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.python.sql.dataFrameDebugging.enabled": "false",  # no stack capture per expression
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Folder for reliable checkpoints.

    A cluster names its shared folder in ``spark.checkpoint.dir``. Only a local
    run without that setting gets a folder of its own.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if configured:
        if not current:
            context.setCheckpointDir(configured)
        return configured
    if current:
        return current
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="spark-checkpoint-", dir=os.environ.get("TMPDIR", "/tmp"))
    context.setCheckpointDir(folder)
    return folder


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send the library to the Python workers once per application; results are read in UTC."""
    application = spark.sparkContext.applicationId
    if application in _shipped:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    home = os.path.dirname(package)
    archive = os.path.join(tempfile.mkdtemp(prefix="clauselake-"), "clauselake.zip")
    with zipfile.ZipFile(archive, "w") as bundle:
        for folder, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    bundle.write(path, os.path.relpath(path, home))
    spark.sparkContext.addPyFile(archive)
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    _shipped.add(application)
