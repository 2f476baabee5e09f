"""Session settings and durable intermediate tables."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

SQL_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split skewed join partitions even where that costs one more exchange
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # texts can be long: small batches keep Python workers small
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.execution.arrow.maxBytesPerBatch": "4m",
    # of two equal keys in a JSON object the last one counts
    "spark.sql.variant.allowDuplicateKeys": "true",
}


def build_session(app: str = "findmill", master: str | None = None, **extra: str) -> SparkSession:
    """A session with the settings the operators are tuned for."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SQL_SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables: ``spark.checkpoint.dir``.

    Only a local-mode session without the setting gets a folder of its own; on a
    cluster a machine-local folder would be lost with its machine.
    """
    settings = spark.sparkContext.getConf()
    folder = (
        settings.get("spark.checkpoint.dir", None)
        or spark.conf.get("spark.checkpoint.dir", None)
        or spark.conf.get("findmill.local.folder", None)
    )
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="findmill-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    spark.conf.set("findmill.local.folder", folder)
    return folder


def durable(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    Cuts lineage and survives executor loss; being Parquet, later stages still
    prune columns and push filters.  ``options`` go to the writer.
    """
    spark = df.sparkSession
    path = os.path.join(shared_folder(spark), f"{name}-{uuid.uuid4().hex}")
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, as ``--py-files`` would.

    Needed only where it is not installed on the workers; done once per session.
    """
    if spark.conf.get("findmill.shipped", None):
        return
    root = Path(__file__).resolve().parent
    archive = shutil.make_archive(
        os.path.join(tempfile.mkdtemp(prefix="findmill-py-"), "findmill"),
        "zip", root_dir=root.parent, base_dir=root.name,
    )
    spark.sparkContext.addPyFile(archive)
    spark.conf.set("findmill.shipped", "true")


def prepare(spark: SparkSession) -> None:
    """Bring a session made elsewhere to the settings of ``build_session``."""
    for key, value in SQL_SETTINGS.items():
        spark.conf.set(key, value)
    ship_package(spark)
