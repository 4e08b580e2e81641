"""Session settings and the shared scratch folder."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings every operator relies on. Shuffle width and memory are left to the cluster.
REQUIRED_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


_SHIPPED = "mnemora.shipped"


def configure(spark: SparkSession) -> SparkSession:
    """Apply the required runtime settings and send this package to the Python workers, once per session."""
    if spark.conf.get(_SHIPPED, None) == spark.sparkContext.applicationId:
        return spark
    for key, value in REQUIRED_CONF.items():
        spark.conf.set(key, value)
    package = os.path.dirname(os.path.abspath(__file__))
    archive = shutil.make_archive(
        os.path.join(tempfile.mkdtemp(prefix="mnemora-"), "mnemora"),
        "zip",
        root_dir=os.path.dirname(package),
        base_dir=os.path.basename(package),
    )
    spark.sparkContext.addPyFile(archive)
    spark.conf.set(_SHIPPED, spark.sparkContext.applicationId)
    return spark


def build_session(app: str = "mnemora", master: str | None = None, **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**REQUIRED_CONF, **extra}.items():
        builder = builder.config(key, value)
    return configure(builder.getOrCreate())


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder named by ``spark.checkpoint.dir``.

    Only a local master may fall back to a machine-local folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        base = tempfile.mkdtemp(prefix="mnemora-")
    return os.path.join(base, f"{name}-{uuid.uuid4().hex}")
