"""Session helpers: a configured SparkSession and folders for intermediate results.

On a cluster the session is created by the platform; these helpers only fill in
settings that are unset (tests, bench) and never replace cluster settings.
"""
from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import SparkSession

_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, shuffle_partitions: int = 8,
                app_name: str = "tonality") -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in _DEFAULTS.items():
        builder = builder.config(k, v)
    builder = builder.config("spark.driver.memory", os.environ.get("TONALITY_DRIVER_MEMORY", "16g"))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    A cluster names a folder there that the driver and all executors share.  Where it is
    unset, a scratch folder is made only for a local master (tests); on any other master
    this raises, because a machine-local folder would leave each executor's files where
    nobody else can read them.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.conf.get("spark.master", "")
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by the driver and all executors")
        path = tempfile.mkdtemp(prefix="tonality-ckpt-")
        spark.conf.set("spark.checkpoint.dir", path)
    try:
        spark.sparkContext.setCheckpointDir(path)
    except AttributeError:  # a Connect session has no SparkContext; the conf is enough
        pass
    return path


def scratch_root(spark: SparkSession) -> str:
    """The folder of this application's intermediate results, inside the shared folder."""
    app = spark.conf.get("spark.app.id", "app")
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/tonality-{app}"


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder name for one intermediate result of this application."""
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def clear_scratch(spark: SparkSession) -> bool:
    """Delete this application's intermediate results.  Results are read from them lazily, so
    call it when what was asked for has been written or collected; handles made before are
    void afterwards.  Tells whether there was anything."""
    root = spark._jvm.org.apache.hadoop.fs.Path(scratch_root(spark))
    return root.getFileSystem(spark._jsc.hadoopConfiguration()).delete(root, True)
