"""Helpers shared by the operators of this subpackage."""
from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import tonality
from tonality.session import ensure_checkpoint_dir, scratch_dir

__all__ = ["ensure_checkpoint_dir", "scratch_dir", "ship", "table", "saved", "scalar"]

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package's source to the executors (``SparkContext.addPyFile``), once per
    application, so that functions run in tasks can be imported there."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(tonality.__file__))
    out = os.path.join(tempfile.mkdtemp(prefix="tonality-src-"), "tonality_src.zip")
    with zipfile.ZipFile(out, "w") as z:
        for folder, _, names in os.walk(root):
            for n in sorted(names):
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    spark.sparkContext.addPyFile(out)
    _SHIPPED.add(app)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: later jobs start
    from files that survive the loss of executors instead of recomputing their inputs."""
    spark = df.sparkSession
    path = scratch_dir(spark, name)
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def scalar(df: DataFrame, *aggs):
    """The single row of a global aggregate, as a tuple."""
    return tuple(df.agg(*aggs).first())


def text_or_empty(col: str = "text"):
    return F.coalesce(F.col(col), F.lit(""))
