"""The reference's only streaming: iterate rows, keep matches, stop early.

Both jobs are Structured Streaming queries over a file source with
``trigger(availableNow=True)``: they process what is there in bounded
micro-batches, survive restarts through their checkpoint folder (in the shared
checkpoint location) and write an append-only file sink."""
from __future__ import annotations

import threading

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tonality.functions.text import contains_keyword
from tonality.sources.files import scratch_path


def _run(stream_df, out_path: str, checkpoint: str) -> None:
    q = (stream_df.writeStream.format("parquet").outputMode("append")
         .option("path", out_path).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))


def stream_keyword_extract(spark: SparkSession, src: str, schema: T.StructType, out_path: str, word: str,
                           text: str = "text", cols=("text",), max_files_per_trigger: int | None = None) -> str:
    """K1: stream rows, keep those whose text contains ``word``, append to a sink.
    ``max_files_per_trigger`` bounds a micro-batch; by default a batch takes all files there are."""
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    s = (reader.parquet(src)
         .where(contains_keyword(text, word)).select(*cols))
    _run(s, out_path, scratch_path(spark, "ckpt-k1"))
    return out_path


def stream_take_class(spark: SparkSession, src: str, schema: T.StructType, out_path: str, label_col: str, cls,
                      n: int, cols=None, checkpoint: str | None = None, max_files_per_trigger: int = 1) -> str:
    """K2: stream rows of one class and stop after ``n`` of them.

    Each micro-batch takes ``max_files_per_trigger`` files, counts what the batches before it
    wrote, and keeps as many rows as are missing, in the order of file and row index (a top-n,
    no task gathers the batch).  A batch writes the folder of its id, replacing what a failed
    attempt left, so a restart with the same ``checkpoint`` and ``out_path`` gives the same rows.
    Once ``n`` rows are there, no batch reads its files and the query is stopped."""
    full = threading.Event()

    def take(batch, batch_id: int) -> None:
        missing = n - _taken(batch.sparkSession, out_path, batch_id)
        if missing > 0:
            rows = batch.orderBy("_file", "_index").limit(missing).drop("_file", "_index")
            rows.write.mode("overwrite").parquet(f"{out_path}/batch={batch_id}")
            missing = n - _taken(batch.sparkSession, out_path, batch_id + 1)
        if missing <= 0:
            full.set()

    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger).parquet(src)
    s = s.where(F.col(label_col) == cls)
    s = s.select(*(cols or schema.names), F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_index"))
    q = (s.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint or scratch_path(spark, "ckpt-k2"))
         .trigger(availableNow=True).start())
    while not q.awaitTermination(1) and not full.is_set():
        pass
    q.stop()
    if q.exception() is not None and not full.is_set():
        raise RuntimeError(str(q.exception()))
    return out_path


def _taken(spark: SparkSession, out_path: str, before: int) -> int:
    """Rows that the batches before ``before`` wrote."""
    try:
        done = spark.read.option("basePath", out_path).parquet(f"{out_path}/batch=*")
    except AnalysisException as e:  # nothing written yet
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return 0
    return done.where(F.col("batch") < before).count()
