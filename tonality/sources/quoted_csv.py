"""A1 in parallel: quoted CSV with line breaks inside fields, one file read by many tasks.

Spark reads such a file with its multi-line option in one task, because a line break ends a record
only outside quotes.  Here the file is read as lines in ordinary splits.  A line starts a record if
an even number of quotes stands before it in the file: within a split by a running sum, between
splits by a prefix sum over one row per split.  Lines of a record are put together inside their
split; only the piece before a split's first record start is moved to the record it belongs to.

Quotes are escaped by doubling and a field that holds quotes is itself quoted (RFC 4180), as
``write_labeled_csv`` writes; a file whose quotes do not pair up fails the job.  Line breaks inside
fields are kept as they are; a record may end with a carriage return.  Empty lines between records
are skipped."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tonality.operators.stats import written

_SPLIT = ["_file", "_block"]


def _lines(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.option("lineSep", "\n").text(path)
    # rows of a split come in file order, so the id orders the lines of (file, block)
    return lines.select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"),
                        F.monotonically_increasing_id().alias("_at"), F.regexp_count("value", F.lit('"')).alias("_q"))


def _pieces(lines: DataFrame) -> DataFrame:
    """(_file, _block, _rec, _raw): the lines of each record inside a split; ``_rec`` 0 holds those
    that belong to a record of an earlier split."""
    sums = lines.groupBy(*_SPLIT).agg(F.sum("_q").alias("_n"))
    over = Window.partitionBy("_file").orderBy("_block")  # one row for each split of a file
    sums = sums.select(*_SPLIT, (F.sum("_n").over(over) - F.col("_n")).alias("_before"),
                       F.sum("_n").over(Window.partitionBy("_file")).alias("_total"))
    paired = F.when(F.col("_total") % 2 == 0, F.col("_before")).otherwise(
        F.raise_error(F.concat(F.lit("quotes do not pair up in "), F.col("_file"))).cast("long"))
    sums = written(sums.select(*_SPLIT, paired.alias("_before")), "csv-splits")
    inside = Window.partitionBy(*_SPLIT).orderBy("_at")
    own = F.coalesce(F.sum("_q").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parted = lines.withColumn("_own", own).join(sums, _SPLIT)
    start = ((F.col("_before") + F.col("_own")) % 2 == 0).cast("long")
    parted = parted.withColumn("_rec", F.sum(start).over(inside))
    raw = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_at", "value"))), lambda x: x["value"]), "\n")
    return written(parted.groupBy(*_SPLIT, "_rec").agg(raw.alias("_raw")), "csv-pieces")


def raw_records(spark: SparkSession, path: str) -> DataFrame:
    """(_file, _first, _raw): every record's text; ``_first`` marks the first one of its file."""
    pieces = _pieces(_lines(spark, path))
    last = pieces.groupBy(*_SPLIT).agg(F.max("_rec").alias("_last"), F.min("_rec").alias("_least"))
    earlier = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    own = F.when(F.col("_last") > 0, F.struct(F.col("_block").alias("_b"), F.col("_last").alias("_r")))
    heads = last.withColumn("_owner", F.last(own, ignorenulls=True).over(earlier)).where(F.col("_least") == 0)
    heads = written(heads.select(*_SPLIT, F.lit(0).cast("long").alias("_rec"), "_owner"), "csv-heads")
    # records cut by a split's end: their first piece and the heads of the splits that follow
    owners = heads.select("_file", "_owner._b", "_owner._r").distinct()
    cut = heads.select(*_SPLIT, "_rec", "_owner").unionByName(owners.select(
        "_file", F.col("_b").alias("_block"), F.col("_r").alias("_rec"), F.struct("_b", "_r").alias("_owner")))
    marked = pieces.join(cut, [*_SPLIT, "_rec"], "left")
    whole = marked.where(F.col("_owner").isNull()).select(*_SPLIT, "_rec", "_raw")
    joined = marked.where(F.col("_owner").isNotNull()).groupBy("_file", "_owner").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_block", "_rec", "_raw"))), lambda x: x["_raw"]), "\n").alias("_raw"))
    joined = joined.select("_file", F.col("_owner._b").alias("_block"), F.col("_owner._r").alias("_rec"), "_raw")
    records = whole.unionByName(joined)
    return records.select("_file", ((F.col("_block") == 0) & (F.col("_rec") == 1)).alias("_first"),
                          F.regexp_replace("_raw", r"\r$", "").alias("_raw"))


def read_quoted_csv(spark: SparkSession, path: str, schema: T.StructType, header: bool = True) -> DataFrame:
    """A1: the rows of quoted CSV files, each file read by as many tasks as it has splits."""
    records = raw_records(spark, path).where(F.trim("_raw") != "")
    if header:
        records = records.where(~F.col("_first"))
    parsed = F.from_csv("_raw", schema.simpleString()[len("struct<"):-1].replace(":", " "), {"quote": '"', "escape": '"'})
    return records.select(parsed.alias("_row")).select("_row.*")
