"""Dense, gap-free row numbers without a single-partition window.

``row_number()`` over an un-partitioned window (or one partitioned by a hot key)
moves every row into one task.  Two ways around it, neither of which relies on two
executions of a sort agreeing:

* ``hash_index`` ranks in the order of a hex hash.  Rows are cut into 4096 ranges by
  the hash's leading digits; a row's rank is its place inside its range plus the rows
  in the ranges before.  Both are functions of the rows alone, so the rank does not
  depend on partitioning or retries.
* ``dense_index`` ranks in the order of any columns.  The rows are sorted and tagged
  with partition and position once, written to the shared folder, and both the rows
  and the offsets are read from those files."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonality.session import scratch_dir

_LOW33 = (1 << 33) - 1
_RANGE_DIGITS = 3


def _same(a: DataFrame, b: DataFrame, cols: list[str]) -> Column:
    cond = F.lit(True)
    for c in cols:
        cond = cond & a[c].eqNullSafe(b[f"_o_{c}"])
    return cond


def _with_offsets(rows: DataFrame, offsets: DataFrame, keys: list[str]) -> DataFrame:
    """Join on keys that may be null (a class or symbol)."""
    o = offsets.withColumnsRenamed({k: f"_o_{k}" for k in keys})
    return rows.join(o, _same(rows, o, keys)).drop(*[f"_o_{k}" for k in keys])


def hash_index(df: DataFrame, hex_col: str, tie_cols: list[str], out: str = "row_index",
               partition_cols: list | None = None, start: int = 0) -> DataFrame:
    """Add ``out`` = 0-based position (plus ``start``) in the order of the hex string
    ``hex_col`` and then ``tie_cols``, restarting for each group of ``partition_cols``."""
    part = list(partition_cols or [])
    t = df.withColumn("_range", F.substring(hex_col, 1, _RANGE_DIGITS))
    sizes = t.groupBy(*part, "_range").agg(F.count(F.lit(1)).alias("_n"))  # 4096 rows a group at most
    before = Window.partitionBy(*part).orderBy("_range") if part else Window.orderBy("_range")
    sizes = sizes.select(*part, "_range", (F.sum("_n").over(before) - F.col("_n")).alias("_off"))
    inside = F.row_number().over(Window.partitionBy(*part, "_range").orderBy(hex_col, *tie_cols))
    ranked = _with_offsets(t.withColumn("_in", inside), sizes, [*part, "_range"])
    return ranked.withColumn(out, F.col("_off") + F.col("_in") - 1 + F.lit(start)).drop("_range", "_in", "_off")


def dense_index(df: DataFrame, order_cols: list, out: str = "row_index", partition_cols: list | None = None,
                start: int = 0) -> DataFrame:
    """Add ``out`` = 0-based position (plus ``start``) of each row in ``order_cols``
    order, restarting for each group of ``partition_cols`` when given."""
    part = list(partition_cols or [])
    order = [F.col(c) if isinstance(c, str) else c for c in order_cols]
    srt = df.orderBy(*[F.col(c) for c in part], *order)
    tagged = (srt.withColumn("_mid", F.monotonically_increasing_id())
              .withColumn("_pid", F.shiftright(F.col("_mid"), 33))
              .withColumn("_pos", F.col("_mid").bitwiseAND(F.lit(_LOW33))).drop("_mid"))
    path = scratch_dir(df.sparkSession, "sorted")
    tagged.write.parquet(path)
    tagged = df.sparkSession.read.schema(tagged.schema).parquet(path)
    # one row per (task, group) run: at most partitions + groups rows
    runs = tagged.groupBy("_pid", *part).agg(F.count(F.lit(1)).alias("_n"), F.min("_pos").alias("_first"))
    w = Window.partitionBy(*part).orderBy("_pid") if part else Window.orderBy("_pid")
    runs = runs.select("_pid", *part, "_first", (F.sum("_n").over(w) - F.col("_n")).alias("_off"))
    j = _with_offsets(tagged, runs, ["_pid", *part])
    return j.withColumn(out, F.col("_off") + F.col("_pos") - F.col("_first") + F.lit(start)).drop(
        "_pid", "_pos", "_off", "_first")
