"""A5 over files: annotation sheets, one file each, some of which cannot be read.

A sheet file has one JSON row ``{"row_idx": .., "cells": [..]}`` per line, row 0 the texts and the
other rows the labels.  Rows that cannot be parsed are captured, not fatal; a sheet with such a row,
without rows, or of the wrong shape is reported with its reason and the other sheets are read.
Files of no bytes at all are passed over, as by Spark's readers."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonality.operators.stats import written
from tonality.sources.files import annotation_sheets_to_long

_BLANK = r"^[ \t\r\n]*$"
_ROW = "row_idx int, cells array<string>, _bad string"


def sheet_name(path: str = "path") -> F.Column:
    return F.url_decode(F.regexp_extract(F.col(path), r"([^/]*)$", 1))


def write_sheets(cells: DataFrame, root: str, sheet: str = "sheet") -> None:
    """``cells(sheet, row_idx, cells)`` as one folder of JSON rows per sheet."""
    rows = cells.select(sheet, "row_idx", "cells").repartition(sheet).sortWithinPartitions(sheet, "row_idx")
    rows.write.mode("overwrite").partitionBy(sheet).json(root)


def read_sheets(spark: SparkSession, path: str, n_labelers: int = 4, name=sheet_name) -> tuple[DataFrame, DataFrame]:
    """(one row per text with ``labeler_1..n``, rejected sheets with a reason).  ``name`` makes a
    sheet's name from its file's path column.

    The files, of which there may be many, are listed and read once, as lines: a file without
    rows has blank lines and so appears among them."""
    lines = spark.read.option("recursiveFileLookup", True).text(path)
    lines = lines.select(F.col("_metadata.file_path").alias("path"), F.when(~F.col("value").rlike(_BLANK), F.col("value")).alias("_line"))
    row = F.from_json("_line", _ROW, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    rows = lines.select(name().alias("sheet"), F.col("_line").isNull().alias("_blank"), row.alias("_row"))
    rows = written(rows.select("sheet", "_blank", "_row.row_idx", "_row.cells", "_row._bad"), "sheet-rows")
    bad = F.col("_bad").isNotNull() | F.col("row_idx").isNull() | F.col("cells").isNull()
    state = rows.groupBy("sheet").agg(F.when(F.count_if(~F.col("_blank")) > 0, F.count_if(~F.col("_blank") & bad)).alias("_bad_rows"))
    unread = state.where(F.col("_bad_rows").isNull() | (F.col("_bad_rows") > 0)).select("sheet", F.when(
        F.col("_bad_rows").isNull(), "no rows").otherwise(F.concat(F.lit("unreadable rows: "), F.col("_bad_rows").cast("string"))).alias("reason"))
    unread = written(unread, "unread-sheets")
    good = rows.where(~F.col("_blank")).join(unread, "sheet", "left_anti").select("sheet", "row_idx", "cells")
    out, shape = annotation_sheets_to_long(good, n_labelers)
    return out, unread.unionByName(shape)
