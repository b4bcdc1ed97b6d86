"""File sources and sinks (A1-A11): CSV with quoted line breaks, Parquet corpora,
split folders, annotation sheets, JSON result documents, text class reports,
artifact catalogues and partitioned writes."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tonality.operators.stats import written
from tonality.session import scratch_dir

LABELED_CSV_SCHEMA = T.StructType([T.StructField("sample_id", T.LongType()), T.StructField("text", T.StringType()),
                                   T.StructField("label", T.StringType())])

RESULTS_SCHEMA = T.StructType([
    T.StructField("Type", T.StringType()), T.StructField("model_name", T.StringType()),
    T.StructField("eval_dataset", T.StringType()),
    T.StructField("results", T.StructType([T.StructField(f"eval_{m}", T.DoubleType()) for m in (
        "loss", "accuracy", "precision", "recall", "f1", "runtime", "samples_per_second", "steps_per_second")])),
])


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder.  Where none is named this fails,
    but for a local master, whose one machine shares its scratch folder."""
    return scratch_dir(spark, f"tonality-{name}")


def read_labeled_csv(spark: SparkSession, path: str, schema: T.StructType = LABELED_CSV_SCHEMA,
                     header: bool = True) -> DataFrame:
    """A1: delimited labelled text with quoted line breaks, declared schema.

    The multi-line reader takes one task a file, for files of bounded size (as
    ``write_labeled_csv`` writes them); ``quoted_csv.read_quoted_csv`` splits large ones."""
    return (spark.read.schema(schema).option("header", header).option("multiLine", True)
            .option("escape", '"').option("quote", '"').csv(path))


def write_labeled_csv(df: DataFrame, path: str, rows_per_file: int = 200_000) -> None:
    """Files of at most ``rows_per_file`` rows."""
    (df.write.option("maxRecordsPerFile", rows_per_file).mode("overwrite").option("header", True).option("escape", '"').option("quote", '"')
     .csv(path))


def read_corpus_parquet(spark: SparkSession, path: str, cols: list[str]) -> DataFrame:
    """A2: a Parquet corpus with only the needed columns (pruned at the scan)."""
    return spark.read.parquet(path).select(*cols)


def read_split_dataset(spark: SparkSession, paths: dict[str, str], fmt: str = "parquet") -> DataFrame:
    """A3: several splits of one dataset stacked with a ``split`` column."""
    parts = [spark.read.format(fmt).load(p).withColumn("split", F.lit(s)) for s, p in paths.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def annotation_sheets_to_long(cells: DataFrame, n_labelers: int = 4) -> tuple[DataFrame, DataFrame]:
    """A5: transposed sheets ``(sheet, row_idx, cells[])`` (row 0 texts, rows 1-4
    labels) -> one row per text with ``labeler_1..4``.

    Sheets without exactly ``1 + n_labelers`` rows of equal width are returned
    in the second (rejected) frame instead of failing the job."""
    shape = cells.groupBy("sheet").agg(F.count(F.lit(1)).alias("_rows"),
                                       F.countDistinct(F.size("cells")).alias("_widths"),
                                       F.min("row_idx").alias("_min_row"), F.max("row_idx").alias("_max_row"))
    ok = (F.col("_rows") == 1 + n_labelers) & (F.col("_widths") == 1) & (F.col("_min_row") == 0) & (
        F.col("_max_row") == n_labelers)
    good_sheets = shape.where(ok).select("sheet")
    rejected = shape.where(~ok).select("sheet", F.lit("unexpected sheet shape").alias("reason"))
    long = cells.join(good_sheets, "sheet").select("sheet", "row_idx", F.posexplode("cells").alias("col_idx", "cell"))
    wide = long.groupBy("sheet", "col_idx").pivot("row_idx", list(range(n_labelers + 1))).agg(F.first("cell"))
    out = wide.select("sheet", "col_idx", F.col("0").alias("text"),
                      *[F.col(str(k)).alias(f"labeler_{k}") for k in range(1, n_labelers + 1)])
    return out, rejected


def path_key(col: str, level_from_end: int) -> F.Column:
    """The value in the n-th ``key=value`` folder counted from the file name (1 = parent folder)."""
    folder = F.element_at(F.split(F.col(col), "/"), -(level_from_end + 1))
    return F.url_decode(F.regexp_replace(folder, "^[^=]*=", ""))


def write_result_documents(results: DataFrame, root: str, keys=("model_type", "model", "dataset")) -> None:
    """One JSON document per run under ``<root>/model_type=../model=../dataset=..``."""
    results.repartition(*keys).write.mode("overwrite").partitionBy(*keys).json(root)


def read_result_documents(spark: SparkSession, root: str) -> DataFrame:
    """One JSON document per file with a declared nested schema; the run keys
    come from the folder names (partition discovery, so a filter on them prunes
    folders)."""
    return spark.read.schema(RESULTS_SCHEMA).option("multiLine", True).json(root)


REPORT_ROW = r"^\s*(negative|neutral|positive|macro avg|weighted avg)\s+([0-9.]+)\s+([0-9.]+)\s+([0-9.]+)\s+([0-9]+)\s*$"
REPORT_ACC = r"^\s*(accuracy)\s+([0-9.]+)\s+([0-9]+)\s*$"


def read_class_reports(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Parse fixed-width class-report lines by label name (never by line offset)."""
    row = F.col("value").rlike(REPORT_ROW)
    acc = F.col("value").rlike(REPORT_ACC)
    g = lambda i: F.regexp_extract("value", REPORT_ROW, i)
    a = lambda i: F.regexp_extract("value", REPORT_ACC, i)
    parsed = lines.where(row | acc).select(
        *keys,
        F.when(row, g(1)).otherwise(a(1)).alias("label"),
        F.when(row, g(2).cast("double")).alias("precision"),
        F.when(row, g(3).cast("double")).alias("recall"),
        F.when(row, g(4).cast("double")).otherwise(a(2).cast("double")).alias("f1"),
        F.when(row, g(5).cast("bigint")).otherwise(a(3).cast("bigint")).alias("support"))
    return parsed


def format_class_report(report: DataFrame, keys: list[str]) -> DataFrame:
    """The text layout of a classification report, one line per row, for the
    writers of A7 input (two decimals, right-aligned columns)."""
    num = lambda c: F.lpad(F.format_string("%.2f", F.col(c)), 10, " ")
    line = F.when(F.col("label") == "accuracy",
                  F.concat(F.lpad("label", 12, " "), F.lit(" " * 20), num("f1"), F.lpad(F.col("support").cast("string"), 10, " "))
                  ).otherwise(F.concat(F.lpad("label", 12, " "), num("precision"), num("recall"), num("f1"),
                                       F.lpad(F.col("support").cast("string"), 10, " ")))
    return report.select(*keys, line.alias("value"))


def write_partitioned(df: DataFrame, path: str, fmt: str = "parquet", keys=("model", "model_type", "dataset"),
                      mode: str = "overwrite", rows_per_file: int = 1_000_000) -> None:
    """Write under ``<path>/key=value/...`` in CSV, JSON or Parquet.

    A run's rows go to as many tasks, and files, as they need at about ``rows_per_file``; the
    rows of each run are counted first (one row per run).  Only the folders of runs in ``df``
    are replaced: writing one run leaves the others, writing it again replaces it."""
    keys = list(keys)
    counts = df.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / rows_per_file).alias("_files"))
    counts = written(counts.withColumnsRenamed({k: f"_k_{k}" for k in keys}), "run-files")
    same = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys])
    spread = F.pmod(F.xxhash64(*[c for c in df.columns if c not in keys]), F.col("_files"))
    tasks = counts.agg(F.sum("_files")).first()[0] or 1
    rows = df.join(counts, same).withColumn("_part", spread).repartition(tasks, *keys, "_part").select(*df.columns)
    w = (rows.write.mode(mode).partitionBy(*keys).option("partitionOverwriteMode", "dynamic")
         .option("maxRecordsPerFile", rows_per_file))
    if fmt == "csv":
        w = w.option("header", True).option("escape", '"')
    w.format(fmt).save(path)


def artifact_catalog(spark: SparkSession, root: str, fmt: str = "parquet") -> DataFrame:
    """Walk result files ``<root>/artifact=<a>/model=..../dataset=<d>/part-*``,
    derive the keys from the path and regroup by artifact and dataset."""
    path = F.url_decode(F.col("_metadata.file_path"))
    files = spark.read.format(fmt).load(root).select(path.alias("path"))
    keys = ("artifact", "model", "model_type", "dataset")
    files = files.select(*[path_key("path", i).alias(k) for i, k in zip(range(len(keys), 0, -1), keys)])
    return files.groupBy("artifact", "dataset").agg(
        F.countDistinct("model", "model_type").alias("n_runs"), F.count(F.lit(1)).alias("n_rows"))


def flatten_url_list(articles: DataFrame, tickers: list[str]) -> DataFrame:
    """The urls of the listed tickers' relevant articles as one list (rows)."""
    return articles.where(F.col("ticker").isin(tickers)).select("ticker", "date", "url")
