"""Registered queries: file sources and sinks (A1-A3, A5, A8-A10), streaming
(K1, K2) and the Spark ML classifier (H30).  Files are written by Spark from the
driver tables into fresh folders under the shared checkpoint location and read
back."""
from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tonality.functions.text import repair_line_breaks
from tonality.operators import assemble as A
from tonality.operators import evaluate as ev
from tonality.operators.classifier import text_classifier
from tonality.operators.model_selection import select_model
from tonality.operators.stats import written
from tonality.plans.assembly import _THREE
from tonality.plans.evaluation import CONF, _rowsel
from tonality.plans.registry import r6, register
from tonality.plans.views_sql import with_views
from tonality.sources import files as IO
from tonality.sources import tables as tb
from tonality.sources.quoted_csv import read_quoted_csv
from tonality.sources.sheets import read_sheets
from tonality.streaming.extract import stream_keyword_extract, stream_take_class


@register("read_labeled_csv", with_views(
    "SELECT sample_id, text, CAST(label AS VARCHAR) AS label FROM labeled_text", "labeled_text"))
def q_read_labeled_csv(spark, d):
    """A1: labelled text written as CSV (quoted line breaks) and read back with a declared schema."""
    path = IO.scratch_path(spark, "csv")
    IO.write_labeled_csv(tb.labeled_text(spark, d).select("sample_id", "text", F.col("label").cast("string")), path)
    return IO.read_labeled_csv(spark, path)


@register("read_quoted_csv_in_parts", with_views(
    "SELECT sample_id, text, CAST(label AS VARCHAR) AS label FROM labeled_text", "labeled_text"))
def q_read_quoted_csv_in_parts(spark, d):
    """A1: the same as one quoted file, read by as many tasks as the file has splits."""
    path = IO.scratch_path(spark, "csv-one")
    rows = tb.labeled_text(spark, d).select("sample_id", "text", F.col("label").cast("string"))
    IO.write_labeled_csv(rows, path)
    return read_quoted_csv(spark, path, IO.LABELED_CSV_SCHEMA)


@register("read_corpus_parquet", "SELECT doc_id, text FROM documents")
def q_read_corpus_parquet(spark, d):
    """A2: a Parquet corpus read with only the needed columns."""
    return IO.read_corpus_parquet(spark, f"{d}/documents.parquet", ["doc_id", "text"])


@register("read_split_dataset", with_views("SELECT split, sample_id, label FROM s", "labeled_text",
                                           extra={"s": _THREE}))
def q_read_split_dataset(spark, d):
    """A3: train / valid / test folders read back and stacked with a ``split`` column."""
    root = IO.scratch_path(spark, "splits")
    s = A.three_way_split(tb.labeled_text(spark, d).select("sample_id", "label"), 42)
    s.write.mode("overwrite").partitionBy("split").parquet(root)  # one pass writes every split folder
    paths = {name: f"{root}/split={name}" for name in ("train", "valid", "test")}
    return IO.read_split_dataset(spark, paths).select("split", "sample_id", "label")


def sheet_cells(spark, d, width: int = 10):
    """Annotation sheets in their transposed form: (sheet, row_idx, cells[]),
    row 0 the texts, rows 1-4 the labels, ``width`` texts per sheet."""
    a = tb.annotations(spark, d).select("sample_id", "text", "labeler_1", "labeler_2", "labeler_3", "labeler_4")
    a = a.withColumn("sheet", (F.col("sample_id") / width).cast("bigint")).withColumn(
        "col", (F.col("sample_id") % width).cast("int"))
    rows = F.array(F.struct(F.lit(0).alias("row_idx"), F.col("text").alias("cell")),
                   *[F.struct(F.lit(k).alias("row_idx"), F.col(f"labeler_{k}").alias("cell")) for k in range(1, 5)])
    long = a.select("sheet", "col", F.inline(rows))
    g = long.groupBy("sheet", "row_idx").agg(F.sort_array(F.collect_list(F.struct("col", "cell"))).alias("_c"))
    return g.select("sheet", "row_idx", F.transform("_c", lambda x: x["cell"]).alias("cells"))


_BAD_SHEET = "(sample_id // 10) % 17 = 3"


def _sheets(spark, d):
    """The sheets, every seventeenth of which has lost its last row."""
    cells = sheet_cells(spark, d)
    return cells.where((F.col("sheet") % 17 != 3) | (F.col("row_idx") < 4))


@register("annotation_sheets_to_long", with_views(f"""
SELECT sample_id // 10 AS sheet, CAST(sample_id % 10 AS INTEGER) AS col_idx, text, labeler_1, labeler_2, labeler_3,
       labeler_4 FROM annotations WHERE NOT ({_BAD_SHEET})""", "annotations"))
def q_annotation_sheets_to_long(spark, d):
    """A5: transposed sheets back to one row per text with four labelers."""
    out, _ = IO.annotation_sheets_to_long(_sheets(spark, d))
    return out


@register("annotation_sheets_rejected", f"""
SELECT sample_id // 10 AS sheet, 'unexpected sheet shape' AS reason
FROM annotations WHERE {_BAD_SHEET} GROUP BY 1""".replace("FROM annotations", "FROM (SELECT doc_id AS sample_id FROM documents)"))
def q_annotation_sheets_rejected(spark, d):
    """A5: the sheets that are skipped and reported, here those without their last labeler."""
    _, rejected = IO.annotation_sheets_to_long(_sheets(spark, d))
    return rejected


_FILE_SHEETS = "SELECT sample_id // 10 AS sheet, sample_id % 10 AS col, text, labeler_1, labeler_2, labeler_3, labeler_4 FROM annotations"


def _sheet_files(spark, d):
    """The sheets as files; those of every seventeenth number hold a row that was cut off."""
    root = IO.scratch_path(spark, "sheets")
    cells = sheet_cells(spark, d)
    line = F.to_json(F.struct(F.col("row_idx"), F.col("cells")), {"ignoreNullFields": "false"})
    cut = (F.col("sheet") % 17 == 3) & (F.col("row_idx") == 2)
    rows = cells.select("sheet", "row_idx", F.when(cut, F.substring(line, 1, 20)).otherwise(line).alias("value"))
    rows.repartition("sheet").sortWithinPartitions("sheet", "row_idx").drop("row_idx").write.partitionBy("sheet").text(root)
    number = lambda: F.regexp_extract("path", "sheet=([0-9]+)", 1).cast("long")
    return root, lambda path="path": number()


@register("read_sheet_files", with_views(f"""
SELECT sheet, CAST(col AS INTEGER) AS col_idx, text, labeler_1, labeler_2, labeler_3, labeler_4
FROM ({_FILE_SHEETS}) WHERE sheet % 17 <> 3""", "annotations"))
def q_read_sheet_files(spark, d):
    """A5: annotation sheets read from files, without those that cannot be read."""
    root, name = _sheet_files(spark, d)
    return read_sheets(spark, root, name=name)[0]


@register("sheet_files_rejected", with_views(f"""
SELECT sheet, 'unreadable rows: 1' AS reason FROM ({_FILE_SHEETS}) WHERE sheet % 17 = 3 GROUP BY sheet""", "annotations"))
def q_sheet_files_rejected(spark, d):
    """A5: the files that cannot be read, with the reason."""
    root, name = _sheet_files(spark, d)
    return read_sheets(spark, root, name=name)[1]


RUN_SQL = "model, model_type, dataset"


@register("artifact_catalog", with_views(f"""
SELECT artifact, dataset, count(DISTINCT (model, model_type)) AS n_runs, count(*) AS n_rows FROM (
  SELECT 'misclassified' AS artifact, {RUN_SQL} FROM predictions WHERE true_label <> predicted_label
  UNION ALL
  SELECT 'big_errors', {RUN_SQL} FROM predictions
  WHERE (true_label = 2 AND predicted_label = 0) OR (true_label = 0 AND predicted_label = 2)
  UNION ALL
  SELECT 'false_positives', {RUN_SQL} FROM predictions WHERE true_label <> 0 AND predicted_label = 0)
GROUP BY artifact, dataset""", "predictions"))
def q_artifact_catalog(spark, d):
    """Result files written per artifact and run, catalogued back from their
    paths and regrouped by artifact and dataset."""
    p = ev.with_confidence(tb.predictions(spark, d)).drop("logits", "text")
    arts = [ev.misclassified(p).withColumn("artifact", F.lit("misclassified")),
            ev.error_direction(p).where(F.col("direction") != "neu_to_pos").drop("direction")
            .withColumn("artifact", F.lit("big_errors")),
            ev.false_pos_neg(p, 0).where(F.col("kind") == "false_positive").drop("kind")
            .withColumn("artifact", F.lit("false_positives"))]
    root = IO.scratch_path(spark, "artifacts")
    IO.write_partitioned(A.union_datasets(arts), root, "parquet", ("artifact", "model", "model_type", "dataset"))
    return IO.artifact_catalog(spark, root)


@register("write_partitioned", with_views(f"""
SELECT {_rowsel()}, {r6(CONF)} AS confidence FROM predictions WHERE true_label <> predicted_label""", "predictions"))
def q_write_partitioned(spark, d):
    """Misclassified rows written under model / type / dataset folders and read back."""
    p = ev.misclassified(ev.with_confidence(tb.predictions(spark, d))).select(
        *ev.RUN, "sample_id", "true_label", "predicted_label", "confidence")
    root = IO.scratch_path(spark, "partitioned")
    IO.write_partitioned(p, root, "parquet")
    return spark.read.parquet(root).select(*ev.RUN, "sample_id", "true_label", "predicted_label", "confidence")


@register("repair_line_breaks", "SELECT doc_id, replace(replace(text, chr(13), ''), chr(10), ' ') AS text FROM documents")
def q_repair_line_breaks(spark, d):
    """A10: line breaks inside the text field become spaces, carriage returns dropped."""
    return tb.read(spark, d, "documents").select("doc_id", repair_line_breaks("text").alias("text"))


DOC_SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                           T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                           T.StructField("n_chars", T.LongType())])
LABELS_SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("quality", T.IntegerType()),
                              T.StructField("toxic", T.IntegerType())])


@register("stream_keyword_extract", "SELECT doc_id, text FROM documents WHERE contains(text, 'The')")
def q_stream_keyword_extract(spark, d):
    """K1: a streaming pass over the documents keeping texts with ``The`` (file sink, read back)."""
    out = IO.scratch_path(spark, "k1")
    stream_keyword_extract(spark, f"{d}/documents*.parquet", DOC_SCHEMA, out, "The", cols=("doc_id", "text"))
    return spark.read.parquet(out)


@register("stream_take_class", """
SELECT least(100, count(*)) AS n_rows, CAST(0 AS BIGINT) AS n_other_class, CAST(0 AS BIGINT) AS n_unknown,
       CAST(0 AS BIGINT) AS n_repeated
FROM labels WHERE quality = 1""")
def q_stream_take_class(spark, d):
    """K2: a streaming pass over the labels that stops after 100 rows of quality 1.  Any such
    rows are valid, so the query returns what must hold of them: their number, how many are of
    another class, absent from the source or repeated."""
    out = IO.scratch_path(spark, "k2")
    stream_take_class(spark, f"{d}/labels*.parquet", LABELS_SCHEMA, out, "quality", 1, 100)
    taken = spark.read.schema(LABELS_SCHEMA).parquet(out)
    source = tb.read(spark, d, "labels").select(F.col("doc_id").alias("_id"), F.col("quality").alias("_q"),
                                                F.col("toxic").alias("_t"))
    same = (F.col("doc_id") == F.col("_id")) & F.col("quality").eqNullSafe(F.col("_q")) & F.col("toxic").eqNullSafe(F.col("_t"))
    return taken.join(source, same, "left").agg(
        F.countDistinct("doc_id").alias("n_rows"), F.count_if(F.col("quality") != 1).alias("n_other_class"),
        F.count_if(F.col("_id").isNull()).alias("n_unknown"), (F.count(F.lit(1)) - F.countDistinct("doc_id")).alias("n_repeated"))


@register("text_classifier", with_views("""
SELECT count(*) AS n_scored, count_if(split = 'valid') AS n_valid, count_if(label = 0) AS true_0,
       count_if(label = 1) AS true_1, count_if(label = 2) AS true_2, CAST(0 AS BIGINT) AS n_bad_label, true AS beats_majority
FROM s WHERE split <> 'train'""", "labeled_text", extra={"s": _THREE}))
def q_text_classifier(spark, d):
    """Spark ML text classifier fitted on the train split, scored on the rest.  Returned
    is what can be checked: sizes, true classes, labels outside the classes, and whether it is
    right more often than the most frequent class would be."""
    scored = _classified(spark, d)
    truth = lambda c: F.count_if(F.col("true_label") == c)
    return scored.agg(
        F.count(F.lit(1)).alias("n_scored"), F.count_if(F.col("split") == "valid").alias("n_valid"),
        *[truth(c).alias(f"true_{c}") for c in (0, 1, 2)],
        F.count_if(~F.coalesce(F.col("predicted_label").isin(0, 1, 2), F.lit(False))).alias("n_bad_label"),
        (F.count_if(F.col("true_label") == F.col("predicted_label")) > F.greatest(*[truth(c) for c in (0, 1, 2)])).alias("beats_majority"))


GRID = {"num_features": [1 << 12, 1 << 14], "reg": [0.01, 0.3], "max_iter": [10]}


@register("grid_search", with_views("""
SELECT CAST(4 AS BIGINT) AS n_runs, count_if(split = 'valid') AS n_valid, count_if(split = 'test') AS n_test, CAST(4 AS BIGINT) AS n_in_range,
       true AS best_is_first_maximum, true AS test_is_recounted
FROM s""", "labeled_text", extra={"s": _THREE}))
def q_grid_search(spark, d):
    """F13 + F14 + H30: a fit for every row of a parameter grid on the train split, the best by
    valid accuracy scored on the test split.  Returned is what must hold of them."""
    got = select_model(tb.labeled_text(spark, d).select("sample_id", "text", "label"), GRID, 42)
    runs = got.runs.agg(F.count(F.lit(1)).alias("n_runs"), F.max("n").alias("n_valid"), F.max("accuracy").alias("_top"),
                        F.count_if(F.col("accuracy").between(0, 1)).alias("n_in_range"),
                        F.min(F.struct(-F.col("accuracy"), "grid_idx")).alias("_first"))
    test = got.scored.agg(F.count(F.lit(1)).alias("n_test"), F.count_if(F.col("true_label") == F.col("predicted_label")).alias("_right"))
    one = runs.crossJoin(F.broadcast(test)).crossJoin(F.broadcast(got.test.select(F.col("accuracy").alias("_test_accuracy"))))
    return one.select("n_runs", "n_valid", "n_test", "n_in_range",
                      ((F.col("_first.grid_idx") == got.best["grid_idx"]) & (F.col("_top") == got.best["accuracy"])).alias("best_is_first_maximum"),
                      (F.abs(F.col("_right") / F.col("n_test") - F.col("_test_accuracy")) < 1e-9).alias("test_is_recounted"))


def _classified(spark, d):
    lt = tb.labeled_text(spark, d)
    s = written(A.three_way_split(lt.select("sample_id", "text", "label"), 42), "classifier-split")
    scored = text_classifier(s.where(F.col("split") == "train"), s.where(F.col("split") != "train"))
    return scored.select("sample_id", "split", F.col("label").alias("true_label"), "predicted_label",
                         F.array_max("logits").alias("confidence"))
