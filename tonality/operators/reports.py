"""Reports across runs (I1-I7), computed from the predictions table (or parsed
result files) in one grouped pass each."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonality.operators import evaluate as ev

# The dataset order of the summary table.
DATASET_ORDER = ["eval_75_consent", "eval_all_agree", "test_75_consent", "test_all_agree"]
LABEL_ORDER = ["negative", "neutral", "positive", "accuracy", "macro avg", "weighted avg"]


def evaluation_summary(results: DataFrame) -> DataFrame:
    """One row per run (loss, accuracy, precision, recall, F1; missing ->
    null) ordered with ``eval_75_consent`` first."""
    order = F.array_position(F.array(*[F.lit(x) for x in DATASET_ORDER]), F.col("dataset"))
    out = results.select("model", "model_type", "dataset",
                         *[F.col(f"results.eval_{m}").alias(m) for m in ("loss", "accuracy", "precision", "recall", "f1")],
                         order.cast("int").alias("position"))
    return out.orderBy("position", "model", "model_type")


def class_report_summary(reports: DataFrame) -> DataFrame:
    """All class reports in one long table, in report order."""
    pos = F.array_position(F.array(*[F.lit(x) for x in LABEL_ORDER]), F.col("label")).cast("int")
    return reports.withColumn("label_order", pos).orderBy("model", "model_type", "dataset", "label_order")


def class_report_grid(report: DataFrame, types: list[str], metric: str = "f1") -> DataFrame:
    """Per model, dataset and label one column per model type."""
    return report.groupBy("model", "dataset", "label").pivot("model_type", types).agg(F.first(metric))


def big_error_comparison(preds: DataFrame, grid: DataFrame) -> DataFrame:
    """I4: 2->0 / 0->2 counts for every run of the grid; absent runs as zeros.
    The per-run counts are one row per run, joined to the grid."""
    counts = ev.big_error_counts(preds)
    j = grid.join(counts, ev.RUN, "left")
    return j.select(*ev.RUN, F.coalesce("pos_to_neg", F.lit(0)).alias("pos_to_neg"),
                    F.coalesce("neg_to_pos", F.lit(0)).alias("neg_to_pos"))


def confidence_summary(preds: DataFrame) -> DataFrame:
    """Mean confidence per run (runs without predictions are absent)."""
    return ev.with_confidence(preds).groupBy(*ev.RUN).agg(F.avg("confidence").alias("avg_confidence"),
                                                          F.count(F.lit(1)).alias("n"))


def error_rate_summary(preds: DataFrame) -> DataFrame:
    """Short / medium / long error-rate columns per run."""
    r = ev.length_error_rate(preds)
    return r.groupBy(*ev.RUN).pivot("band", ["short", "medium", "long"]).agg(F.first("error_rate")).select(
        *ev.RUN, F.col("short").alias("short_rate"), F.col("medium").alias("medium_rate"),
        F.col("long").alias("long_rate"))


def variant_delta(variant_preds: DataFrame) -> DataFrame:
    """Accuracy and macro F1 per run and variant, with the change against the
    original texts (one aggregate, then a join on the run keys)."""
    m = ev.overall_metrics(variant_preds, [*ev.RUN, "replacement"])
    base = m.where(F.col("replacement") == "original").select(
        *ev.RUN, F.col("accuracy").alias("_acc0"), F.col("f1").alias("_f10"))
    j = m.where(F.col("replacement") != "original").join(base, ev.RUN)
    return j.select(*ev.RUN, "replacement", "accuracy", "f1",
                    (F.col("accuracy") - F.col("_acc0")).alias("accuracy_delta"),
                    (F.col("f1") - F.col("_f10")).alias("f1_delta"))
