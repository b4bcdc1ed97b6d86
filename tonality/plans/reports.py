"""Registered queries: reports across runs (I1-I7) and the result-file round
trips they read (A6, A7)."""
from __future__ import annotations

from pyspark.sql import functions as F

from tonality.operators import evaluate as ev
from tonality.operators import reports as R
from tonality.plans.evaluation import _GRID_SQL, _RATE_CTES, KW_PATTERN, _rate_parts, grid_df, kw_sql
from tonality.plans.registry import r6, register
from tonality.plans.views_sql import H, tallies_sql, with_views
from tonality.sources import files as IO
from tonality.sources import tables as tb

RUN = "model, model_type, dataset"
_T = tallies_sql("predictions", ["model", "model_type", "dataset"])
_LOSS = ("SELECT model, model_type, dataset, avg(-ln(greatest(exp(logits[true_label + 1] - m) / z, 1e-9))) AS loss "
         "FROM (SELECT *, list_reduce(list_transform(logits, lambda x: exp(x - m)), lambda a, b: a + b) AS z "
         "FROM (SELECT *, list_max(logits) AS m FROM predictions)) GROUP BY ALL")
_ORDER = "CAST(coalesce(list_position(['eval_75_consent', 'eval_all_agree', 'test_75_consent', 'test_all_agree'], dataset), 0) AS INTEGER)"


def _results(spark, d):
    p = tb.predictions(spark, d)
    m = ev.overall_metrics(p)
    loss = ev.loss_summary(ev.cross_entropy_and_focal(p)).select(*ev.RUN, F.col("ce_mean").alias("loss"))
    j = m.join(loss, ev.RUN)
    null = F.lit(None).cast("double")
    res = F.struct(F.col("loss").alias("eval_loss"), F.col("accuracy").alias("eval_accuracy"),
                   F.col("precision").alias("eval_precision"), F.col("recall").alias("eval_recall"),
                   F.col("f1").alias("eval_f1"), null.alias("eval_runtime"), null.alias("eval_samples_per_second"),
                   null.alias("eval_steps_per_second"))
    return j.select(*ev.RUN, F.lit("FT").alias("Type"), F.col("model").alias("model_name"),
                    F.col("dataset").alias("eval_dataset"), res.alias("results"))


@register("read_result_documents", with_views(f"""
SELECT t.model, t.model_type, t.dataset, {r6('l.loss')} AS eval_loss, {r6('t.accuracy')} AS eval_accuracy,
       {r6('t.macro_f1')} AS eval_f1
FROM ({_T}) t JOIN l USING (model, model_type, dataset)""", "predictions", extra={"l": _LOSS}))
def q_read_result_documents(spark, d):
    """Per-run result documents written as JSON files and read back with a
    declared nested schema; run keys from the folder names."""
    root = IO.scratch_path(spark, "results")
    IO.write_result_documents(_results(spark, d), root)
    r = IO.read_result_documents(spark, root)
    return r.select("model", "model_type", "dataset", F.col("results.eval_loss").alias("eval_loss"),
                    F.col("results.eval_accuracy").alias("eval_accuracy"), F.col("results.eval_f1").alias("eval_f1"))


@register("evaluation_summary", with_views(f"""
SELECT t.model, t.model_type, t.dataset, {r6('l.loss')} AS loss, {r6('t.accuracy')} AS accuracy,
       {r6('t.macro_precision')} AS precision, {r6('t.macro_recall')} AS recall, {r6('t.macro_f1')} AS f1,
       {_ORDER} AS position
FROM ({_T}) t JOIN l USING (model, model_type, dataset)""", "predictions", extra={"l": _LOSS}))
def q_evaluation_summary(spark, d):
    """One row per run from the result documents, ``eval_75_consent`` first."""
    root = IO.scratch_path(spark, "results")
    IO.write_result_documents(_results(spark, d), root)
    return R.evaluation_summary(IO.read_result_documents(spark, root))


def _report_sql(digits: int) -> str:
    parts = []
    for k, name in enumerate(ev.LABEL_NAMES):
        parts.append(f"SELECT {RUN}, '{name}' AS label, round(precision_{k}, {digits}) AS precision, "
                     f"round(recall_{k}, {digits}) AS recall, round(f1_{k}, {digits}) AS f1, true_{k} AS support FROM t")
    parts.append(f"SELECT {RUN}, 'accuracy', NULL, NULL, round(accuracy, {digits}), n FROM t")
    for a in ("macro", "weighted"):
        parts.append(f"SELECT {RUN}, '{a} avg', round({a}_precision, {digits}), round({a}_recall, {digits}), "
                     f"round({a}_f1, {digits}), n FROM t")
    return " UNION ALL ".join(parts)


_LORDER = "CAST(list_position(['negative', 'neutral', 'positive', 'accuracy', 'macro avg', 'weighted avg'], label) AS INTEGER)"


@register("read_class_reports", with_views(_report_sql(2), "predictions", extra={"t": _T}))
def q_read_class_reports(spark, d):
    """Class reports written as fixed-width text per run, parsed back by label
    name (two decimals)."""
    root = IO.scratch_path(spark, "reports")
    lines = IO.format_class_report(ev.class_report(tb.predictions(spark, d)), ev.RUN)
    lines.repartition(*ev.RUN).write.mode("overwrite").partitionBy(*ev.RUN).text(root)
    return IO.read_class_reports(spark.read.text(root), ev.RUN)


@register("class_report_summary", with_views(f"SELECT *, {_LORDER} AS label_order FROM ({_report_sql(2)})",
                                             "predictions", extra={"t": _T}))
def q_class_report_summary(spark, d):
    """Every parsed class report in one long table, in report order."""
    root = IO.scratch_path(spark, "reports")
    lines = IO.format_class_report(ev.class_report(tb.predictions(spark, d)), ev.RUN)
    lines.repartition(*ev.RUN).write.mode("overwrite").partitionBy(*ev.RUN).text(root)
    return R.class_report_summary(IO.read_class_reports(spark.read.text(root), ev.RUN))


@register("class_report_grid", with_views(f"""
SELECT model, dataset, label, {', '.join(f"max(CASE WHEN model_type = '{t}' THEN f1 END) AS {t}" for t in tb.MODEL_TYPES)}
FROM ({_report_sql(6)}) GROUP BY model, dataset, label""", "predictions", extra={"t": _T}))
def q_class_report_grid(spark, d):
    """Per model, dataset and label the F1 of each model type side by side."""
    return R.class_report_grid(ev.class_report(tb.predictions(spark, d)), tb.MODEL_TYPES)


@register("big_error_comparison", with_views(f"""
SELECT g.model, g.model_type, g.dataset, coalesce(c.pos_to_neg, 0) AS pos_to_neg, coalesce(c.neg_to_pos, 0) AS neg_to_pos
FROM grid g LEFT JOIN (SELECT {RUN}, count_if(true_label = 2 AND predicted_label = 0) AS pos_to_neg,
                              count_if(true_label = 0 AND predicted_label = 2) AS neg_to_pos
                       FROM predictions GROUP BY ALL) c USING (model, model_type, dataset)""", "predictions",
                                             extra={"grid": _GRID_SQL}))
def q_big_error_comparison(spark, d):
    """I4: big-error counts over the full run grid; runs without predictions as zeros."""
    return R.big_error_comparison(tb.predictions(spark, d), grid_df(spark))


@register("confidence_summary", with_views(f"""
SELECT {RUN}, {r6('avg(list_max(logits))')} AS avg_confidence, count(*) AS n FROM predictions GROUP BY ALL""",
                                           "predictions"))
def q_confidence_summary(spark, d):
    """Mean confidence per run."""
    return R.confidence_summary(tb.predictions(spark, d))


def _rate_summary_sql() -> str:
    pivot = ", ".join(f"max(CASE WHEN band = '{b}' THEN error_rate END) AS {b}_rate" for b in ("short", "medium", "long"))
    return with_views(f"SELECT {RUN}, {pivot} FROM rates GROUP BY ALL", "predictions",
                      extra={**_RATE_CTES, "rates": _rate_parts()})


@register("error_rate_summary", _rate_summary_sql())
def q_error_rate_summary(spark, d):
    """Short / medium / long error rates as columns per run."""
    return R.error_rate_summary(tb.predictions(spark, d))


_REPLACEMENTS = ["share", "pay", "cut"]
_VAR = {"v": f"""
SELECT p.model, p.model_type, p.dataset, p.sample_id, p.true_label, r.replacement,
       CAST(CASE WHEN r.replacement <> 'original' AND {kw_sql('p.text')}
                      AND {H("r.replacement || ':' || p.model || ':' || p.model_type || ':' || CAST(p.sample_id AS VARCHAR)")} % 4 = 0
                 THEN (p.predicted_label + 1) % 3 ELSE p.predicted_label END AS INTEGER) AS predicted_label
FROM predictions p CROSS JOIN (SELECT unnest(['original', 'share', 'pay', 'cut']) AS replacement) r""",
        "m": tallies_sql("v", ["model", "model_type", "dataset", "replacement"])}


@register("variant_delta", with_views(f"""
SELECT a.model, a.model_type, a.dataset, a.replacement, {r6('a.accuracy')} AS accuracy, {r6('a.macro_f1')} AS f1,
       {r6('a.accuracy - b.accuracy')} AS accuracy_delta, {r6('a.macro_f1 - b.macro_f1')} AS f1_delta
FROM m a JOIN (SELECT * FROM m WHERE replacement = 'original') b USING (model, model_type, dataset)
WHERE a.replacement <> 'original'""", "predictions", extra=_VAR))
def q_variant_delta(spark, d):
    """Metric change of each counterfactual variant (the/share/pay/cut) against the original."""
    v = tb.variant_predictions(spark, d, KW_PATTERN, _REPLACEMENTS)
    return R.variant_delta(v)
