"""Registered evaluation queries (H) over the predictions view."""
from __future__ import annotations

from pyspark.sql import functions as F

from tonality.functions.text import matches_pattern
from tonality.operators import evaluate as ev
from tonality.plans.registry import r6, register
from tonality.plans.views_sql import H, tallies_sql, with_views
from tonality.sources import tables as tb

RUN = "model, model_type, dataset"
WORDS_SQL = "len(regexp_extract_all({x}, '[^\\s\\x1c-\\x1f]+'))"


def wc_sql(x: str) -> str:
    return f"CAST(len(regexp_extract_all({x}, '\\S+')) AS INTEGER)"


# ---- H1 / D8 / H2 -------------------------------------------------------------------
@register("argmax_label", with_views(f"""
SELECT model, model_type, dataset, sample_id,
       CAST(list_position(logits, list_max(logits)) - 1 AS INTEGER) AS raw_label
FROM raw_predictions""", "raw_predictions"))
def q_argmax_label(spark, d):
    """H1: class with the largest logit per row and run."""
    return ev.argmax_label(tb.raw_predictions(spark, d)).select(*ev.RUN, "sample_id", "raw_label")


@register("prediction_remap", with_views(f"""
SELECT model, model_type, dataset, sample_id, raw_label,
       CAST(CASE WHEN lower(model) LIKE '%distilroberta%' THEN raw_label
                 WHEN lower(model) LIKE '%distilbert%' THEN [1, 0, 2][raw_label + 1]
                 WHEN lower(model) LIKE '%finbert%' THEN [2, 0, 1][raw_label + 1]
                 ELSE raw_label END AS INTEGER) AS predicted_label
FROM (SELECT *, CAST(list_position(logits, list_max(logits)) - 1 AS INTEGER) AS raw_label FROM raw_predictions)""",
                                     "raw_predictions"))
def q_prediction_remap(spark, d):
    """Raw class ids to canonical labels by model family."""
    p = ev.prediction_remap(ev.argmax_label(tb.raw_predictions(spark, d)))
    return p.select(*ev.RUN, "sample_id", "raw_label", "predicted_label")


@register("attach_predictions", with_views(f"""
SELECT p.model, p.model_type, p.dataset, p.sample_id, s.text, s.label AS true_label,
       CAST(list_position(p.logits, list_max(p.logits)) - 1 AS INTEGER) AS raw_label
FROM raw_predictions p JOIN eval_samples s ON p.dataset = s.dataset AND p.sample_id = s.sample_id""",
                                     "raw_predictions", "eval_samples"))
def q_attach_predictions(spark, d):
    """H2: predictions joined to their samples by (dataset, sample_id), with the
    alignment check."""
    samples = tb.eval_samples(spark, d)
    preds = ev.argmax_label(tb.raw_predictions(spark, d))
    j = ev.attach_predictions(samples, preds)
    return j.select(*ev.RUN, "sample_id", "text", F.col("label").alias("true_label"), "raw_label")


# ---- H3 - H5 ------------------------------------------------------------------------
@register("overall_metrics", with_views(f"""
SELECT {RUN}, n, {r6('accuracy')} AS accuracy, {r6('macro_precision')} AS precision,
       {r6('macro_recall')} AS recall, {r6('macro_f1')} AS f1
FROM ({tallies_sql('predictions', ['model', 'model_type', 'dataset'])})""", "predictions"))
def q_overall_metrics(spark, d):
    """H3: accuracy and macro P / R / F1 per run."""
    return ev.overall_metrics(tb.predictions(spark, d))


@register("confusion_matrix", with_views(f"""
SELECT r.model, r.model_type, r.dataset, g.t AS true_label, g.p AS predicted_label,
       coalesce(c.n, 0) AS n
FROM (SELECT DISTINCT {RUN} FROM predictions) r
CROSS JOIN (SELECT t, p FROM range(3) a(t), range(3) b(p)) g
LEFT JOIN (SELECT {RUN}, true_label, predicted_label, count(*) AS n FROM predictions GROUP BY ALL) c
  ON c.model = r.model AND c.model_type = r.model_type AND c.dataset = r.dataset
 AND c.true_label = g.t AND c.predicted_label = g.p""", "predictions"))
def q_confusion_matrix(spark, d):
    """H4: zero-filled 3 x 3 confusion matrix per run."""
    return ev.confusion_matrix(tb.predictions(spark, d))


def _report_sql() -> str:
    t = tallies_sql("predictions", ["model", "model_type", "dataset"])
    parts = []
    for k, name in enumerate(ev.LABEL_NAMES):
        parts.append(f"SELECT {RUN}, '{name}' AS label, {r6(f'precision_{k}')} AS precision, "
                     f"{r6(f'recall_{k}')} AS recall, {r6(f'f1_{k}')} AS f1, true_{k} AS support FROM t")
    parts.append(f"SELECT {RUN}, 'accuracy', NULL, NULL, {r6('accuracy')}, n FROM t")
    for a in ("macro", "weighted"):
        parts.append(f"SELECT {RUN}, '{a} avg', {r6(f'{a}_precision')}, {r6(f'{a}_recall')}, "
                     f"{r6(f'{a}_f1')}, n FROM t")
    return with_views(" UNION ALL ".join(parts), "predictions", extra={"t": t})


@register("class_report", _report_sql())
def q_class_report(spark, d):
    """H5: classification report rows per run (3 classes, accuracy, macro, weighted)."""
    return ev.class_report(tb.predictions(spark, d))


# ---- H6 - H13: error slices and confidence --------------------------------------------
CONF = "list_max(logits)"


def _rowsel(extra: str = "") -> str:
    return f"model, model_type, dataset, sample_id, true_label, predicted_label{extra}"


@register("misclassified", with_views(f"""
SELECT {_rowsel()}, {r6(CONF)} AS confidence FROM predictions WHERE true_label <> predicted_label""", "predictions"))
def q_misclassified(spark, d):
    """H6: rows with truth != prediction, with their confidence."""
    p = ev.misclassified(ev.with_confidence(tb.predictions(spark, d)))
    return p.select(*ev.RUN, "sample_id", "true_label", "predicted_label", "confidence")


@register("error_direction", with_views(f"""
SELECT {_rowsel()},
       CASE WHEN true_label = 2 AND predicted_label = 0 THEN 'pos_to_neg'
            WHEN true_label = 0 AND predicted_label = 2 THEN 'neg_to_pos'
            ELSE 'neu_to_pos' END AS direction
FROM predictions
WHERE (true_label = 2 AND predicted_label = 0) OR (true_label = 0 AND predicted_label = 2)
   OR (true_label = 1 AND predicted_label = 2)""", "predictions"))
def q_error_direction(spark, d):
    """H7: pos->neg, neg->pos and neu->pos error slices."""
    return ev.error_direction(tb.predictions(spark, d)).select(*ev.RUN, "sample_id", "true_label",
                                                               "predicted_label", "direction")


@register("big_error_counts", with_views(f"""
SELECT {RUN}, count_if(true_label = 2 AND predicted_label = 0) AS pos_to_neg,
       count_if(true_label = 0 AND predicted_label = 2) AS neg_to_pos
FROM predictions GROUP BY ALL""", "predictions"))
def q_big_error_counts(spark, d):
    """H8: counts of 2->0 and 0->2 errors per run."""
    return ev.big_error_counts(tb.predictions(spark, d))


def _transitions_sql() -> str:
    cols = [f"count_if(true_label = {t} AND predicted_label = {p}) AS n_{t}_to_{p}"
            for t in range(3) for p in range(3) if t != p]
    cols += [f"count_if(true_label = {k}) AS true_{k}" for k in range(3)]
    cols += [f"count_if(predicted_label = {k}) AS pred_{k}" for k in range(3)]
    return with_views(f"SELECT {RUN}, {', '.join(cols)} FROM predictions GROUP BY ALL", "predictions")


@register("error_transitions", _transitions_sql())
def q_error_transitions(spark, d):
    """H9: six off-diagonal counts plus true / predicted label counts per run."""
    return ev.error_transitions(tb.predictions(spark, d))


@register("false_pos_neg", with_views(f"""
SELECT {_rowsel()}, CASE WHEN predicted_label = 0 THEN 'false_positive' ELSE 'false_negative' END AS kind
FROM predictions
WHERE (true_label <> 0 AND predicted_label = 0) OR (true_label = 0 AND predicted_label <> 0)""", "predictions"))
def q_false_pos_neg(spark, d):
    """One-vs-rest false positives / negatives for the negative class."""
    return ev.false_pos_neg(tb.predictions(spark, d), 0).select(*ev.RUN, "sample_id", "true_label",
                                                                "predicted_label", "kind")


@register("confidence", with_views(f"""
SELECT model, model_type, dataset, sample_id, {r6(CONF)} AS confidence FROM predictions""", "predictions"))
def q_confidence(spark, d):
    """Per-row confidence (largest raw logit)."""
    return ev.with_confidence(tb.predictions(spark, d)).select(*ev.RUN, "sample_id", "confidence")


@register("confidence_slices", with_views(f"""
SELECT {_rowsel()}, {r6('confidence')} AS confidence, slice, {r6('threshold')} AS threshold FROM (
  SELECT c.*, 'low' AS slice, t.low_thr AS threshold FROM c JOIN thr t USING (model, model_type, dataset)
  WHERE true_label <> predicted_label AND confidence < t.low_thr
  UNION ALL
  SELECT c.*, 'high' AS slice, t.high_thr AS threshold FROM c JOIN thr t USING (model, model_type, dataset)
  WHERE true_label <> predicted_label AND confidence >= t.high_thr)""", "predictions", extra={
    "c": f"SELECT *, {CONF} AS confidence FROM predictions",
    "thr": f"SELECT {RUN}, quantile_cont(confidence, 0.25) AS low_thr, quantile_cont(confidence, 0.75) AS high_thr "
           f"FROM c GROUP BY ALL"}))
def q_confidence_slices(spark, d):
    """Errors below the 25th / at or above the 75th confidence percentile of their run."""
    return ev.confidence_slices(tb.predictions(spark, d)).select(
        *ev.RUN, "sample_id", "true_label", "predicted_label", "confidence", "slice", "threshold")


@register("low_confidence_fixed", with_views(f"""
SELECT {_rowsel()}, {r6(CONF)} AS confidence FROM predictions
WHERE true_label <> predicted_label AND {CONF} < 0.6""", "predictions"))
def q_low_confidence_fixed(spark, d):
    """Errors whose confidence is below 0.6."""
    return ev.low_confidence_fixed(tb.predictions(spark, d)).select(
        *ev.RUN, "sample_id", "true_label", "predicted_label", "confidence")


# ---- H14 - H16: length bands ----------------------------------------------------------
_LEN = {"w": f"SELECT *, {wc_sql('text')} AS text_length FROM predictions",
        "cuts": f"SELECT {RUN}, quantile_cont(text_length, 0.33) AS short_cut, "
                f"quantile_cont(text_length, 0.66) AS medium_cut FROM w GROUP BY ALL"}
_BAND = ("CASE WHEN text_length <= short_cut THEN 'short' WHEN text_length <= medium_cut THEN 'medium' "
         "ELSE 'long' END")


@register("length_band_errors", with_views(f"""
SELECT {_rowsel()}, text_length, {r6('short_cut')} AS short_cut, {r6('medium_cut')} AS medium_cut, {_BAND} AS band
FROM w JOIN cuts USING (model, model_type, dataset) WHERE true_label <> predicted_label""", "predictions", extra=_LEN))
def q_length_band_errors(spark, d):
    """Errors by length band cut at the run's 33rd / 66th word-count percentile."""
    return ev.length_band_errors(tb.predictions(spark, d)).select(
        *ev.RUN, "sample_id", "true_label", "predicted_label", "text_length", "short_cut", "medium_cut", "band")


@register("length_band_errors_fixed", with_views(f"""
SELECT {_rowsel()}, text_length,
       CASE WHEN text_length <= 61 THEN 'short' WHEN text_length <= 68 THEN 'medium' ELSE 'long' END AS band
FROM w WHERE true_label <> predicted_label""", "predictions", extra={"w": _LEN["w"]}))
def q_length_band_errors_fixed(spark, d):
    """Errors by fixed length bands (61 / 68 words)."""
    return ev.length_band_errors_fixed(tb.predictions(spark, d)).select(
        *ev.RUN, "sample_id", "true_label", "predicted_label", "text_length", "band")


def _rate_parts() -> str:
    parts = []
    for b in ("short", "medium", "long"):
        parts.append(f"SELECT {RUN}, {r6('short_cut')} AS short_cut, {r6('medium_cut')} AS medium_cut, '{b}' AS band, "
                     f"{r6(f'coalesce(count_if(true_label <> predicted_label AND band = {chr(39)}{b}{chr(39)}) * 100.0 '
                           f'/ nullif(count_if(band = {chr(39)}{b}{chr(39)}), 0), 0.0)')} AS error_rate, "
                     f"count_if(band = '{b}') AS n_rows FROM j GROUP BY {RUN}, short_cut, medium_cut")
    return " UNION ALL ".join(parts)


_RATE_CTES = {**_LEN, "j": f"SELECT *, {_BAND} AS band FROM w JOIN cuts USING (model, model_type, dataset)"}


def _rate_sql() -> str:
    return with_views(_rate_parts(), "predictions", extra=_RATE_CTES)


@register("length_error_rate", _rate_sql())
def q_length_error_rate(spark, d):
    """Error rate per length band (same quantile cuts for numerator and denominator)."""
    return ev.length_error_rate(tb.predictions(spark, d))


# ---- H17 - H20: keyword statistics and error terms ------------------------------------
KEYWORD = "the"
KW_PATTERN = r"\bthe\b"


def kw_sql(x: str, word: str = KEYWORD) -> str:
    """Unicode whole-word match in DuckDB: non-word runs become two spaces (trap T21)."""
    return (f"regexp_matches(regexp_replace(lower({x}), '[^\\p{{L}}\\p{{N}}_]+', '  ', 'g'), "
            f"'(^| ){word}( |$)')")


@register("keyword_share_true", with_views(f"""
SELECT g.dataset, g.label, g.hits, g.n_rows, t.total_hits,
       {r6('coalesce(g.hits * 100.0 / nullif(t.total_hits, 0), 0.0)')} AS share
FROM g JOIN (SELECT dataset, sum(hits) AS total_hits FROM g GROUP BY dataset) t USING (dataset)""",
                                     "labeled_text", extra={
    "g": f"SELECT dataset, label, count_if({kw_sql('text')}) AS hits, count(*) AS n_rows FROM labeled_text "
         f"GROUP BY ALL"}))
def q_keyword_share_true(spark, d):
    """Share of keyword hits per true label, per dataset (keyword ``the``)."""
    return ev.keyword_share_true(tb.labeled_text(spark, d), KW_PATTERN).select(
        "dataset", "label", "hits", "n_rows", "total_hits", "share")


def grid_df(spark):
    rows = [(m, t, ds) for _, m, t in tb.run_grid() for ds in tb.GRID_DATASETS]
    return spark.createDataFrame(rows, "model string, model_type string, dataset string")


_GRID_SQL = "SELECT * FROM (VALUES " + ", ".join(
    "('{}', '{}', '{}')".format(m, t, ds) for _, m, t in tb.run_grid() for ds in tb.GRID_DATASETS
) + ") g(model, model_type, dataset)"


@register("keyword_share_predicted", with_views(f"""
SELECT g.model, g.model_type, g.dataset, g.label, g.hits, g.n_rows, t.total_hits,
       {r6('coalesce(g.hits * 100.0 / nullif(t.total_hits, 0), 0.0)')} AS share, 'ok' AS status
FROM g JOIN (SELECT {RUN}, sum(hits) AS total_hits FROM g GROUP BY ALL) t USING (model, model_type, dataset)
UNION ALL
SELECT model, model_type, dataset, NULL, NULL, NULL, NULL, NULL, 'skipped'
FROM grid WHERE (model, model_type, dataset) NOT IN (SELECT DISTINCT model, model_type, dataset FROM predictions)""",
                                          "predictions", extra={
    "g": f"SELECT {RUN}, predicted_label AS label, count_if({kw_sql('text')}) AS hits, count(*) AS n_rows "
         f"FROM predictions GROUP BY ALL",
    "grid": _GRID_SQL}))
def q_keyword_share_predicted(spark, d):
    """Share of keyword hits per predicted label for all runs; grid runs
    without predictions listed as skipped."""
    return ev.keyword_share_predicted(
        tb.predictions(spark, d, {"kw_hit": matches_pattern("text", KW_PATTERN)}), KW_PATTERN, grid_df(spark), "kw_hit").select(
        *ev.RUN, "label", "hits", "n_rows", "total_hits", "share", "status")


@register("keyword_rate_by_label", with_views(f"""
SELECT {RUN}, predicted_label AS label, count_if(contains(lower(text), 'the')) AS hits, count(*) AS n_rows,
       {r6("coalesce(count_if(contains(lower(text), 'the')) * 100.0 / nullif(count(*), 0), 0.0)")} AS rate
FROM predictions GROUP BY ALL""", "predictions"))
def q_keyword_rate_by_label(spark, d):
    """Keyword hits / rows of each predicted label per run."""
    return ev.keyword_rate_by_label(
        tb.predictions(spark, d, {"kw_hit": F.lower("text").contains(KEYWORD)}), KEYWORD, hit="kw_hit")


# Stop words removed from the error-term counts.
STOPWORDS = ["a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on",
             "or", "that", "the", "this", "to", "was", "were", "with"]
_STOP_SQL = ", ".join(f"'{w}'" for w in STOPWORDS)


@register("error_term_frequency", with_views(f"""
SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY model, model_type, dataset ORDER BY n DESC, term ASC) AS rank
  FROM (SELECT {RUN}, term, count(*) AS n FROM (
          SELECT {RUN}, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_][\\p{{L}}\\p{{N}}_'']+')) AS term
          FROM predictions WHERE true_label <> predicted_label)
        WHERE term NOT IN ({_STOP_SQL}) GROUP BY ALL))
WHERE rank <= 20""", "predictions"))
def q_error_term_frequency(spark, d):
    """Top-20 terms of misclassified texts per run (stop words removed)."""
    return ev.error_term_frequency(tb.predictions(spark, d), STOPWORDS, 20,
                                   samples=tb.eval_samples(spark, d).select("sample_id", "text"))


# ---- H21 - H23: two-stage refinement --------------------------------------------------
_REFINED = {"r": """SELECT p.*, s.secondary_label,
       CAST(CASE WHEN p.predicted_label = 2 AND s.secondary_label = 0 THEN 1
                 WHEN p.predicted_label = 2 AND s.secondary_label = 1 THEN 2
                 ELSE p.predicted_label END AS INTEGER) AS refined_label
FROM predictions p LEFT JOIN secondary_predictions s USING (sample_id)"""}


@register("two_stage_refine", with_views(f"""
SELECT {_rowsel()}, secondary_label, refined_label FROM r""", "predictions", "secondary_predictions",
                                          extra=_REFINED))
def q_two_stage_refine(spark, d):
    """Stage-2 decision on stage-1 positives."""
    r = ev.two_stage_refine(tb.predictions(spark, d, per_sample=tb.secondary_predictions(spark, d)), None)
    return r.select(*ev.RUN, "sample_id", "true_label", "predicted_label", "secondary_label", "refined_label")


@register("refine_impact", with_views(f"""
SELECT b.model, b.model_type, b.dataset, b.n, b.n_changed, b.n_fixed,
       {r6('b.accuracy')} AS accuracy_before, {r6('b.macro_f1')} AS f1_before,
       {r6('a.accuracy')} AS accuracy_after, {r6('a.macro_f1')} AS f1_after
FROM ({tallies_sql('r', ['model', 'model_type', 'dataset'],
                   extra="count_if(predicted_label <> refined_label) AS n_changed, "
                         "count_if(predicted_label <> refined_label AND refined_label = true_label) AS n_fixed")}) b
JOIN ({tallies_sql('r', ['model', 'model_type', 'dataset'], pred='refined_label')}) a
  USING (model, model_type, dataset)""", "predictions", "secondary_predictions", extra=_REFINED))
def q_refine_impact(spark, d):
    """Accuracy / macro F1 before and after refinement, changes and fixes per run."""
    r = ev.two_stage_refine(tb.predictions(spark, d, per_sample=tb.secondary_predictions(spark, d)), None)
    return ev.refine_impact(r)


@register("detail_table", with_views(f"""
SELECT model, model_type, dataset, sample_id, text, true_label, predicted_label AS primary_label, refined_label
FROM r""", "predictions", "secondary_predictions", extra=_REFINED))
def q_detail_table(spark, d):
    """Text, truth, primary and refined label per row."""
    r = ev.two_stage_refine(tb.predictions(spark, d, per_sample=tb.secondary_predictions(spark, d)), None)
    return ev.detail_table(r)


# ---- H25 / H26: losses ----------------------------------------------------------------
_LOSS = {"s": "SELECT *, list_max(logits) AS m FROM predictions",
         "z": "SELECT *, list_reduce(list_transform(logits, lambda x: exp(x - m)), lambda a, b: a + b) AS z FROM s",
         "l": "SELECT *, -ln(p_true) AS ce, -1.0 * pow(1 - p_true, 2.0) * ln(p_true) AS focal FROM "
              "(SELECT *, greatest(exp(logits[true_label + 1] - m) / z, 1e-9) AS p_true FROM z)"}


@register("cross_entropy_and_focal", with_views(f"""
SELECT model, model_type, dataset, sample_id, {r6('p_true')} AS p_true, {r6('ce')} AS ce, {r6('focal')} AS focal
FROM l""", "predictions", extra=_LOSS))
def q_cross_entropy_and_focal(spark, d):
    """Per-row softmax probability of the truth, cross-entropy and focal loss."""
    return ev.cross_entropy_and_focal(tb.predictions(spark, d)).select(*ev.RUN, "sample_id", "p_true", "ce", "focal")


@register("perplexity", with_views(f"""
SELECT {RUN}, {r6('avg(ce)')} AS ce_mean, {r6('sum(ce)')} AS ce_sum, {r6('avg(focal)')} AS focal_mean,
       {r6('sum(focal)')} AS focal_sum, {r6('exp(avg(ce))')} AS perplexity
FROM l GROUP BY ALL""", "predictions", extra=_LOSS))
def q_perplexity(spark, d):
    """H25 + H26 reductions: mean / sum losses and exp(mean CE) per run."""
    return ev.loss_summary(ev.cross_entropy_and_focal(tb.predictions(spark, d)))


# ---- H27 / H28 / H31: length features ------------------------------------------------
_LF = {"w": f"SELECT *, {wc_sql('text')} AS text_length FROM texts",
       "mm": "SELECT min(text_length) AS mn, max(text_length) AS mx FROM w",
       "f": "SELECT w.*, CASE WHEN mx = mn THEN 0.0 ELSE (text_length - mn) / (mx - mn) END AS text_length_scaled "
            "FROM w, mm",
       "f2": "SELECT *, ln(1 + text_length_scaled) AS text_length_log FROM f"}


@register("length_features", with_views(f"""
SELECT sample_id, dataset, text_length, {r6('text_length_scaled')} AS text_length_scaled,
       {r6('text_length_log')} AS text_length_log FROM f2""", "texts", extra=_LF))
def q_length_features(spark, d):
    """Word count, min-max scaled over all datasets, and its log1p."""
    return ev.length_features(tb.texts(spark, d)).select(
        "sample_id", "dataset", "text_length", "text_length_scaled", "text_length_log")


@register("length_policy", with_views(f"""
SELECT dataset, {r6('avg_length')} AS avg_length,
       {r6('max(CASE WHEN text_length > avg_length THEN 1e-5 ELSE 2e-5 END)')} AS learning_rate,
       max(CASE WHEN text_length > avg_length THEN 6 ELSE 3 END) AS num_epochs,
       count_if(text_length > avg_length) AS n_long, count(*) AS n_rows,
       {r6('avg(greatest(0.5, 1 - text_length / max_length))')} AS mean_lr_factor
FROM w JOIN (SELECT dataset, avg(text_length) AS avg_length, max(text_length) AS max_length FROM w GROUP BY dataset)
  USING (dataset)
GROUP BY dataset, avg_length""", "texts", extra={"w": _LF["w"]}))
def q_length_policy(spark, d):
    """Per-dataset learning rate / epochs from rows longer than the dataset mean."""
    return ev.length_policy(tb.texts(spark, d), epochs=3)


@register("length_histogram", with_views("""
SELECT g.bin, round(mn + g.bin * (mx - mn) / 50, 6) AS bin_start, coalesce(c.n, 0) AS n
FROM (SELECT range AS bin FROM range(50)) g CROSS JOIN m
LEFT JOIN (SELECT CAST(CASE WHEN (mx - mn) / 50 = 0 THEN 0
                            ELSE least(floor((text_length_log - mn) / ((mx - mn) / 50)), 49) END AS INTEGER) AS bin,
                  count(*) AS n
           FROM f2, m GROUP BY 1) c ON c.bin = g.bin""", "texts", extra={
    **_LF, "m": "SELECT min(text_length_log) AS mn, max(text_length_log) AS mx FROM f2"}))
def q_length_histogram(spark, d):
    """50-bin histogram of the log-scaled text length."""
    return ev.length_histogram(ev.length_features(tb.texts(spark, d)), "text_length_log", 50)


# ---- H29: attention statistics ---------------------------------------------------------
_ATT = {"att": f"""
SELECT vec_id AS sample_id, CAST(i // 16 AS INTEGER) AS layer, CAST((i % 16) // 4 AS INTEGER) AS query_pos,
       CAST(i % 4 AS INTEGER) AS key_pos, abs(CAST(w AS DOUBLE)) AS weight,
       {H("'tgt:' || CAST(vec_id AS VARCHAR) || ':' || CAST(i % 4 AS VARCHAR)")} % 3 = 0
         AS is_target
FROM (SELECT vec_id, unnest(embedding) AS w, unnest(generate_series(0, len(embedding) - 1)) AS i FROM embeddings)""",
        "ratios": """
SELECT c.sample_id, c.layer, c.col_sum / m.total AS ratio
FROM (SELECT sample_id, layer, key_pos, sum(weight) AS col_sum FROM att WHERE is_target GROUP BY ALL) c
JOIN (SELECT sample_id, layer, sum(weight) AS total FROM att GROUP BY ALL) m USING (sample_id, layer)
WHERE m.total > 0"""}


@register("layer_attention_stats", with_views(f"""
SELECT t.layer, coalesce(s.n_targets, 0) AS n_targets, {r6('coalesce(s.mean_ratio, 0.0)')} AS mean_ratio,
       {r6('CASE WHEN s.n_targets IS NULL THEN 0.0 ELSE s.std_ratio END')} AS std_ratio,
       {r6('CASE WHEN s.n_targets IS NULL THEN 0.0 ELSE s.mean_ratio + 2 * s.std_ratio END')} AS threshold,
       {r6('t.avg_target_weight')} AS avg_target_weight, {r6('t.avg_other_weight')} AS avg_other_weight
FROM (SELECT layer, avg(CASE WHEN is_target THEN weight END) AS avg_target_weight,
             avg(CASE WHEN NOT is_target THEN weight END) AS avg_other_weight FROM att GROUP BY layer) t
LEFT JOIN (SELECT layer, avg(ratio) AS mean_ratio, stddev_samp(ratio) AS std_ratio, count(*) AS n_targets
           FROM ratios GROUP BY layer) s USING (layer)""", extra=_ATT))
def q_layer_attention_stats(spark, d):
    """Per layer, mean / std / threshold of the attention share on target tokens."""
    return ev.layer_attention_stats(tb.attention(spark, d))
