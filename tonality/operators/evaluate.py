"""Scoring and evaluation over a predictions table.

Input is ``(model, model_type, dataset, sample_id, text, true_label, logits,
predicted_label)``; every operator runs once over all runs with a ``groupBy`` on
the run keys (one partial + final aggregate, no per-run loop)."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonality.functions.labels import argmax, remap_prediction
from tonality.functions.text import matches_pattern, model_family, word_count
from tonality.operators.stats import group_percentiles, histogram_percentiles, safe_ratio, written

RUN = ["model", "model_type", "dataset"]
LABELS = [0, 1, 2]
# Class names of the canonical space, in label order.
LABEL_NAMES = ["negative", "neutral", "positive"]


def _t() -> Column:
    return F.col("true_label")


def _p() -> Column:
    return F.col("predicted_label")


def argmax_label(preds: DataFrame, logits: str = "logits", out: str = "raw_label") -> DataFrame:
    """H1: class with the largest logit, first index on ties."""
    return preds.withColumn(out, argmax(logits))


def prediction_remap(preds: DataFrame, raw: str = "raw_label", out: str = "predicted_label") -> DataFrame:
    """Model-specific class id -> canonical id by model family."""
    return preds.withColumn(out, remap_prediction(raw, model_family("model")))


def attach_predictions(samples: DataFrame, preds: DataFrame, keys=("dataset", "sample_id"),
                       validate: bool = True) -> DataFrame:
    """H2: join predictions to their samples on an explicit key.

    With ``validate`` the action that uses the result also counts the keys present on only one
    side and fails when there are any (the reference's length check); no job runs before."""
    keys = list(keys)
    if validate:
        s = samples.select(*keys).withColumn("_s", F.lit(1))
        p = preds.select(*keys).distinct().withColumn("_p", F.lit(1))
        odd = s.join(p, keys, "full_outer").agg(F.count_if(F.col("_s").isNull() | F.col("_p").isNull()).alias("_odd"))
        said = F.concat(F.lit("predictions and samples are not aligned: "), F.col("_odd").cast("string"), F.lit(" keys on one side only"))
        # one row, made whether or not any rows meet
        odd = odd.select(F.when(F.col("_odd") > 0, F.raise_error(said).cast("boolean")).otherwise(F.lit(True)).alias("_aligned"))
        samples = samples.crossJoin(F.broadcast(odd)).where("_aligned").drop("_aligned")
    return preds.join(samples, keys, "inner")


def _label_counts(keys: list[str], truth: str = "true_label", pred: str = "predicted_label") -> list[Column]:
    """Every count the metric operators need, as one list of aggregate
    expressions (written as SQL text: one JVM call each)."""
    aggs = ["count(1) AS n", f"count_if({truth} = {pred}) AS n_correct"]
    for k in LABELS:
        aggs += [f"count_if({truth} = {k} AND {pred} = {k}) AS tp_{k}", f"count_if({truth} = {k}) AS true_{k}",
                 f"count_if({pred} = {k}) AS pred_{k}"]
    return [F.expr(a) for a in aggs]


def _ratio(num: str, den: str) -> str:
    return f"coalesce(try_divide(CAST({num} AS DOUBLE), CAST({den} AS DOUBLE)), 0.0)"


def _per_class(df: DataFrame) -> DataFrame:
    """Per-class precision / recall / F1 and macro / weighted averages from the
    counts, in two projections of SQL expressions (0 where undefined)."""
    per = []
    for k in LABELS:
        per += [f"{_ratio(f'tp_{k}', f'pred_{k}')} AS precision_{k}", f"{_ratio(f'tp_{k}', f'true_{k}')} AS recall_{k}",
                f"{_ratio(f'2 * tp_{k}', f'true_{k} + pred_{k}')} AS f1_{k}",
                f"CAST(true_{k} + pred_{k} > 0 AS INT) AS present_{k}"]
    df = df.selectExpr("*", *per)
    n_present = " + ".join(f"present_{k}" for k in LABELS)
    avg = [f"{_ratio('n_correct', 'n')} AS accuracy"]
    for m in ("precision", "recall", "f1"):
        avg.append(f"{_ratio(' + '.join(f'{m}_{k} * present_{k}' for k in LABELS), n_present)} AS macro_{m}")
        avg.append(f"{_ratio(' + '.join(f'{m}_{k} * true_{k}' for k in LABELS), 'n')} AS weighted_{m}")
    return df.selectExpr("*", *avg)


def label_tallies(preds: DataFrame, keys=RUN, truth: str = "true_label", pred: str = "predicted_label") -> DataFrame:
    """One aggregate per run with every count the metric operators need."""
    return _per_class(preds.groupBy(*keys).agg(*_label_counts(list(keys), truth, pred)))


def overall_metrics(preds: DataFrame, keys=RUN, truth: str = "true_label", pred: str = "predicted_label") -> DataFrame:
    """H3: accuracy and macro precision / recall / F1 per run.

    Macro averages cover the labels seen in truth or prediction (0 when undefined)."""
    return label_tallies(preds, keys, truth, pred).select(
        *keys, "n", "accuracy", F.col("macro_precision").alias("precision"),
        F.col("macro_recall").alias("recall"), F.col("macro_f1").alias("f1"))


def confusion_matrix(preds: DataFrame, keys=RUN) -> DataFrame:
    """H4: 3 x 3 counts over labels 0, 1, 2 per run, zero-filled (conditional counts
    in one aggregate, then unpivoted: no grid join)."""
    cells = [F.count_if((_t() == t) & (_p() == p)).alias(f"c_{t}_{p}") for t in LABELS for p in LABELS]
    wide = preds.groupBy(*keys).agg(*cells)
    rows = F.array(*[F.struct(F.lit(t).alias("true_label"), F.lit(p).alias("predicted_label"),
                              F.col(f"c_{t}_{p}").alias("n")) for t in LABELS for p in LABELS])
    return wide.select(*keys, F.inline(rows))


def class_report(preds: DataFrame, keys=RUN) -> DataFrame:
    """H5: per class precision / recall / F1 / support, then accuracy, macro avg and
    weighted avg rows (the layout of a classification report)."""
    t = label_tallies(preds, keys)
    null = F.lit(None).cast("double")
    rows = [F.struct(F.lit(LABEL_NAMES[k]).alias("label"), F.col(f"precision_{k}").alias("precision"),
                     F.col(f"recall_{k}").alias("recall"), F.col(f"f1_{k}").alias("f1"),
                     F.col(f"true_{k}").alias("support")) for k in LABELS]
    rows.append(F.struct(F.lit("accuracy").alias("label"), null.alias("precision"), null.alias("recall"),
                         F.col("accuracy").alias("f1"), F.col("n").alias("support")))
    for avg in ("macro", "weighted"):
        rows.append(F.struct(F.lit(f"{avg} avg").alias("label"), F.col(f"{avg}_precision").alias("precision"),
                             F.col(f"{avg}_recall").alias("recall"), F.col(f"{avg}_f1").alias("f1"),
                             F.col("n").alias("support")))
    return t.select(*keys, F.inline(F.array(*rows)))


def with_confidence(preds: DataFrame, softmax: bool = False) -> DataFrame:
    """H11 (row level): confidence = largest raw logit (trap T4), or its softmax."""
    if not softmax:
        return preds.withColumn("confidence", F.array_max("logits"))
    m = F.array_max("logits")
    z = F.aggregate("logits", F.lit(0.0), lambda acc, x: acc + F.exp(x - m))
    return preds.withColumn("confidence", F.lit(1.0) / z)


def misclassified(preds: DataFrame) -> DataFrame:
    """H6: rows whose prediction differs from the truth."""
    return preds.where(_t() != _p())


# The error slices the reference writes out.
ERROR_DIRECTIONS = [("pos_to_neg", 2, 0), ("neg_to_pos", 0, 2), ("neu_to_pos", 1, 2)]


def error_direction(preds: DataFrame) -> DataFrame:
    """H7: the pos->neg, neg->pos and neu->pos slices, tagged."""
    tag = F.lit(None).cast("string")
    for name, t, p in reversed(ERROR_DIRECTIONS):
        tag = F.when((_t() == t) & (_p() == p), name).otherwise(tag)
    return preds.withColumn("direction", tag).where(F.col("direction").isNotNull())


def big_error_counts(preds: DataFrame, keys=RUN) -> DataFrame:
    """H8: number of 2 -> 0 and 0 -> 2 errors per run."""
    return preds.groupBy(*keys).agg(F.count_if((_t() == 2) & (_p() == 0)).alias("pos_to_neg"),
                                    F.count_if((_t() == 0) & (_p() == 2)).alias("neg_to_pos"))


def error_transitions(preds: DataFrame, keys=RUN) -> DataFrame:
    """H9: the six off-diagonal counts plus true and predicted label counts."""
    aggs = [F.count_if((_t() == t) & (_p() == p)).alias(f"n_{t}_to_{p}") for t in LABELS for p in LABELS if t != p]
    aggs += [F.count_if(_t() == k).alias(f"true_{k}") for k in LABELS]
    aggs += [F.count_if(_p() == k).alias(f"pred_{k}") for k in LABELS]
    return preds.groupBy(*keys).agg(*aggs)


def false_pos_neg(preds: DataFrame, cls: int = 0) -> DataFrame:
    """One-vs-rest false positives and false negatives for one class."""
    kind = F.when((_t() != cls) & (_p() == cls), "false_positive").when((_t() == cls) & (_p() != cls), "false_negative")
    return preds.withColumn("kind", kind).where(F.col("kind").isNotNull())


def confidence_slices(preds: DataFrame, keys=RUN, low: float = 0.25, high: float = 0.75,
                      accuracy: int = 10000) -> DataFrame:
    """Errors below the low / at or above the high confidence percentile of
    their run; the threshold stays as a column.  Thresholds are one row per run, written
    first, so that the predictions are joined with a table of known size and need not be
    shuffled on the run keys."""
    c = with_confidence(preds)
    thr = written(group_percentiles(c, list(keys), "confidence", {"low_thr": low, "high_thr": high}, accuracy), "thresholds")
    j = misclassified(c).join(thr, list(keys))
    is_low, is_high = F.col("confidence") < F.col("low_thr"), F.col("confidence") >= F.col("high_thr")
    return j.where(is_low | is_high).withColumn("slice", F.when(is_low, "low").otherwise("high")).withColumn(
        "threshold", F.when(is_low, F.col("low_thr")).otherwise(F.col("high_thr"))).drop("low_thr", "high_thr")


def low_confidence_fixed(preds: DataFrame, threshold: float = 0.6) -> DataFrame:
    """Errors with confidence below a fixed cut (raw logit, trap T4)."""
    return misclassified(with_confidence(preds)).where(F.col("confidence") < threshold)


def _with_length(preds: DataFrame) -> DataFrame:
    """Word count per row; reused when the table already carries it (computed
    once per sample before the runs were attached)."""
    if "text_length" in preds.columns:
        return preds
    return preds.withColumn("text_length", word_count("text"))


def _band(length: Column, short_cut: Column, medium_cut: Column) -> Column:
    return (F.when(length <= short_cut, "short").when(length <= medium_cut, "medium")
            .when(length.isNotNull(), "long"))


def length_band_errors(preds: DataFrame, keys=RUN) -> DataFrame:
    """Errors in short / medium / long bands cut at the run's 33rd and 66th
    percentile of word count."""
    w = _with_length(preds)
    hist = w.groupBy(*keys, "text_length").agg(F.count(F.lit(1)).alias("_n"))
    cuts = written(histogram_percentiles(hist, list(keys), "text_length", "_n", {"short_cut": 0.33, "medium_cut": 0.66}), "cuts")
    j = misclassified(w).join(cuts, list(keys))
    return j.withColumn("band", _band(F.col("text_length"), F.col("short_cut"), F.col("medium_cut")))


def length_band_errors_fixed(preds: DataFrame, short_cut: int = 61, medium_cut: int = 68) -> DataFrame:
    """The same bands with fixed cuts."""
    w = misclassified(_with_length(preds))
    return w.withColumn("band", _band(F.col("text_length"), F.lit(short_cut), F.lit(medium_cut)))


def length_error_rate(preds: DataFrame, keys=RUN, mode: str = "same",
                      fixed=(61, 68)) -> DataFrame:
    """Error rate (percent) per length band, 0 for an empty band.

    ``mode='same'`` uses the quantile cuts for numerator and denominator;
    ``mode='as_is'`` reproduces the reference (denominators on fixed cuts, trap T5)."""
    # everything follows from one aggregate, a row per run and text length
    w = _with_length(preds).groupBy(*keys, "text_length").agg(
        F.count(F.lit(1)).alias("_n"), F.count_if(_t() != _p()).alias("_errors"))
    cuts = histogram_percentiles(w, list(keys), "text_length", "_n", {"short_cut": 0.33, "medium_cut": 0.66})
    j = w.join(cuts, list(keys))
    err_band = _band(F.col("text_length"), F.col("short_cut"), F.col("medium_cut"))
    den_band = err_band if mode == "same" else _band(F.col("text_length"), F.lit(fixed[0]), F.lit(fixed[1]))
    aggs = []
    for b in ("short", "medium", "long"):
        aggs.append((F.sum(F.when(err_band == b, F.col("_errors")).otherwise(0)) * 100.0).alias(f"_e_{b}"))
        aggs.append(F.sum(F.when(den_band == b, F.col("_n")).otherwise(0)).alias(f"_d_{b}"))
    g = j.groupBy(*keys, "short_cut", "medium_cut").agg(*aggs)
    rows = F.array(*[F.struct(F.lit(b).alias("band"), safe_ratio(F.col(f"_e_{b}"), F.col(f"_d_{b}")).alias("error_rate"),
                              F.col(f"_d_{b}").alias("n_rows")) for b in ("short", "medium", "long")])
    return g.select(*keys, "short_cut", "medium_cut", F.inline(rows))


def keyword_share_true(df: DataFrame, pattern: str, keys=("dataset",), label: str = "label", hit: str | None = None) -> DataFrame:
    """For rows matching the pattern, percent of all hits per true label
    (labels without rows are not listed; 0 when there are no hits).  ``hit`` names a
    column that holds the match already (made per sample, before runs multiply the rows)."""
    keys = list(keys)
    hit = F.col(hit) if hit else matches_pattern("text", pattern)
    g = df.groupBy(*keys, F.col(label).alias("label")).agg(F.count_if(hit).alias("hits"),
                                                             F.count(F.lit(1)).alias("n_rows"))
    tot = g.groupBy(*keys).agg(F.sum("hits").alias("total_hits"))
    return g.join(tot, keys).withColumn("share", safe_ratio(F.col("hits") * 100.0, F.col("total_hits")))


def keyword_share_predicted(preds: DataFrame, pattern: str, grid: DataFrame | None = None, hit: str | None = None) -> DataFrame:
    """As H17 per predicted label for every run at once.  Runs of ``grid``
    without predictions are listed once with status ``skipped``."""
    out = keyword_share_true(preds, pattern, RUN, "predicted_label", hit).withColumn("status", F.lit("ok"))
    if grid is None:
        return out
    out = written(out, "shares")  # a row per run and label; read twice
    missing = grid.join(out.select(*RUN).distinct(), RUN, "left_anti")
    null_i, null_l = F.lit(None).cast("int"), F.lit(None).cast("bigint")
    skipped = missing.select(*RUN, null_i.alias("label"), null_l.alias("hits"), null_l.alias("n_rows"),
                             null_l.alias("total_hits"), F.lit(None).cast("double").alias("share"),
                             F.lit("skipped").alias("status"))
    return out.unionByName(skipped)


def keyword_rate_by_label(preds: DataFrame, word: str, keys=RUN, hit: str | None = None) -> DataFrame:
    """Keyword hits (case-insensitive substring, or the column ``hit``) / rows of each predicted label."""
    hit = F.col(hit) if hit else F.lower(F.col("text")).contains(word.lower())
    return preds.groupBy(*keys, F.col("predicted_label").alias("label")).agg(
        F.count_if(hit).alias("hits"), F.count(F.lit(1)).alias("n_rows")).withColumn(
        "rate", safe_ratio(F.col("hits") * 100.0, F.col("n_rows")))


# Term pattern of the word-cloud data: two or more word characters / apostrophes.
TERM = r"[\p{L}\p{N}_][\p{L}\p{N}_']+"


def error_term_frequency(preds: DataFrame, stopwords: list[str], k: int = 20, which: str = "misclassified",
                         keys=RUN, key: str = "sample_id", samples: DataFrame | None = None) -> DataFrame:
    """Term counts over misclassified (or neg->pos) texts, top k per run.

    Every run of a sample shares its text, so each erroneous sample is tokenised once and its
    terms are sorted and run-length counted inside the row.  The runs that got a sample wrong
    stand beside its counts as an array and are unfolded into partial sums: the terms are
    exchanged once, as sums of each task.  The top-k window is planned with a map-side group
    limit.  ``samples`` (one row per ``key`` with its text) saves de-duplicating the texts out
    of the per-run rows."""
    errs = (misclassified(preds) if which == "misclassified" else preds.where((_t() == 0) & (_p() == 2)))
    # runs are numbered, so that the sums are keyed by a number and a term; a row for each run
    numbers = errs.select(*keys).distinct().withColumn("_run", F.row_number().over(Window.orderBy(*keys)))
    numbers = written(numbers, "run-numbers")
    runs = errs.join(numbers, list(keys)).groupBy(key).agg(F.collect_list("_run").alias("_runs"))
    src = samples.select(key, "text") if samples is not None else preds.select(key, "text").distinct()
    # both sides grow with the samples: the texts are dealt by key, whatever their files' layout
    hist = src.join(runs.hint("shuffle_hash"), key).select("_runs", term_counts("text", stopwords).alias("_terms"))
    # inline_outer: for a plain inline Catalyst infers a filter on the array's size, which it pushes,
    # tokenising and all, below the join
    counts = hist.select("_runs", F.inline_outer("_terms")).where(F.col("term").isNotNull())
    counts = counts.select("term", "n_in_text", F.explode_outer("_runs").alias("_run"))
    counts = counts.groupBy("_run", "term").agg(F.sum("n_in_text").alias("n"))
    w = Window.partitionBy("_run").orderBy(F.desc("n"), F.asc("term"))
    best = counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return best.join(numbers, "_run").select(*keys, "term", "n", "rank")


def term_counts(text: str, stopwords: list[str]) -> Column:
    """Array of (term, n_in_text): the text's terms but the stop words, counted inside the row.
    One ``aggregate`` over the sorted terms would copy its state at each step; the starts of the
    runs of equal terms and their distances need none."""
    stop = F.array(*[F.lit(w) for w in sorted(set(stopwords))]).cast("array<string>")
    found = F.array_sort(F.filter(F.regexp_extract_all(F.lower(text), F.lit(TERM), 0), lambda t: ~F.array_contains(stop, t)))

    def runs(s: Column) -> Column:
        at = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
        return F.transform(F.array(at), lambda a: F.transform(a, lambda i, k: F.struct(
            F.get(s, i).alias("term"), (F.coalesce(F.get(a, k + 1), F.size(s)) - i).cast("long").alias("n_in_text"))))[0]

    # bound once by a lambda: an expression used twice would tokenise twice
    none = F.array().cast("array<struct<term:string,n_in_text:bigint>>")
    return F.transform(F.array(found), lambda s: F.when(F.size(s) > 0, runs(s)).otherwise(none))[0]


def two_stage_refine(primary: DataFrame, secondary: DataFrame | None, key: str = "sample_id") -> DataFrame:
    """Where stage 1 says positive (2), stage 2 decides: 0 -> neutral (1),
    1 -> positive (2); otherwise, or without a stage-2 answer, unchanged.  Without a
    ``secondary`` table the predictions carry ``secondary_label`` themselves (joined per
    sample, before runs multiply the rows)."""
    j = primary if secondary is None else primary.join(secondary.select(key, "secondary_label"), key, "left")
    refined = (F.when((_p() == 2) & (F.col("secondary_label") == 0), 1)
               .when((_p() == 2) & (F.col("secondary_label") == 1), 2).otherwise(_p()))
    return j.withColumn("refined_label", refined.cast("int"))


def refine_impact(refined: DataFrame, keys=RUN) -> DataFrame:
    """Metrics before and after refinement, changes, and changes that became
    right; before and after tallies come from one aggregate per run."""
    keys = list(keys)
    r = F.col("refined_label")
    after = [F.count_if(_t() == r).alias("a_n_correct")]
    for k in LABELS:
        after += [F.count_if((_t() == k) & (r == k)).alias(f"a_tp_{k}"), F.count_if(r == k).alias(f"a_pred_{k}")]
    g = refined.groupBy(*keys).agg(
        *_label_counts(keys), *after,
        F.count_if(_p() != r).alias("n_changed"),
        F.count_if((_p() != r) & (r == _t())).alias("n_fixed"))
    before = _per_class(g)
    swapped = before.select(*keys, "n", "n_changed", "n_fixed", F.col("accuracy").alias("accuracy_before"),
                            F.col("macro_f1").alias("f1_before"), *[F.col(f"true_{k}") for k in LABELS],
                            F.col("a_n_correct").alias("n_correct"),
                            *[F.col(f"a_tp_{k}").alias(f"tp_{k}") for k in LABELS],
                            *[F.col(f"a_pred_{k}").alias(f"pred_{k}") for k in LABELS])
    aft = _per_class(swapped)
    return aft.select(*keys, "n", "n_changed", "n_fixed", "accuracy_before", "f1_before",
                      F.col("accuracy").alias("accuracy_after"), F.col("macro_f1").alias("f1_after"))


def detail_table(refined: DataFrame, keys=RUN) -> DataFrame:
    """Text, truth, primary and refined prediction per row."""
    return refined.select(*keys, "sample_id", "text", "true_label",
                          F.col("predicted_label").alias("primary_label"), "refined_label")


def masked_token_accuracy(df: DataFrame, keys, labels: str = "mlm_labels", preds: str = "mlm_predictions") -> DataFrame:
    """Accuracy over token positions whose label is not -100."""
    ok = F.size(F.filter(F.zip_with(labels, preds, lambda a, b: (a != -100) & (a == b)), lambda x: x))
    scored = F.size(F.filter(labels, lambda a: a != -100))
    return df.groupBy(*keys).agg(F.sum(ok).alias("n_correct"), F.sum(scored).alias("n_scored")).withColumn(
        "accuracy", safe_ratio(F.col("n_correct"), F.col("n_scored")))


def cross_entropy_and_focal(preds: DataFrame, alpha: float = 1.0, gamma: float = 2.0) -> DataFrame:
    """H26 (row level): softmax with max shift, p(true) clamped at 1e-9,
    CE = -ln p and focal = -alpha (1 - p)^gamma ln p."""
    m = F.array_max("logits")
    z = F.aggregate("logits", F.lit(0.0), lambda acc, x: acc + F.exp(x - m))
    p = F.greatest(F.exp(F.element_at("logits", _t() + 1) - m) / z, F.lit(1e-9))
    return preds.withColumn("p_true", p).withColumns({
        "ce": -F.log(F.col("p_true")),
        "focal": -F.lit(alpha) * F.pow(1 - F.col("p_true"), F.lit(gamma)) * F.log(F.col("p_true"))})


def loss_summary(losses: DataFrame, keys=RUN) -> DataFrame:
    """H26 reductions (mean, sum) and H25 perplexity = exp(mean loss) per run."""
    return losses.groupBy(*keys).agg(
        F.avg("ce").alias("ce_mean"), F.sum("ce").alias("ce_sum"),
        F.avg("focal").alias("focal_mean"), F.sum("focal").alias("focal_sum"),
        F.exp(F.avg("ce")).alias("perplexity"))


def perplexity(losses: DataFrame, keys=RUN, loss: str = "ce") -> DataFrame:
    """exp(mean loss) per run."""
    return losses.groupBy(*keys).agg(F.exp(F.avg(loss)).alias("perplexity"))


def length_features(df: DataFrame) -> DataFrame:
    """Word count, min-max scaled over all rows (0 when the range is 0), and
    log1p of the scaled value.  The global min / max is a one-row aggregate
    broadcast to every task (size 1 by construction)."""
    w = df.withColumn("text_length", word_count("text"))
    mm = w.agg(F.min("text_length").alias("_min"), F.max("text_length").alias("_max"))
    j = w.join(F.broadcast(mm), how="cross")
    rng = F.col("_max") - F.col("_min")
    scaled = F.when(rng == 0, F.lit(0.0)).otherwise((F.col("text_length") - F.col("_min")) / rng)
    return j.withColumn("text_length_scaled", scaled).withColumn(
        "text_length_log", F.log1p("text_length_scaled")).drop("_min", "_max")


def length_policy(df: DataFrame, epochs: int = 3, keys=("dataset",), length: str = "text_length") -> DataFrame:
    """Rows longer than their dataset's mean get (1e-5, epochs + 3), others
    (2e-5, epochs); a dataset takes the max of each."""
    keys = list(keys)
    if length not in df.columns:
        df = df.withColumn(length, word_count("text"))
    # everything follows from one aggregate, a row per dataset and length
    hist = df.groupBy(*keys, length).agg(F.count(F.lit(1)).alias("_n"))
    known = F.when(F.col(length).isNotNull(), F.col("_n"))
    avg = hist.groupBy(*keys).agg((F.sum(F.col(length) * F.col("_n")) / F.sum(known)).alias("avg_length"),
                                  F.max(length).alias("max_length"))
    j = hist.join(avg, keys)
    long_row = F.col(length) > F.col("avg_length")
    factor = F.greatest(F.lit(0.5), 1 - F.col(length) / F.col("max_length"))
    return j.groupBy(*keys, "avg_length").agg(
        F.max(F.when(long_row, 1e-5).otherwise(2e-5)).alias("learning_rate"),
        F.max(F.when(long_row, epochs + 3).otherwise(epochs)).alias("num_epochs"),
        F.coalesce(F.sum(F.when(long_row, F.col("_n"))), F.lit(0)).alias("n_long"), F.sum("_n").alias("n_rows"),
        (F.sum(factor * F.col("_n")) / F.sum(F.when(factor.isNotNull(), F.col("_n")))).alias("mean_lr_factor"))


def layer_attention_stats(att: DataFrame) -> DataFrame:
    """Share of attention that lands on target key positions, per layer.

    ``att`` is ``(sample_id, layer, query_pos, key_pos, weight, is_target)`` with the
    heads already averaged.  Each (sample, layer, target position) gives one ratio
    (column sum / matrix sum); per layer: mean, sample std (null for one value),
    threshold mean + 2 std, 0 for a layer without targets; plus the average
    weight on target and on other positions."""
    on = F.col("is_target")
    weight = lambda cond: F.when(cond, F.col("weight"))
    # one exchange: a matrix is one group, its columns are summed in the same partition
    cols = att.repartition("sample_id", "layer").groupBy("sample_id", "layer", "key_pos").agg(
        F.sum("weight").alias("_w"), F.sum(weight(on)).alias("_t"), F.count_if(on).alias("_is"), F.count(weight(on)).alias("_tn"),
        F.sum(weight(~on)).alias("_o"), F.count(weight(~on)).alias("_on"))
    mats = cols.groupBy("sample_id", "layer").agg(
        F.sum("_w").alias("_total"), F.sum("_t").alias("_t"), F.sum("_tn").alias("_tn"), F.sum("_o").alias("_o"), F.sum("_on").alias("_on"),
        F.collect_list(F.when(F.col("_is") > 0, F.struct("_t"))).alias("_cols"))
    rows = mats.select("layer", "_total", "_t", "_tn", "_o", "_on", F.posexplode_outer("_cols").alias("_pos", "_col"))
    ratio = F.when((F.col("_total") > 0) & F.col("_col").isNotNull(), F.struct((F.col("_col._t") / F.col("_total")).alias("r")))
    rows = rows.withColumn("_r", ratio).withColumn("_once", F.coalesce("_pos", F.lit(0)) == 0)  # a matrix's own sums count once
    once = lambda c: F.sum(F.when(F.col("_once"), F.col(c)))
    out = rows.groupBy("layer").agg(
        F.avg("_r.r").alias("mean_ratio"), F.stddev_samp("_r.r").alias("std_ratio"), F.nullif(F.count("_r"), F.lit(0)).alias("n_targets"),
        F.try_divide(once("_t"), once("_tn")).alias("avg_target_weight"), F.try_divide(once("_o"), once("_on")).alias("avg_other_weight"))
    return out.select("layer", F.coalesce("n_targets", F.lit(0)).alias("n_targets"),
                      F.coalesce("mean_ratio", F.lit(0.0)).alias("mean_ratio"),
                      F.when(F.col("n_targets").isNull(), F.lit(0.0)).otherwise(F.col("std_ratio")).alias("std_ratio"),
                      F.when(F.col("n_targets").isNull(), F.lit(0.0))
                      .otherwise(F.col("mean_ratio") + 2 * F.col("std_ratio")).alias("threshold"),
                      "avg_target_weight", "avg_other_weight")


def length_histogram(df: DataFrame, value: str = "text_length_log", bins: int = 50) -> DataFrame:
    """Counts in ``bins`` equal-width bins between min and max (last bin closed),
    zero bins included.  Min / max is a one-row aggregate; the bin grid is
    generated from it (``bins`` rows)."""
    mm = df.agg(F.min(value).alias("_min"), F.max(value).alias("_max"))
    width = (F.col("_max") - F.col("_min")) / bins
    idx = F.when(width == 0, F.lit(0)).otherwise(
        F.least(F.floor((F.col(value) - F.col("_min")) / width), F.lit(bins - 1))).cast("int")
    counts = df.where(F.col(value).isNotNull()).join(F.broadcast(mm), how="cross").groupBy(idx.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"))
    grid = mm.select(F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"), "_min", "_max")
    grid = grid.withColumn("bin_start", F.col("_min") + F.col("bin") * (F.col("_max") - F.col("_min")) / bins)
    return grid.join(counts, "bin", "left").select("bin", "bin_start", F.coalesce("n", F.lit(0)).alias("n"))
