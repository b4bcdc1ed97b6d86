"""F13 + F14 + H30: a grid search that fits.

Every row of a parameter grid is fitted on the train part of a 60 / 20 / 20 split and scored on
the valid part; the most accurate row wins, the first in grid order on ties (a later one must be
strictly better), and only the winner is scored on the test part.  All runs are evaluated in one
aggregate keyed by ``grid_idx``.  Each fit is a distributed job; the split and the features of
each feature setting are written once and reused, so a fit reads vectors, not texts."""
from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonality.operators.assemble import best_run, param_grid, three_way_split
from tonality.operators.classifier import for_fit
from tonality.operators.evaluate import overall_metrics
from tonality.operators.stats import written

FEATURE_PARAMS = {"num_features": 1 << 16, "min_doc_freq": 0}
FIT_PARAMS = {"reg": 0.01, "elastic_net": 0.0, "max_iter": 30}


@dataclass
class Selection:
    """``runs``: one row per grid row with its parameters and valid metrics; ``best``: the winning
    row; ``scored``: the test rows with the winner's ``predicted_label``; ``test``: its metrics."""
    runs: DataFrame
    best: dict
    scored: DataFrame
    test: DataFrame


def _features(row: dict) -> Pipeline:
    return Pipeline(stages=[
        RegexTokenizer(inputCol="text", outputCol="_tokens", pattern=r"[^\p{L}\p{N}_']+", toLowercase=True),
        HashingTF(inputCol="_tokens", outputCol="_tf", numFeatures=int(row["num_features"])),
        IDF(inputCol="_tf", outputCol="_features", minDocFreq=int(row["min_doc_freq"]))])


def _scored(model, rows: DataFrame, grid_idx: int, keep: tuple = ()) -> DataFrame:
    return model.transform(rows).select(F.lit(grid_idx).alias("grid_idx"), *keep, F.col("label").cast("int").alias("true_label"),
                                        F.col("_pred").cast("int").alias("predicted_label"))


def select_model(df: DataFrame, grid: dict[str, list], seed: int = 1694, id_col: str = "sample_id") -> Selection:
    """Search ``grid`` (parameter -> values, see ``FEATURE_PARAMS`` and ``FIT_PARAMS``) over
    ``df(id_col, text, label)``; rows without a label take no part, a null text counts as empty."""
    spark = df.sparkSession
    unknown = set(grid) - set(FEATURE_PARAMS) - set(FIT_PARAMS)
    if unknown:
        raise ValueError(f"unknown parameters: {sorted(unknown)}")
    rows = df.where(F.col("label").isNotNull()).select(id_col, F.coalesce("text", F.lit("")).alias("text"), F.col("label").cast("double").alias("label"))
    split = written(three_way_split(rows, seed, id_col), "model-split")
    part = lambda name: split.where(F.col("split") == name).drop("split")
    table = param_grid(grid, spark)
    settings = [FEATURE_PARAMS | FIT_PARAMS | r.asDict() for r in table.orderBy("grid_idx").collect()]
    prepared: dict[tuple, tuple] = {}
    models, scored = {}, []
    for s in settings:
        key = tuple(s[p] for p in FEATURE_PARAMS)
        if key not in prepared:
            make = _features(s).fit(part("train"))
            vectors = {n: written(make.transform(part(n)).select(id_col, "label", "_features"), f"features-{n}") for n in ("train", "valid")}
            prepared[key] = make, vectors
        vectors = prepared[key][1]
        fit = LogisticRegression(featuresCol="_features", labelCol="label", family="multinomial", maxIter=int(s["max_iter"]),
                                 regParam=float(s["reg"]), elasticNetParam=float(s["elastic_net"]), predictionCol="_pred")
        models[s["grid_idx"]] = fit.fit(for_fit(vectors["train"]))
        scored.append(_scored(models[s["grid_idx"]], vectors["valid"], s["grid_idx"]))
    metrics = overall_metrics(reduce(DataFrame.unionByName, scored), ["grid_idx"])
    runs = written(table.join(metrics, "grid_idx"), "grid-runs")
    won = best_run(runs, "accuracy").first()
    if won is None:
        raise ValueError("no rows to validate on")
    best = next(s for s in settings if s["grid_idx"] == won["grid_idx"])
    make = prepared[tuple(best[p] for p in FEATURE_PARAMS)][0]
    test = written(_scored(models[best["grid_idx"]], make.transform(part("test")), best["grid_idx"], (id_col,)), "test-scored")
    return Selection(runs, best | {"accuracy": won["accuracy"]}, test, overall_metrics(test, ["grid_idx"]))
