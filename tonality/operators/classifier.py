"""A table-level text classifier in place of GPU fine-tuning.

Spark ML pipeline: regex tokenizer -> hashing term frequencies -> IDF ->
multinomial logistic regression.  Fit on a training table, score an evaluation
table; the raw scores play the role of logits.

Term frequencies of the training rows are written once, so that neither the fit of the
IDF nor that of the regression makes the training table again."""
from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonality.operators.stats import written

#: Partitions of a table that a regression is fitted on, for each core.
FIT_PARTITIONS = 2


def for_fit(df: DataFrame) -> DataFrame:
    """``df`` in a number of partitions that follows the cores, not the size of the table.  Each
    step of a fit sends one gradient (features x classes) for every partition."""
    return df.coalesce(FIT_PARTITIONS * df.sparkSession.sparkContext.defaultParallelism)


def text_classifier(train: DataFrame, test: DataFrame, num_features: int = 1 << 16, max_iter: int = 30,
                    reg: float = 0.01) -> DataFrame:
    """Fit on ``train`` (text, label), score ``test``: adds ``logits`` (raw
    scores, one per class) and ``predicted_label``."""
    frequencies = PipelineModel(stages=[
        RegexTokenizer(inputCol="text", outputCol="_tokens", pattern=r"[^\p{L}\p{N}_']+", toLowercase=True),
        HashingTF(inputCol="_tokens", outputCol="_tf", numFeatures=num_features)])
    fitted = Pipeline(stages=[
        IDF(inputCol="_tf", outputCol="_features"),
        LogisticRegression(featuresCol="_features", labelCol="label", family="multinomial", maxIter=max_iter,
                           regParam=reg, rawPredictionCol="_raw", probabilityCol="_prob",
                           predictionCol="_pred"),
    ])
    rows = frequencies.transform(train.select("text", F.col("label").cast("double").alias("label")))
    model = fitted.fit(for_fit(written(rows.select("label", "_tf"), "term-frequencies")))
    scored = model.transform(frequencies.transform(test))
    return (scored.withColumn("logits", vector_to_array("_raw"))
            .withColumn("predicted_label", F.col("_pred").cast("int"))
            .drop("_tokens", "_tf", "_features", "_raw", "_prob", "_pred"))
