"""Label rules over whole tables (D4, D5) and annotation consensus."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonality.functions import labels as L
from tonality.functions.text import normalize_sentiment_text


def label_universal(df: DataFrame, rules: dict[str, str], dataset: str = "dataset") -> DataFrame:
    """One projection that picks the label rule by dataset name.

    ``rules`` maps dataset -> one of ``score`` (from ``score``), ``name`` (from
    ``label_name``), ``pm1`` (+1 / -1 ``label``), ``decisions`` (a map text whose
    values agree), ``output`` (a generated answer), a named remap space of
    ``labels.REMAPS`` (from ``label``) or ``canonical``."""
    expr: Column = F.lit(None).cast("int")
    for ds, rule in rules.items():
        if rule == "score":
            e = L.label_from_score("score")
        elif rule == "name":
            e = L.label_from_name("label_name")
        elif rule == "pm1":
            e = L.label_remap("label", "stock_tweets")
        elif rule == "decisions":
            e = L.label_unanimous_map("decisions")
        elif rule == "output":
            e = L.label_from_name(normalize_sentiment_text("output"))
        else:
            e = L.label_remap("label", rule)
        expr = F.when(F.col(dataset) == ds, e).otherwise(expr)
    return df.withColumn("label", expr.cast("int"))


def label_two_class(df: DataFrame, label: str = "label") -> DataFrame:
    """Drop negatives, then neutral -> 0 and positive -> 1."""
    return df.where(F.col(label) != 0).withColumn(label, L.label_remap(label, "", L.TO_TWO_CLASS))


def _equals(k):
    # a one-argument lambda: PySpark reads a second parameter as the element index
    return lambda x: x == k


def consensus_label(df: DataFrame, labelers=("labeler_1", "labeler_2", "labeler_3", "labeler_4"),
                    names: dict | None = None) -> DataFrame:
    """Majority label of the annotators and its vote count; a tie goes to the
    smallest label; null labels do not vote.  Row-wise array arithmetic: no
    reshaping, no shuffle."""
    names = names or L.ANNOTATION_NAMES
    votes = F.filter(F.array(*[F.try_element_at(L.literal_map(names), F.col(c)) for c in labelers]),
                     lambda x: x.isNotNull())
    counts = [F.size(F.filter(votes, _equals(k))) for k in sorted(set(names.values()))]
    top = F.greatest(*counts)
    ks = sorted(set(names.values()))
    lab = F.lit(None).cast("int")
    for k, c in reversed(list(zip(ks, counts))):
        lab = F.when(c == top, F.lit(k)).otherwise(lab)
    return df.withColumn("consensus_count", top.cast("int")).withColumn(
        "agreement", F.when(top > 0, lab).cast("int"))


def consensus_subset(df: DataFrame, min_votes: int) -> DataFrame:
    """Texts with at least ``min_votes`` agreeing annotators, as (text, label)."""
    return df.where(F.col("consensus_count") >= min_votes).select("sample_id", "text",
                                                                  F.col("agreement").alias("label"))
