"""Projections and filters."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonality.functions.text import contains_keyword, matches_pattern, word_count
from tonality.operators.ordering import dense_index


def conform_columns(df: DataFrame, mapping: dict[str, str], drop: list[str] = ()) -> DataFrame:
    """B1: rename to the common names and drop unused columns when present."""
    return df.withColumnsRenamed({k: v for k, v in mapping.items() if k in df.columns}).drop(
        *[c for c in drop if c in df.columns])


def cast_label_int(df: DataFrame, label: str = "label") -> tuple[DataFrame, DataFrame]:
    """B2: label to INT (a CSV round trip gives ``2.0``); rows that do not parse to
    a whole number of INT range go to the second (quarantine) frame."""
    num = F.expr(f"try_cast({label} AS DOUBLE)")
    as_int = F.when(num == F.floor(num), num.try_cast("int"))
    t = df.withColumn("_label_int", as_int)
    good = t.where(F.col("_label_int").isNotNull()).withColumn(label, F.col("_label_int")).drop("_label_int")
    bad = t.where(F.col("_label_int").isNull()).drop("_label_int")
    return good, bad


def drop_unlabeled(df: DataFrame, label: str = "label") -> DataFrame:
    """Drop rows without a label."""
    return df.dropna(subset=[label])


def require_fields(df: DataFrame, cols: list[str]) -> DataFrame:
    """Keep rows where every mandatory field is non-null."""
    return df.dropna(how="any", subset=list(cols))


def filter_equals(df: DataFrame, col: str, value) -> DataFrame:
    """Keep rows where ``col = value`` (pushed to the scan when ``col`` is stored)."""
    return df.where(F.col(col) == F.lit(value))


def filter_word_count_between(df: DataFrame, lo: int, hi: int, source: str | None = None,
                              text: str = "text", source_col: str = "source") -> DataFrame:
    """Source equals ``source`` (when given) and word count within [lo, hi]."""
    cond = word_count(text).between(lo, hi)
    if source is not None:
        cond = (F.col(source_col) == source) & cond
    return df.where(cond)


def filter_keyword(df: DataFrame, word: str, case_sensitive: bool = True, text: str = "text") -> DataFrame:
    """Keep texts containing ``word``."""
    return df.where(contains_keyword(text, word, case_sensitive))


def filter_keyword_pattern(df: DataFrame, pattern: str, text: str = "text") -> DataFrame:
    """Keep texts matching ``pattern`` ignoring case, Unicode word classes."""
    return df.where(matches_pattern(text, pattern))


def drop_class(df: DataFrame, label: int | None = None, label_col: str = "label",
               score_max: float | None = None, score_col: str = "score") -> DataFrame:
    """Remove one class by label, or rows at or below a score cut."""
    if label is not None:
        return df.where(F.col(label_col) != label)
    return df.where(F.col(score_col) > score_max)


def filter_relevant_articles(feed: DataFrame, ticker: str, min_relevance: float = 0.7) -> DataFrame:
    """Articles with any entry for ``ticker`` whose relevance exceeds the cut."""
    return feed.where(F.exists("ticker_sentiment", lambda x: (x["ticker"] == ticker)
                               & (x["relevance_score"].try_cast("double") > min_relevance)))


def with_row_index(df: DataFrame, order_cols: list, out: str = "row_index") -> DataFrame:
    """Dense 0-based row index in a stable order, computed distributed."""
    return dense_index(df, order_cols, out)
