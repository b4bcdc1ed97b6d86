"""News and market series (J1-J9): short-interest sentiment, settlement windows,
article windows and scores, price returns.

The article-to-window match is a range condition; it is planned as an equi-join
on (ticker, day) after each settlement window is expanded into the days it
covers, with the exact 12:00 boundaries as a filter, so no ticker's articles are
compared with all of its windows."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


TS_FORMAT = "yyyyMMdd'T'HHmmss"
#: Join keys over which the articles of a ticker's day are dealt.
DAY_SLOTS = 64


def quantile_sentiment(series: DataFrame, value: str = "pct_change", keys=("symbol",),
                       high: float = 0.66, low: float = 0.33) -> DataFrame:
    """Change above the high percentile -> -1 (short interest up is bearish),
    below the low percentile -> +1, else 0 (strict comparisons)."""
    cuts = series.groupBy(*keys).agg(F.percentile(value, F.lit(high)).alias("high_cut"), F.percentile(value, F.lit(low)).alias("low_cut"))
    j = series.join(cuts, list(keys))
    s = F.when(F.col(value) > F.col("high_cut"), -1).when(F.col(value) < F.col("low_cut"), 1).otherwise(0)
    return j.withColumn("sentiment", s.cast("int"))


def requested_dates(series: DataFrame, pad_days: int = 1) -> DataFrame:
    """Every calendar day of each symbol's range plus ``pad_days`` on each side
    (so some requested days are absent from the series)."""
    r = series.groupBy("symbol").agg(F.min("settlement_date").alias("_lo"), F.max("settlement_date").alias("_hi"))
    return r.select("symbol", F.explode(F.sequence(F.date_sub("_lo", pad_days), F.date_add("_hi", pad_days)))
                    .alias("date"))


def sentiment_on_date(scored: DataFrame, requests: DataFrame) -> DataFrame:
    """The market sentiment of each requested (symbol, date); null if absent."""
    s = scored.select("symbol", F.col("settlement_date").alias("date"), "sentiment")
    return requests.join(s, ["symbol", "date"], "left")


def with_previous_settlement(series: DataFrame) -> DataFrame:
    """Previous settlement date per symbol (window over the per-day series)."""
    w = Window.partitionBy("symbol").orderBy("settlement_date")
    return series.withColumn("previous_date", F.lag("settlement_date").over(w))


def previous_settlement(series: DataFrame, requests: DataFrame) -> DataFrame:
    """Previous settlement of each requested date, with a status of
    ``not found`` / ``no previous`` / ``ok``."""
    p = with_previous_settlement(series).select("symbol", F.col("settlement_date").alias("date"), "previous_date",
                                                F.lit(True).alias("_found"))
    j = requests.join(p, ["symbol", "date"], "left")
    status = (F.when(F.col("_found").isNull(), "not found").when(F.col("previous_date").isNull(), "no previous")
              .otherwise("ok"))
    return j.withColumn("status", status).drop("_found")


def relevant_articles(feed: DataFrame, min_relevance: float = 0.7) -> DataFrame:
    """(ticker, date, ts, url): one row per article and each ticker it is
    relevant to (relevance above the cut)."""
    tickers = F.array_distinct(F.transform(
        F.filter("ticker_sentiment", lambda x: x["relevance_score"].try_cast("double") > min_relevance),
        lambda x: x["ticker"]))
    ts = F.to_timestamp(F.col("time_published"), TS_FORMAT)
    return feed.select(F.explode(tickers).alias("ticker"), ts.alias("ts"), "url", "time_published").withColumn(
        "date", F.to_date("ts"))


def articles_by_date(feed: DataFrame, ticker: str | None = None) -> DataFrame:
    """(ticker, date, url) of relevant articles (all tickers when None)."""
    a = relevant_articles(feed)
    if ticker is not None:
        a = a.where(F.col("ticker") == ticker)
    return a.select("ticker", "date", "url")


def settlement_windows(series: DataFrame, hour: int = 12) -> DataFrame:
    """(symbol, settlement_date, start_ts, end_ts): from the previous settlement
    at ``hour``:00 (exclusive) to this one at ``hour``:00 (inclusive)."""
    p = with_previous_settlement(series).where(F.col("previous_date").isNotNull())
    at = lambda c: F.to_timestamp(F.concat(F.col(c).cast("string"), F.lit(f" {hour:02d}:00:00")))
    return p.select("symbol", "settlement_date", at("previous_date").alias("start_ts"),
                    at("settlement_date").alias("end_ts"))


def articles_in_window(feed: DataFrame, series: DataFrame, k: int = 30) -> DataFrame:
    """The latest ``k`` relevant articles of each settlement window.

    A day's articles of a ticker are dealt over ``DAY_SLOTS`` join keys by their url, and the
    day's windows (two at most) stand in each, so a day that holds most of the feed is not one
    task; the top k is limited in each task before the articles of a window meet."""
    win = settlement_windows(series)
    days = win.select("*", F.explode(F.sequence(F.to_date("start_ts"), F.to_date("end_ts"))).alias("day"))
    days = days.select("*", F.explode(F.sequence(F.lit(0), F.lit(DAY_SLOTS - 1))).alias("day_slot"))
    arts = relevant_articles(feed).withColumn("slot", F.pmod(F.xxhash64("url"), F.lit(DAY_SLOTS)))
    j = arts.join(days, (arts["ticker"] == days["symbol"]) & (arts["date"] == days["day"]) & (arts["slot"] == days["day_slot"]))
    j = j.where((F.col("ts") > F.col("start_ts")) & (F.col("ts") <= F.col("end_ts")))
    w = Window.partitionBy("symbol", "settlement_date").orderBy(F.desc("ts"), F.asc("url"))
    return j.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(
        "symbol", "settlement_date", "url", "time_published", "date", "rank")


def window_sentiment(scored: DataFrame, series: DataFrame) -> DataFrame:
    """Mean score per day, then the mean of the daily means per window;
    >= 0.5 -> 1, >= -0.5 -> 0, else -1; a window without articles -> null."""
    daily = scored.groupBy("symbol", "settlement_date", "date").agg(F.avg("score").alias("day_mean"),
                                                                    F.count(F.lit(1)).alias("n"))
    per = daily.groupBy("symbol", "settlement_date").agg(F.avg("day_mean").alias("score"),
                                                         F.sum("n").alias("n_articles"),
                                                         F.count(F.lit(1)).alias("n_days"))
    win = settlement_windows(series).select("symbol", "settlement_date")
    j = win.join(per, ["symbol", "settlement_date"], "left")
    verdict = F.when(F.col("score") >= 0.5, 1).when(F.col("score") >= -0.5, 0).when(F.col("score").isNotNull(), -1)
    return j.select("symbol", "settlement_date", F.coalesce("n_articles", F.lit(0)).alias("n_articles"),
                    F.coalesce("n_days", F.lit(0)).alias("n_days"), "score", verdict.cast("int").alias("verdict"))


def sentiment_vs_market(model: DataFrame, market: DataFrame) -> DataFrame:
    """Model verdict beside the market sentiment with an agreement flag."""
    m = market.select("symbol", "settlement_date", F.col("sentiment").alias("market_sentiment"))
    j = model.join(m, ["symbol", "settlement_date"], "left")
    return j.withColumn("agree", F.col("verdict") == F.col("market_sentiment"))


def roi_per_trading_day(prices: DataFrame, requests: DataFrame) -> DataFrame:
    """(end close - start close) / trading days inclusive, days counted on the
    symbol's own trading calendar; an absent date gives null (trap T11)."""
    # daily rows: one per symbol and day, as in J3
    idx = prices.select("symbol", "date", "close", F.row_number().over(Window.partitionBy("symbol").orderBy("date")).alias("day_idx"))
    s = idx.select("symbol", F.col("date").alias("start_date"), F.col("close").alias("start_close"),
                   F.col("day_idx").alias("_i0"))
    e = idx.select("symbol", F.col("date").alias("end_date"), F.col("close").alias("end_close"),
                   F.col("day_idx").alias("_i1"))
    j = requests.join(s, ["symbol", "start_date"], "left").join(e, ["symbol", "end_date"], "left")
    n = F.col("_i1") - F.col("_i0") + 1
    return j.withColumn("n_days", n).withColumn(
        "roi", F.try_divide(F.col("end_close") - F.col("start_close"), F.col("n_days"))).drop("_i0", "_i1")


def price_projection(prices: DataFrame) -> DataFrame:
    """Date string, open, close, volume."""
    return prices.select("symbol", F.date_format("date", "yyyy-MM-dd").alias("date"), "open", "close", "volume")
