"""Registered queries: news and market series (J1-J9) and the url list."""
from __future__ import annotations

from pyspark.sql import functions as F

from tonality.operators import market as M
from tonality.plans.registry import r6, register
from tonality.plans.views_sql import H, with_views
from tonality.sources import files as IO
from tonality.sources import tables as tb

_Q = {"q": "SELECT symbol, quantile_cont(pct_change, 0.66) AS high_cut, quantile_cont(pct_change, 0.33) AS low_cut "
           "FROM series GROUP BY symbol",
      "js": "SELECT s.*, q.high_cut, q.low_cut, CAST(CASE WHEN pct_change > high_cut THEN -1 "
            "WHEN pct_change < low_cut THEN 1 ELSE 0 END AS INTEGER) AS sentiment FROM series s JOIN q USING (symbol)",
      "req": "SELECT symbol, CAST(unnest(generate_series(CAST(lo - 1 AS TIMESTAMP), CAST(hi + 1 AS TIMESTAMP), "
             "INTERVAL 1 DAY)) AS DATE) AS date FROM (SELECT symbol, min(settlement_date) AS lo, "
             "max(settlement_date) AS hi FROM series GROUP BY symbol)"}


def _scored(spark, d):
    return M.quantile_sentiment(tb.series(spark, d))


@register("quantile_sentiment", with_views(f"""
SELECT symbol, settlement_date, {r6('pct_change')} AS pct_change, {r6('high_cut')} AS high_cut,
       {r6('low_cut')} AS low_cut, sentiment FROM js""", "series", extra=_Q))
def q_quantile_sentiment(spark, d):
    """Short-interest change -> -1 / 0 / +1 by the 66th / 33rd percentile per symbol."""
    return _scored(spark, d).select("symbol", "settlement_date", "pct_change", "high_cut", "low_cut", "sentiment")


@register("sentiment_on_date", with_views("""
SELECT r.symbol, r.date, j.sentiment FROM req r LEFT JOIN js j ON r.symbol = j.symbol AND r.date = j.settlement_date""",
                                          "series", extra=_Q))
def q_sentiment_on_date(spark, d):
    """Market sentiment of each requested day (null when the day is absent)."""
    s = tb.series(spark, d)
    return M.sentiment_on_date(M.quantile_sentiment(s), M.requested_dates(s)).select("symbol", "date", "sentiment")


@register("previous_settlement", with_views("""
SELECT r.symbol, r.date, p.previous_date,
       CASE WHEN p.symbol IS NULL THEN 'not found' WHEN p.previous_date IS NULL THEN 'no previous' ELSE 'ok' END AS status
FROM req r LEFT JOIN (SELECT symbol, settlement_date,
                             lag(settlement_date) OVER (PARTITION BY symbol ORDER BY settlement_date) AS previous_date
                      FROM series) p ON r.symbol = p.symbol AND r.date = p.settlement_date""", "series", extra=_Q))
def q_previous_settlement(spark, d):
    """Previous settlement date of each requested day with its status."""
    s = tb.series(spark, d)
    return M.previous_settlement(s, M.requested_dates(s)).select("symbol", "date", "previous_date", "status")


_ARTS = {"arts": """
SELECT ticker, strptime(time_published, '%Y%m%dT%H%M%S') AS ts, url, time_published,
       CAST(strptime(time_published, '%Y%m%dT%H%M%S') AS DATE) AS date
FROM (SELECT url, time_published,
             unnest(list_distinct(list_transform(list_filter(ticker_sentiment,
                    lambda x: try_cast(x.relevance_score AS DOUBLE) > 0.7), lambda x: x.ticker))) AS ticker
      FROM feed)""",
         "win": """
SELECT symbol, settlement_date, CAST(previous_date AS TIMESTAMP) + INTERVAL 12 HOUR AS start_ts,
       CAST(settlement_date AS TIMESTAMP) + INTERVAL 12 HOUR AS end_ts
FROM (SELECT symbol, settlement_date, lag(settlement_date) OVER (PARTITION BY symbol ORDER BY settlement_date)
        AS previous_date FROM series) WHERE previous_date IS NOT NULL""",
         "inwin": """
SELECT * FROM (
  SELECT w.symbol, w.settlement_date, a.url, a.time_published, a.date,
         row_number() OVER (PARTITION BY w.symbol, w.settlement_date ORDER BY a.ts DESC, a.url) AS rank
  FROM arts a JOIN win w ON a.ticker = w.symbol AND a.ts > w.start_ts AND a.ts <= w.end_ts)
WHERE rank <= 30"""}


@register("articles_by_date", with_views("SELECT ticker, date, url FROM arts", "feed", extra=_ARTS))
def q_articles_by_date(spark, d):
    """Relevant articles per ticker and day (long form: one row per url)."""
    return M.articles_by_date(tb.feed(spark, d))


@register("flatten_url_list", with_views("SELECT ticker, date, url FROM arts WHERE ticker IN ('CLICK', 'VIEW')",
                                         "feed", extra=_ARTS))
def q_flatten_url_list(spark, d):
    """The urls of a list of tickers' relevant articles."""
    return IO.flatten_url_list(M.articles_by_date(tb.feed(spark, d)), ["CLICK", "VIEW"])


def _inwin(spark, d):
    return M.articles_in_window(tb.feed(spark, d), tb.series(spark, d), 30)


@register("articles_in_window", with_views("SELECT symbol, settlement_date, url, time_published, date, rank FROM inwin",
                                           "feed", "series", extra=_ARTS))
def q_articles_in_window(spark, d):
    """The latest 30 relevant articles between consecutive settlements (12:00 to 12:00)."""
    return _inwin(spark, d)


_WS = {**_ARTS, "sc": f"SELECT *, CAST({H(chr(39) + 'art:' + chr(39) + ' || url')} % 3 - 1 AS INTEGER) AS score FROM inwin",
       "per": """
SELECT symbol, settlement_date, avg(day_mean) AS score, sum(n) AS n_articles, count(*) AS n_days FROM (
  SELECT symbol, settlement_date, date, avg(score) AS day_mean, count(*) AS n FROM sc GROUP BY ALL) GROUP BY ALL""",
       "ws": """
SELECT w.symbol, w.settlement_date, coalesce(p.n_articles, 0) AS n_articles, coalesce(p.n_days, 0) AS n_days, p.score,
       CAST(CASE WHEN p.score >= 0.5 THEN 1 WHEN p.score >= -0.5 THEN 0 WHEN p.score IS NOT NULL THEN -1 END AS INTEGER)
         AS verdict
FROM win w LEFT JOIN per p USING (symbol, settlement_date)"""}


def _ws(spark, d):
    return M.window_sentiment(tb.score_articles(_inwin(spark, d)), tb.series(spark, d))


@register("window_sentiment", with_views(f"""
SELECT symbol, settlement_date, n_articles, n_days, {r6('score')} AS score, verdict FROM ws""", "feed", "series",
                                         extra=_WS))
def q_window_sentiment(spark, d):
    """Mean of daily mean article scores per window -> -1 / 0 / +1 (null without articles)."""
    return _ws(spark, d)


@register("sentiment_vs_market", with_views("""
SELECT w.symbol, w.settlement_date, w.verdict, j.sentiment AS market_sentiment, w.verdict = j.sentiment AS agree
FROM ws w LEFT JOIN js j USING (symbol, settlement_date)""", "feed", "series", extra={**_WS, **_Q}))
def q_sentiment_vs_market(spark, d):
    """Model verdict per window beside the market sentiment, with agreement."""
    return M.sentiment_vs_market(_ws(spark, d), _scored(spark, d)).select(
        "symbol", "settlement_date", "verdict", "market_sentiment", "agree")


@register("roi_per_trading_day", with_views(f"""
SELECT r.symbol, r.start_date, r.end_date, s.close AS start_close, e.close AS end_close,
       e.i - s.i + 1 AS n_days, {r6('(e.close - s.close) / (e.i - s.i + 1)')} AS roi
FROM (SELECT symbol, date AS start_date, date + 30 AS end_date FROM prices) r
LEFT JOIN ix s ON s.symbol = r.symbol AND s.date = r.start_date
LEFT JOIN ix e ON e.symbol = r.symbol AND e.date = r.end_date""", "prices", extra={
    "ix": "SELECT symbol, date, close, row_number() OVER (PARTITION BY symbol ORDER BY date) - 1 AS i FROM prices"}))
def q_roi_per_trading_day(spark, d):
    """Return per trading day from each day to 30 calendar days later."""
    p = tb.prices(spark, d)
    req = p.select("symbol", F.col("date").alias("start_date"), F.date_add("date", 30).alias("end_date"))
    r = M.roi_per_trading_day(p, req)
    return r.select("symbol", "start_date", "end_date", "start_close", "end_close", "n_days", "roi")


@register("price_projection", with_views("""
SELECT symbol, strftime(date, '%Y-%m-%d') AS date, round(open, 6) AS open, round(close, 6) AS close, volume
FROM prices""", "prices"))
def q_price_projection(spark, d):
    """Daily history as date text, open, close, volume."""
    return M.price_projection(tb.prices(spark, d))
