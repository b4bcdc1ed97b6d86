"""Learned sentence boundaries, and articles of one hot day dealt over many tasks."""
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_DIR
from tests.oracle_compare import compare, duck
from tonality.operators import market as M
from tonality.operators import sentence_model as SM
from tonality.plans import load_all

FRAGMENTS = ["Dr. X met Prof. Ito at noon, e.g. in May. Then it rose.", "In May it rose. Then Mr. Chan met Dr. Lee at noon. Then they left.",
             "They left at noon in May, e.g. Lee and Ito. Then Chan rose on it.", "It left. Then X left! Is it May? Then it is. And K. Lee rose."]


@pytest.fixture(scope="module")
def model(spark):
    df = spark.createDataFrame([(i, FRAGMENTS[i % 4]) for i in range(200)], "id long, text string")
    ab = SM.written(SM.learn_abbreviations(df), "ab")
    return df, ab, SM.written(SM.learn_starters(df, ab), "st")


def test_abbreviations_and_starters_are_learned(model):
    _, ab, st = model
    types = {r.type for r in ab.collect()}
    assert {"dr", "prof", "mr", "e.g"} <= types and not types & {"rose", "left", "may", "noon", "ito", "lee"}
    assert "then" in {r.type for r in st.collect()}


def test_abbreviations_do_not_end_sentences(spark, model):
    _, ab, st = model
    rows = [(0, FRAGMENTS[0]), (1, FRAGMENTS[3]), (2, ""), (3, None), (4, "  no end  at\nall "), (5, 'He said "it rose." Then 3. It is e.g. Then more.')]
    df = spark.createDataFrame(rows, "id long, text string")
    got = {r.id: r.s for r in df.select("id", SM.sentences("text", ab, st).alias("s")).collect()}
    assert got[0] == ["Dr. X met Prof. Ito at noon, e.g. in May.", "Then it rose."]
    assert got[1] == ["It left.", "Then X left!", "Is it May?", "Then it is.", "And K. Lee rose."]
    assert got[2] == [] and not got[3] and got[4] == ["no end at all"]
    assert got[5] == ['He said "it rose."', "Then 3.", "It is e.g.", "Then more."]


@pytest.mark.parametrize("name", ["sentence_boundary_types", "split_sentences_learned"])
def test_learned_queries_match_sql(spark, name):
    q = load_all()[name]
    r = compare(spark, duck(SF_DIR), name, q.build, q.sql, SF_DIR)
    assert r["status"] == "match" and r["spark_rows"] > 0, r


def test_articles_of_a_hot_day_are_dealt_over_many_keys(spark):
    series = spark.createDataFrame([("AAA", d) for d in ("2024-01-01", "2024-01-05", "2024-01-09")], "symbol string, d string").select(
        "symbol", F.to_date("d").alias("settlement_date"))
    feed = spark.range(4000).select(
        F.concat(F.lit("u"), F.col("id")).alias("url"),
        F.when(F.col("id") % 10 < 9, F.lit("20240103T")).otherwise(F.lit("20240107T")).alias("_day"), "id").select(
        "url", F.concat("_day", F.lpad(F.col("id") % 24, 2, "0"), F.lit("0000")).alias("time_published"),
        F.array(F.struct(F.lit("AAA").alias("ticker"), F.lit("0.9").alias("relevance_score"))).alias("ticker_sentiment"))
    old = {k: spark.conf.get(k, None) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = M.articles_in_window(feed, series, 7)
        assert out.groupBy("settlement_date").count().count() == 2 and out.count() == 14
        assert "slot" in out._jdf.queryExecution().executedPlan().toString()
        dealt = M.relevant_articles(feed).withColumn("slot", F.pmod(F.xxhash64("url"), F.lit(M.DAY_SLOTS)))
        sizes = [r["count"] for r in dealt.repartition(8, "ticker", "date", "slot").groupBy(F.spark_partition_id()).count().collect()]
        assert len(sizes) == 8 and max(sizes) < 4000 * 0.3
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
