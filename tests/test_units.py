"""Operator semantics on small hand-made frames (traps T1-T21 of the survey)."""
from pyspark.sql import Row
from pyspark.sql import functions as F

from tonality.functions import labels as L
from tonality.functions import text as X
from tonality.operators import assemble as A
from tonality.operators import augment as G
from tonality.operators import evaluate as ev
from tonality.operators import labeling as LB
from tonality.operators import market as M
from tonality.operators.ordering import dense_index


def col(df, c):
    return [r[c] for r in df.collect()]


def test_word_count_python_split_semantics(spark):
    df = spark.createDataFrame([("a  b c\x1cd\ne",), ("",), ("one",), (None,)], "t string")
    assert col(df.select(X.word_count("t").alias("n")), "n") == [5, 0, 1, None]


def test_text_cleaning(spark):
    df = spark.createDataFrame([("see https://x.co/a and http://y.co/b &#39;ok&#39; @User users",)], "t string")
    r = df.select(X.strip_urls("t").alias("a"), X.remove_whole_word("t", "user").alias("b"),
                  X.unescape_apostrophe("t").alias("c"), X.keep_basic_chars(F.lit("é a-b ok!")).alias("d"),
                  X.keep_printable_ascii(F.lit("aéèb")).alias("e")).first()
    assert "https" not in r.a and "http://y.co/b" in r.a
    assert "@ users" in r.b and "User" not in r.b
    assert "'ok'" in r.c
    assert r.d == " a-b ok!"
    assert r.e == "ab"


def test_answers_and_families(spark):
    df = spark.createDataFrame([("x Answer: no Answer:  Positive ",), ("no marker",)], "g string")
    r = df.select(X.extract_answer("g").alias("a"), L.label_from_generated("g").alias("l"),
                  X.normalize_sentiment_text(F.lit("positive and negative")).alias("n")).collect()
    assert [x.a for x in r] == ["positive", "Error"] and [x.l for x in r] == [2, 1] and r[0].n == "positive"
    m = spark.createDataFrame([("mrm8488/distilroberta-x",), ("distilbert-y",), ("ProsusAI/finbert",)], "m string")
    assert col(m.select(X.model_family("m").alias("f")), "f") == ["distilRoberta", "distilBert", "finBert"]
    bad = spark.createDataFrame([("gpt",)], "m string").select(X.model_family("m"))
    try:
        bad.collect()
        raise AssertionError("unknown model must fail")
    except Exception as e:  # noqa: BLE001
        assert "does not match" in str(e)


def test_score_bounds_inclusive(spark):
    df = spark.createDataFrame([(-0.4,), (-0.39,), (0.5,), (0.51,), (None,)], "s double")
    assert col(df.select(L.label_from_score("s").alias("l")), "l") == [0, 1, 1, 2, None]


def test_unanimous_map(spark):
    df = spark.createDataFrame([("{'A': 'neutral', 'B': 'Neutral'}",), ("{'A': 'neutral', 'B': 'positive'}",),
                                ("{}",), ("{'A': ",), ("{'A': 'bullish'}",)], "d string")
    assert col(df.select(L.label_unanimous_map("d").alias("l")), "l") == [1, None, None, None, None]


def test_consensus_ties_and_nulls(spark):
    rows = [(1, "POSITIVE", "POSITIVE", "POSITIVE", "POSITIVE"), (2, "NEGATIVE", "NEGATIVE", "NEGATIVE", "NEUTRAL"),
            (3, "POSITIVE", "POSITIVE", "NEGATIVE", "NEGATIVE"), (4, "NEUTRAL", "NEUTRAL", "NEGATIVE", "POSITIVE"),
            (5, "NEUTRAL", "NEUTRAL", "NEUTRAL", None)]
    df = spark.createDataFrame(rows, "sample_id int, labeler_1 string, labeler_2 string, labeler_3 string, labeler_4 string")
    r = {x.sample_id: (x.agreement, x.consensus_count) for x in LB.consensus_label(df).collect()}
    assert r == {1: (2, 4), 2: (0, 3), 3: (0, 2), 4: (1, 2), 5: (1, 3)}


def _preds(spark, rows):
    return spark.createDataFrame(rows, "model string, model_type string, dataset string, sample_id long, "
                                       "text string, true_label int, logits array<double>, predicted_label int")


def test_argmax_first_wins_and_macro_over_seen_labels(spark):
    p = _preds(spark, [("m", "t", "d", 1, "a", 0, [0.5, 0.5, 0.1], 0), ("m", "t", "d", 2, "b", 0, [0.1, 0.2, 0.3], 2),
                       ("m", "t", "d", 3, "c", 2, [0.1, 0.2, 0.3], 2)])
    assert col(ev.argmax_label(p), "raw_label") == [0, 2, 2]
    m = ev.overall_metrics(p).first()
    # labels 0 and 2 seen; class 1 neither true nor predicted -> not averaged
    assert abs(m.accuracy - 2 / 3) < 1e-12
    assert abs(m.precision - (1.0 + 0.5) / 2) < 1e-12
    assert abs(m.recall - (0.5 + 1.0) / 2) < 1e-12
    cm = ev.confusion_matrix(p).collect()
    assert len(cm) == 9 and sum(r.n for r in cm) == 3
    rep = {r.label: r for r in ev.class_report(p).collect()}
    assert abs(rep["weighted avg"].recall - m.accuracy) < 1e-12 and rep["neutral"].support == 0


def test_remap_by_family(spark):
    df = spark.createDataFrame([(0, "finBert"), (1, "finBert"), (2, "finBert"), (0, "distilBert"), (1, "Electra")],
                               "raw int, fam string")
    assert col(df.select(L.remap_prediction("raw", "fam").alias("c")), "c") == [2, 0, 1, 1, 1]


def test_negation_rule(spark):
    texts = ["this is not good", "I do n't like it", "we do not", "not not good", "not xyz here", "don't rise"]
    df = spark.createDataFrame(list(enumerate(texts)), "sample_id long, text string")
    ants = {"good": "bad", "like": "dislike", "rise": "fall"}
    out = [r.text for r in G.negation_antonym(df, ants).orderBy("sample_id").collect()]
    assert out == ["this is bad", "I do dislike it", "we do not", "not good", "xyz here", "do fall"]
    table = spark.createDataFrame(list(ants.items()), "word string, antonym string")
    table = table.unionByName(spark.createDataFrame([("Good", "zzz"), ("GOOD", "worse")], "word string, antonym string"))
    joined = [r.text for r in G.negation_antonym(df, table).orderBy("sample_id").collect()]
    assert joined == out


def test_random_deletion_keeps_rows_and_one_word(spark):
    df = spark.createDataFrame([(1, "one"), (2, "two words here"), (3, "")], "sample_id long, text string")
    out = {r.sample_id: r.text for r in G.random_deletion_text(df, 3).collect()}
    assert out[1] == "one" and len(out[2].split()) == 2 and out[3] == ""
    s = {r.sample_id: r.text for r in G.random_deletion_sentence(df, 3).collect()}
    assert s[1] == "one" and len(s[2].split()) == 2


def test_splits_exact_disjoint_and_partition_independent(spark):
    df = spark.range(0, 1001).select(F.col("id").alias("sample_id"), (F.col("id") % 3).cast("int").alias("label"))
    a = {r.sample_id: r.split for r in A.random_split(df.repartition(8), 0.3, 5).collect()}
    b = {r.sample_id: r.split for r in A.random_split(df.coalesce(1), 0.3, 5).collect()}
    assert a == b and len(a) == 1001
    assert sum(v == "test" for v in a.values()) == 301  # ceil(0.3 * 1001)
    three = A.three_way_split(df, 1).groupBy("split").count().collect()
    assert {r.split: r["count"] for r in three} == {"test": 201, "valid": 200, "train": 600}
    st = A.stratified_split(df, "label", 0.4, 2).groupBy("label", "split").count().collect()
    assert {(r.label, r.split): r["count"] for r in st}[(0, "test")] == 134  # ceil(0.4 * 334)


def test_quota_skip_and_dense_index(spark):
    df = spark.range(0, 100).select(F.col("id").alias("sample_id"), (F.col("id") % 2).cast("int").alias("label"))
    q = A.class_quota(df, {0: 5, 1: 7}).groupBy("label").count().collect()
    assert {r.label: r["count"] for r in q} == {0: 5, 1: 7}
    s = A.class_skip(df, 1, 10)
    assert s.count() == 90 and s.where("label = 1").agg(F.min("sample_id")).first()[0] == 21
    ix = dense_index(df.repartition(7), ["label", "sample_id"], "i", ["label"]).collect()
    assert sorted((r.label, r.i) for r in ix) == sorted((lab, i) for lab in (0, 1) for i in range(50))
    for r in ix:
        assert r.i == r.sample_id // 2


def test_dedup_keeps_first(spark):
    df = spark.createDataFrame([(3, "a", "x"), (1, "a", "y"), (2, "b", "z")], "sample_id long, text string, lang string")
    assert sorted((r.sample_id, r.lang) for r in A.dedup_text(df).collect()) == [(1, "y"), (2, "z")]


def test_attention_single_target_std_null(spark):
    att = spark.createDataFrame([(1, 0, 0, 0, 1.0, True), (1, 0, 0, 1, 3.0, False), (1, 1, 0, 0, 1.0, False)],
                                "sample_id long, layer int, query_pos int, key_pos int, weight double, is_target boolean")
    r = {x.layer: x for x in ev.layer_attention_stats(att).collect()}
    assert r[0].n_targets == 1 and abs(r[0].mean_ratio - 0.25) < 1e-12 and r[0].std_ratio is None
    assert r[1].n_targets == 0 and r[1].mean_ratio == 0.0 and r[1].threshold == 0.0


def test_quantile_sentiment_strict_cuts(spark):
    vals = [1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0]
    s = spark.createDataFrame([("S", i, v) for i, v in enumerate(vals)], "symbol string, settlement_date int, pct_change double")
    r = {x.pct_change: x.sentiment for x in M.quantile_sentiment(s).collect()}
    # 66th pct = 4.96, 33rd = 2.98 (linear): strict comparisons
    assert r[5.0] == -1 and r[4.0] == 0 and r[3.0] == 0 and r[2.0] == 1


def test_window_boundaries(spark):
    import datetime as dt
    series = spark.createDataFrame([("CLICK", dt.date(2024, 1, 1)), ("CLICK", dt.date(2024, 1, 3))],
                                   "symbol string, settlement_date date")
    feed = spark.createDataFrame([
        Row(url="u1", time_published="20240101T120000", ticker_sentiment=[Row(ticker="CLICK", relevance_score="0.9")]),
        Row(url="u2", time_published="20240103T120000", ticker_sentiment=[Row(ticker="CLICK", relevance_score="0.9")]),
        Row(url="u3", time_published="20240102T080000", ticker_sentiment=[Row(ticker="CLICK", relevance_score="0.7")]),
        Row(url="u4", time_published="20240102T080000", ticker_sentiment=[Row(ticker="VIEW", relevance_score="0.9")]),
    ])
    got = sorted(r.url for r in M.articles_in_window(feed, series).collect())
    assert got == ["u2"]  # start exclusive, end inclusive, relevance strictly above 0.7, ticker must match


def test_band_percentiles_exact_like_numpy(spark):
    import numpy as np

    from tonality.operators.stats import group_percentiles
    rng = np.random.default_rng(1)
    rows = []
    for g, n in [("a", 5), ("b", 1), ("c", 20000), ("d", 2)]:
        rows += [(g, float(v)) for v in rng.normal(size=n).round(3)]  # ties included
    df = spark.createDataFrame(rows, "g string, v double").repartition(7)
    got = {r.g: (r.p25, r.p75) for r in group_percentiles(df, ["g"], "v", {"p25": 0.25, "p75": 0.75},
                                                          accuracy=1000).collect()}
    for g in "abcd":
        vs = [v for k, v in rows if k == g]
        want = (np.percentile(vs, 25), np.percentile(vs, 75))
        assert all(abs(a - b) < 1e-12 for a, b in zip(got[g], want)), (g, got[g], want)


def test_augmentation_independent_of_partitioning(spark):
    df = spark.createDataFrame([(i, f"w{i} alpha beta. gamma delta eps! z{i} y x") for i in range(200)],
                               "sample_id long, text string")
    one = {r.sample_id: r.text for r in G.random_deletion_sentence(df.coalesce(1), 9).collect()}
    many = {r.sample_id: r.text for r in G.random_deletion_sentence(df.repartition(8), 9).collect()}
    assert one == many
    m1 = {r.sample_id: r.masked for r in G.keyword_mask(df.coalesce(1), ["alpha"], 0.35, 4).collect()}
    m8 = {r.sample_id: r.masked for r in G.keyword_mask(df.repartition(8), ["alpha"], 0.35, 4).collect()}
    assert m1 == m8 and 0 < sum(m1.values()) < 200


def test_error_rate_modes(spark):
    rows = [("m", "t", "d", i, " ".join(["w"] * n), 0, [0.1, 0.2, 0.3], 2 if i % 2 else 0)
            for i, n in enumerate([10, 20, 30, 40, 50, 60, 62, 65, 70, 80])]
    p = _preds(spark, rows)
    same = {r.band: r for r in ev.length_error_rate(p).collect()}
    as_is = {r.band: r for r in ev.length_error_rate(p, mode="as_is").collect()}
    assert all(r.error_rate <= 100 for r in same.values())
    assert as_is["short"].n_rows == 6 and as_is["medium"].n_rows == 2 and as_is["long"].n_rows == 2


def test_label_beyond_int_goes_to_quarantine(spark):
    from tonality.operators import filters as B
    df = spark.createDataFrame([("2.0",), ("1e12",), ("-3000000000",), ("NaN",), ("abc",), (None,), ("1.5",)], "label string")
    good, bad = B.cast_label_int(df)
    assert col(good, "label") == [2] and bad.count() == 6


def test_scratch_folder_is_asked_for_off_local_mode():
    import pytest

    from tonality.session import ensure_checkpoint_dir

    class Conf(dict):
        def set(self, k, v):
            self[k] = v

    class Session:
        conf = Conf({"spark.master": "spark://host:7077"})
    with pytest.raises(RuntimeError):
        ensure_checkpoint_dir(Session())


def test_path_keys(spark):
    from tonality.sources.files import path_key
    df = spark.createDataFrame([("file:/a/artifact=x/model=m%2Fn/dataset=d/part-0.parquet",)], "path string")
    assert df.select(path_key("path", 3), path_key("path", 2), path_key("path", 1)).first()[:] == ("x", "m/n", "d")


def test_treebank_words(spark):
    from tonality.functions.text import treebank_tokens
    cases = {"He didn't say \"it'll rise\".": "He did n't say `` it 'll rise '' .",
             "The firm's $5.50 gain (5%) -- wow... ok": "The firm 's $ 5.50 gain ( 5 % ) -- wow ... ok",
             "3,000: yes, we've; they cannot": "3,000 : yes , we 've ; they can not",
             "'Tis gonna be": "'T is gon na be", "Mr. X left. He won.": "Mr. X left. He won .", "": ""}
    df = spark.createDataFrame(list(cases.items()), "text string, want string")
    for r in df.select("want", F.array_join(treebank_tokens("text"), " ").alias("got")).collect():
        assert r.got == r.want


def test_scratch_of_an_application_is_one_folder_that_can_be_cleared():
    """In a process of its own: clearing would take the intermediate results of other tests."""
    import subprocess
    import sys
    code = """
import os
from tonality.session import clear_scratch, get_session, scratch_root
from tonality.operators.stats import written
spark = get_session('local[1]', shuffle_partitions=1)
assert not clear_scratch(spark)
written(spark.range(3), 'a'), written(spark.range(3), 'b')
assert len(os.listdir(scratch_root(spark))) == 2 and clear_scratch(spark) and not os.path.exists(scratch_root(spark))
assert written(spark.range(3), 'c').count() == 3
"""
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300,
                          cwd=__file__.rsplit("/tests/", 1)[0])
    assert done.returncode == 0, done.stderr[-2000:]
