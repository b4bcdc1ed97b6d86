"""Views on the driver tables (documents, labels, embeddings, events, orders, ...).

The reference's inputs (labelled corpora, annotation sheets, prediction stores,
news feeds, short-interest and price series) are derived here from the driver
tables with Spark expressions, so every query's work grows with the tables.
``tonality.plans.views_sql`` holds the same definitions in SQL for the oracle.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tonality.functions.hashing import hash32
from tonality.functions.labels import argmax, remap_prediction
from tonality.functions.text import model_family, word_count

# The evaluation run grid (model x model type) and dataset names.
MODELS = [
    "ProsusAI/finbert",
    "distilbert-base-uncased-finetuned-sst-2-english",
    "mrm8488/distilroberta-finetuned-financial-news-sentiment-analysis",
    "google/electra-base-discriminator",
]
MODEL_TYPES = ["no_ft", "ft", "ft_pt"]
EVAL_DATASETS = ["eval_75_consent", "eval_all_agree"]
# a dataset in the run grid that has no predictions (reports list it as zeros / skipped)
GRID_DATASETS = ["eval_75_consent", "eval_all_agree", "test_all_agree"]
ANNOTATION_LABELS = ["NEGATIVE", "NEUTRAL", "POSITIVE"]
# fragments appended to texts so that cleaning operators have something to act on
PROBE_FRAGMENTS = [
    " Read more at https://news.example/a?id=1 today.",
    " @User wrote &#39;fine&#39; to users.",
    " Old link http://keep.example/b stays.",
    " They do not like it, prices don't rise.",
    " Ünïcödé – “quotes” ok",
    "",
]


# Antonyms for the negation augmentation (both directions).
ANTONYMS = {"good": "bad", "bad": "good", "like": "dislike", "dislike": "like", "rise": "fall", "fall": "rise",
            "up": "down", "down": "up", "high": "low", "low": "high", "gain": "loss", "loss": "gain",
            "strong": "weak", "weak": "strong", "increase": "decrease", "decrease": "increase",
            "buy": "sell", "sell": "buy", "positive": "negative", "negative": "positive"}


def run_grid() -> list[tuple[int, str, str]]:
    return [(3 * m + t, model, mtype) for m, model in enumerate(MODELS) for t, mtype in enumerate(MODEL_TYPES)]


_TABLES: dict = {}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table; the handle is reused within a session (the tables are
    read-only), so file listing and footer reads happen once."""
    try:
        app = spark.sparkContext.applicationId
    except Exception:  # noqa: BLE001 - Spark Connect
        app = spark.conf.get("spark.app.id", "connect")
    key = (app, id(spark), sf_dir, name)
    if key not in _TABLES:
        _TABLES[key] = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return _TABLES[key]


def eval_dataset_of(sample_id: Column) -> Column:
    return F.when(hash32("ds", sample_id) % 4 == 0, "eval_all_agree").otherwise("eval_75_consent")


def labeled_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sample_id, dataset, type, text, score, label): documents with their labels."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    labels = read(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    return docs.join(labels, "doc_id").select(
        F.col("doc_id").alias("sample_id"),
        F.col("source").alias("dataset"),
        F.when(F.col("lang") == "en", "headline").otherwise("article").alias("type"),
        "text",
        ((hash32("score", F.col("doc_id")) - 2147483648) / F.lit(2147483648.0)).alias("score"),
        F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 1, 2).otherwise(1).cast("int").alias("label"),
    )


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sample_id, dataset, text): every document."""
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("sample_id"), F.col("source").alias("dataset"), "text")


def probe_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sample_id, text): every document with a cleaning fragment appended."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    frag = F.element_at(F.array(*[F.lit(f) for f in PROBE_FRAGMENTS]),
                        (F.col("doc_id") % len(PROBE_FRAGMENTS) + 1).cast("int"))
    return docs.select(F.col("doc_id").alias("sample_id"), F.concat(F.col("text"), frag).alias("text"))


def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sample_id, text, labeler_1..labeler_4): four annotators per document."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    names = F.array(*[F.lit(n) for n in ANNOTATION_LABELS])
    base = hash32("ann", F.col("doc_id")) % 3
    cols = []
    for k in range(1, 5):
        v = hash32("ann", k, F.col("doc_id"))
        idx = F.when(v % 10 < 6, base).otherwise(v % 3)
        lab = F.element_at(names, (idx + 1).cast("int"))
        if k == 4:
            lab = F.when(hash32("ann", "null", F.col("doc_id")) % 25 != 0, lab)
        cols.append(lab.alias(f"labeler_{k}"))
    return docs.select(F.col("doc_id").alias("sample_id"), "text", *cols)


def eval_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(dataset, sample_id, text, label): the evaluation sets the runs were scored on."""
    emb = read(spark, sf_dir, "embeddings").select("vec_id", "label")
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return emb.join(docs, emb.vec_id == docs.doc_id).select(
        eval_dataset_of(F.col("vec_id")).alias("dataset"),
        F.col("vec_id").alias("sample_id"), "text", (F.col("label") % 3).cast("int").alias("label"))


def raw_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(model, model_type, dataset, sample_id, logits): what a prediction store holds.

    One row per sample and run; the run grid is a literal array exploded per row
    (a projection, no join)."""
    emb = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    # a model scores the evaluation samples, so the store holds exactly those
    docs = read(spark, sf_dir, "documents").select("doc_id")
    emb = emb.join(docs, emb.vec_id == docs.doc_id, "left_semi")
    runs = F.array(*[F.struct(F.lit(i).alias("run_idx"), F.lit(m).alias("model"), F.lit(t).alias("model_type"))
                     for i, m, t in run_grid()])
    exploded = emb.select("vec_id", "embedding", F.explode(runs).alias("run"))
    return exploded.select(
        F.col("run.model").alias("model"), F.col("run.model_type").alias("model_type"),
        eval_dataset_of(F.col("vec_id")).alias("dataset"),
        F.col("vec_id").alias("sample_id"),
        F.slice("embedding", F.col("run.run_idx") * 3 + 1, F.lit(3)).cast("array<double>").alias("logits"),
    )


def predictions(spark: SparkSession, sf_dir: str, features: dict[str, Column] | None = None,
                per_sample: DataFrame | None = None) -> DataFrame:
    """(model, model_type, dataset, sample_id, text, true_label, logits, predicted_label).

    The per-sample join (embeddings with documents) happens before the run grid is
    exploded, so the shuffle carries each text once, not once per run.  ``features`` (columns
    made from ``text``) and ``per_sample`` (a table by ``sample_id``) are added there too."""
    emb = read(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    # per-sample features are computed once, before the run grid multiplies the rows
    samples = emb.join(docs, emb.vec_id == docs.doc_id).withColumn("text_length", word_count("text"))
    samples = samples.withColumns(features or {})
    more = list(features or {})
    if per_sample is not None:
        more += [c for c in per_sample.columns if c != "sample_id"]
        samples = samples.join(per_sample.withColumnRenamed("sample_id", "vec_id"), "vec_id", "left")
    runs = F.array(*[F.struct(F.lit(i).alias("run_idx"), F.lit(m).alias("model"), F.lit(t).alias("model_type"))
                     for i, m, t in run_grid()])
    exploded = samples.select("vec_id", "text", "text_length", *more, "label", "embedding", F.explode(runs).alias("run"))
    logits = F.slice("embedding", F.col("run.run_idx") * 3 + 1, F.lit(3)).cast("array<double>")
    return exploded.select(
        F.col("run.model").alias("model"), F.col("run.model_type").alias("model_type"),
        eval_dataset_of(F.col("vec_id")).alias("dataset"),
        F.col("vec_id").alias("sample_id"), "text", "text_length", *more,
        (F.col("label") % 3).cast("int").alias("true_label"),
        logits.alias("logits"),
    ).withColumn("predicted_label", remap_prediction(argmax("logits"), model_family("model")))


def secondary_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sample_id, secondary_label): a two-class stage-2 model (0 neutral, 1 positive)."""
    emb = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return emb.select(F.col("vec_id").alias("sample_id"),
                      argmax(F.slice("embedding", 61, 2).cast("array<double>")).alias("secondary_label"))


def variant_predictions(spark: SparkSession, sf_dir: str, pattern: str, replacements: list[str]) -> DataFrame:
    """What a store of predictions for counterfactual copies of the texts holds: the copies
    come from C7, one per replacement, and a copy whose text differs from the original flips
    class for a hash-chosen quarter of the runs; ``original`` keeps the prediction.  Whether a
    copy differs is found per sample, before the runs multiply the rows."""
    from tonality.operators.augment import replace_keyword_variants
    samples = eval_samples(spark, sf_dir).select("sample_id", "text", F.col("text").alias("_text"))
    copies = replace_keyword_variants(samples, pattern, replacements)
    changed = copies.groupBy("sample_id").agg(
        F.array_sort(F.collect_set(F.when(F.col("text") != F.col("_text"), F.col("replacement")))).alias("_changed"))
    preds = predictions(spark, sf_dir, per_sample=changed)
    ex = preds.select("*", F.explode(F.array(*[F.lit(v) for v in ["original", *replacements]])).alias("replacement"))
    flip = hash32(F.col("replacement"), F.col("model"), F.col("model_type"), F.col("sample_id")) % 4 == 0
    return ex.withColumn("predicted_label", F.when(F.array_contains("_changed", F.col("replacement")) & flip, (F.col("predicted_label") + 1) % 3)
                         .otherwise(F.col("predicted_label")).cast("int")).drop("_changed")


def feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(url, time_published, ticker_sentiment[]): one news article per event."""
    ev = read(spark, sf_dir, "events").select("event_id", "ts", "event_type", "value")
    main = F.struct(F.upper("event_type").alias("ticker"),
                    F.format_string("%.4f", F.col("value") / 100).alias("relevance_score"))
    second = F.struct(F.lit("IDX").alias("ticker"),
                      F.format_string("%.4f", (hash32("rel", F.col("event_id")) % 10000) / F.lit(10000.0))
                      .alias("relevance_score"))
    return ev.select(
        F.concat(F.lit("https://news.example/a/"), F.col("event_id").cast("string")).alias("url"),
        F.date_format("ts", "yyyyMMdd'T'HHmmss").alias("time_published"),
        F.array(main, second).alias("ticker_sentiment"),
    )


def score_articles(windowed: DataFrame) -> DataFrame:
    """Model verdict per article in the market space (-1 / 0 / +1): what a store of
    per-article verdicts would hold; a hash of the url picks the class."""
    return windowed.withColumn("score", (hash32("art", F.col("url")) % 3 - 1).cast("int"))


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(symbol, settlement_date, current_short, previous_short, chg, pct_change).

    Daily totals per symbol; the window is partitioned by symbol over the
    already-aggregated daily rows (days x symbols), never over raw events."""
    from pyspark.sql import Window
    ev = read(spark, sf_dir, "events").select("ts", "event_type", "value")
    daily = ev.groupBy(F.upper("event_type").alias("symbol"), F.to_date("ts").alias("settlement_date")).agg(
        F.sum(F.round(F.col("value") * 100).cast("bigint")).alias("current_short"))
    w = Window.partitionBy("symbol").orderBy("settlement_date")
    prev = F.coalesce(F.lag("current_short").over(w), F.col("current_short"))
    out = daily.withColumn("previous_short", prev)
    out = out.withColumn("chg", F.col("current_short") - F.col("previous_short"))
    return out.withColumn("pct_change", F.try_divide(F.col("chg") * 100.0, F.col("previous_short")))


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(symbol, date, open, close, volume): daily bars per order priority."""
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderdate", "o_orderpriority")
    return o.groupBy(F.col("o_orderpriority").alias("symbol"), F.to_date("o_orderdate").alias("date")).agg(
        F.min_by("o_totalprice", "o_orderkey").alias("open"),
        F.max_by("o_totalprice", "o_orderkey").alias("close"),
        F.count(F.lit(1)).alias("volume"))


# Answers a generative model might return (with and without the
# expected words) for the instruction prompt.
GENERATED_ANSWERS = ["Positive", " negative ", "neutral.", "Mostly positive I think"]


def generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sample_id, generated): prompt + answer per document; every fifth-by-hash
    row is the bare text (no ``Answer: `` marker)."""
    from tonality.functions.text import build_prompt
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    h = hash32("gen", F.col("doc_id"))
    ans = F.element_at(F.array(*[F.lit(a) for a in GENERATED_ANSWERS]), (h % 4 + 1).cast("int"))
    gen = F.when(h % 5 == 0, F.col("text")).otherwise(F.concat(build_prompt("text"), ans))
    return docs.select(F.col("doc_id").alias("sample_id"), gen.alias("generated"))


def aspects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sample_id, Title, Decisions): an aspect corpus whose decisions are a
    single-quoted map text (unanimous, conflicting, empty, malformed, unknown)."""
    ann = annotations(spark, sf_dir)
    h = hash32("asp", F.col("sample_id")) % 8
    l1, l2 = F.lower("labeler_1"), F.lower("labeler_2")
    full = F.concat(F.lit("{'ENT_A': '"), l1, F.lit("', 'ENT_B': '"), l2, F.lit("'}"))
    dec = (F.when(h == 0, F.lit("{}")).when(h == 1, F.lit("{'ENT_A': "))
           .when(h == 2, F.concat(F.lit("{'ENT_A': 'bullish', 'ENT_B': '"), l2, F.lit("'}")))
           .when(h == 3, F.concat(F.lit("{'ENT_A': '"), l1, F.lit("'}")))
           .otherwise(full))
    return ann.select("sample_id", F.col("text").alias("Title"), dec.alias("Decisions"))


def translation_memories(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(src, tgt) tables for the two translation hops (en -> fr, fr -> en), each
    covering about nine in ten documents; one target per source text."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    out = docs.where(hash32("tm1", F.col("doc_id")) % 10 != 0).groupBy(F.col("text").alias("src")).agg(
        F.min(F.concat(F.lit("[fr] "), F.col("text"))).alias("tgt"))
    back = docs.where(hash32("tm2", F.col("doc_id")) % 10 != 0).groupBy(
        F.concat(F.lit("[fr] "), F.col("text")).alias("src")).agg(F.min(F.concat(F.col("text"), F.lit(" [en]"))).alias("tgt"))
    return out, back


def attention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sample_id, layer, query_pos, key_pos, weight, is_target): head-averaged
    attention read off the 64-value embedding as 4 layers of 4 x 4 matrices;
    target key positions are chosen per sample by hash."""
    emb = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    ex = emb.select("vec_id", F.posexplode("embedding").alias("i", "w"))
    return ex.select(F.col("vec_id").alias("sample_id"), (F.col("i") / 16).cast("int").alias("layer"),
                     ((F.col("i") % 16) / 4).cast("int").alias("query_pos"), (F.col("i") % 4).alias("key_pos"),
                     F.abs(F.col("w").cast("double")).alias("weight"),
                     (hash32("tgt", F.col("vec_id"), F.col("i") % 4) % 3 == 0).alias("is_target"))
