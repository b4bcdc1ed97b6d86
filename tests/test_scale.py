"""The same results when the data span many small partitions: ranks and split sizes on
generated rows, and the oracle comparison once more under small partitions and a low
broadcast threshold."""
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_DIR
from tests.oracle_compare import compare, duck
from tonality.operators import assemble as A
from tonality.operators.ordering import dense_index, hash_index
from tonality.plans import load_all

QUERIES = load_all()
ROWS = 200_000
SMALL = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k",
         "spark.sql.adaptive.coalescePartitions.minPartitionSize": "16k", "spark.sql.autoBroadcastJoinThreshold": "20k"}
NAMES = ["random_split", "three_way_split", "stratified_split", "with_row_index", "build_vocab", "pad_truncate_tokens",
         "mlm_mask", "masked_token_accuracy", "roi_per_trading_day", "read_split_dataset", "class_augment_pull",
         "class_distribution", "confidence_slices", "length_band_errors", "length_error_rate", "error_term_frequency",
         "two_stage_refine", "refine_impact", "variant_delta", "dedup_text", "pivot_translate", "keyword_share_predicted",
         "artifact_catalog", "write_partitioned", "articles_in_window", "window_sentiment", "dataset_catalog",
         "read_quoted_csv_in_parts", "read_sheet_files", "split_sentences_learned", "layer_attention_stats"]


@pytest.fixture(params=["aqe", "no aqe"])
def small(spark, request):
    conf = SMALL | {"spark.sql.adaptive.enabled": str(request.param == "aqe").lower()}
    old = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def rows(spark):
    return spark.range(ROWS).select(F.col("id").alias("sample_id"), F.repeat(F.md5(F.col("id").cast("string")), 4).alias("text"),
                                    (F.col("id") % 7 % 3).cast("int").alias("label")).repartition(64)


def test_ranks_are_dense_and_sizes_exact(small):
    df = rows(small)
    for part in (None, ["label"]):
        for ranked in (hash_index(df.withColumn("h", F.md5("text")), "h", ["sample_id"], "i", part),
                       dense_index(df, ["text", "sample_id"], "i", part)):
            got = ranked.groupBy(*(part or [])).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("i").alias("d"),
                                                   F.min("i").alias("lo"), F.max("i").alias("hi"), F.first("text")).collect()
            assert sum(r.n for r in got) == ROWS
            assert all(r.d == r.n and r.lo == 0 and r.hi == r.n - 1 for r in got)
    s = {r.split: r["count"] for r in A.random_split(df, 0.3).groupBy("split").count().collect()}
    assert s == {"train": 140_000, "test": 60_000}
    t = {r.split: r["count"] for r in A.three_way_split(df).groupBy("split").count().collect()}
    assert t == {"train": 120_000, "valid": 40_000, "test": 40_000}
    sizes = {r.label: r["count"] for r in df.groupBy("label").count().collect()}
    st = {(r.label, r.split): r["count"] for r in A.stratified_split(df).groupBy("label", "split").count().collect()}
    assert st == {(c, s): (-(-n * 2 // 5) if s == "test" else n - -(-n * 2 // 5)) for c, n in sizes.items() for s in ("train", "test")}


def test_order_of_the_dense_index(small):
    df = rows(small).where("sample_id % 40 = 0")
    got = [r.sample_id for r in dense_index(df, [F.desc("text"), F.asc("sample_id")], "i").orderBy("i").collect()]
    assert got == [r.sample_id for r in df.orderBy(F.desc("text"), "sample_id").collect()]


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle_over_small_partitions(spark, name):
    old = {k: spark.conf.get(k, None) for k in SMALL}
    try:
        for k, v in SMALL.items():
            spark.conf.set(k, v)
        q = QUERIES[name]
        r = compare(spark, duck(SF_DIR), name, q.build, q.sql, SF_DIR)
        assert r["status"] == "match" and r["spark_rows"] > 0, r
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
