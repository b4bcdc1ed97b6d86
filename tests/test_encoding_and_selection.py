"""Token encoding with frequent tokens, repeated row keys, and exact selection."""
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tonality.functions.hashing import chance, unit_hash
from tonality.operators import augment as G
from tonality.operators import stats


def _token_rows(n=400, width=60, seed=3):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        toks = [("the" if rng.random() < 0.34 else f"w{int(rng.zipf(1.3)) % 5000}") for _ in range(int(rng.integers(0, width)))]
        rows.append((i // 2, toks))  # every key twice
    return rows


def _plain(rows, vocab, max_len):
    out = []
    for key, toks in rows:
        ids = [vocab.get(t, G.UNK_ID) for t in (toks or [])[:max_len]]
        out.append((key, len(ids), tuple(ids + [G.PAD_ID] * (max_len - len(ids)))))
    return Counter(out)


def _got(df):
    return Counter((r.sample_id, r.n_tokens, tuple(r.input_ids)) for r in df.collect())


def test_repeated_keys_keep_their_rows(spark):
    df = spark.createDataFrame([(1, ["a", "b"]), (1, ["c"]), (1, ["c"]), (None, ["a"]), (2, []), (3, None)], "sample_id long, tokens array<string>")
    vocab = spark.createDataFrame([("a", 3), ("b", 4)], "token string, token_id long")
    want = Counter([(1, 2, (3, 4, 0, 0)), (1, 1, (1, 0, 0, 0)), (1, 1, (1, 0, 0, 0)), (None, 1, (3, 0, 0, 0)), (2, 0, (0,) * 4), (3, 0, (0,) * 4)])
    assert _got(G.encode_tokens(df, vocab, 4)) == want


@pytest.mark.parametrize("most", [4096, 2])
def test_encoding_equals_a_plain_lookup(spark, monkeypatch, most):
    rows = _token_rows()
    df = G.with_row_id(spark.createDataFrame(rows, "sample_id long, tokens array<string>").repartition(6))
    vocab = G.build_vocab(df, "tokens").where("token <> 'w2'")  # a frequent unknown token
    known = {r.token: r.token_id for r in vocab.collect()}
    monkeypatch.setattr(G, "frequent_ids", lambda t, v, full=G.frequent_ids: full(t, v, most))
    assert _got(G.encode_tokens(df, vocab, 40)) == _plain(rows, known, 40)


def test_a_token_in_a_third_of_all_places_is_never_shuffled_by_itself(spark):
    rows = _token_rows(2000)
    df = G.with_row_id(spark.createDataFrame(rows, "sample_id long, tokens array<string>"))
    vocab = G.build_vocab(df, "tokens")
    hot = G.frequent_ids(df.select(F.explode("tokens").alias("token")), vocab, 64)
    frequent = {t for b in hot for t in b}
    assert "the" in frequent and len(frequent) <= 64
    rare = G.rare_tokens(df.withColumn("_kept", F.col("tokens")), G._literal(hot))
    assert "the" not in {r.token for r in rare.select("token").distinct().collect()}
    sizes = sorted(r["count"] for r in rare.repartition(8, "token").groupBy(F.spark_partition_id()).count().collect())
    assert len(sizes) == 8 and sizes[-1] <= 2 * np.median(sizes)


def test_frequent_lookup_is_bounded(spark):
    tokens = spark.range(60_000).select(F.concat(F.lit("t"), F.col("id") % 30_000).alias("token"))
    tokens = tokens.unionByName(spark.createDataFrame([("x" * 5000,)] * 3, "token string"))
    hot = G.frequent_ids(tokens, spark.createDataFrame([("t1", 9)], "token string, token_id long"))
    assert sum(map(len, hot)) <= G.HOT_TOKENS and all(len(t) <= G.HOT_CHARS for b in hot for t in b)


def test_antonym_table_with_repeated_keys(spark):
    df = spark.createDataFrame([(1, "not good and not bad"), (1, "it is not good"), (1, "it is not good"), (None, "not bad"), (2, None)],
                               "sample_id long, text string")
    table = spark.createDataFrame([("good", "bad"), ("bad", "good")], "word string, antonym string")
    got = Counter((r.sample_id, r.text) for r in G.negation_antonym(df, table).collect())
    assert got == Counter((r.sample_id, r.text) for r in G.negation_antonym(df, {"good": "bad", "bad": "good"}).collect())
    assert got[(1, "it is bad")] == 2


def test_masks_with_repeated_keys(spark):
    df = spark.createDataFrame([(1, ["a", "b"]), (1, ["c"])], "sample_id long, tokens array<string>")
    vocab = spark.createDataFrame([("a", 3), ("b", 4), ("c", 5)], "token string, token_id long")
    m = G.mlm_mask(G.encode_tokens(df, vocab, 3), 1.0).collect()
    assert sorted(tuple(r.mlm_labels) for r in m) == [(3, 4, -100), (5, -100, -100)]


@pytest.mark.parametrize("accuracy,most", [(10_000, 4096), (100, 128)])
def test_selection_is_exact_when_brackets_are_cut_again(spark, accuracy, most, monkeypatch):
    cuts = []
    monkeypatch.setattr(stats, "_cut", lambda *a, real=stats._cut: cuts.append(1) or real(*a))
    n = 30_000
    df = spark.range(n).select((F.col("id") % 3).alias("g"), F.when(F.col("id") % 3 == 2, F.floor(F.rand(5) * 9)).otherwise(F.rand(7)).alias("v"))
    df = stats.written(df, "values")
    probs = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.999, "e": 1.0}
    pdf = df.toPandas()
    got = {r.g: r for r in stats.group_percentiles(df, ["g"], "v", probs, accuracy, most).collect()}
    for g, part in pdf.groupby("g"):
        assert all(abs(got[g][k] - np.quantile(part.v, p)) < 1e-12 for k, p in probs.items())
    assert bool(cuts) == (accuracy == 100)


def test_selection_on_ten_million_tied_values(spark):
    df = spark.range(10_000_000).select(F.lit(1).alias("g"), (F.col("id") % 4).cast("double").alias("v"))
    r = stats.group_percentiles(df, ["g"], "v", {"a": 0.25, "b": 0.5, "c": 0.7500001}).first()
    v = np.repeat(np.arange(4.0), 2_500_000)
    assert (r.a, r.b, r.c) == tuple(np.quantile(v, p) for p in (0.25, 0.5, 0.7500001))


def test_a_masked_position_is_hashed_once(spark):
    df = spark.createDataFrame([(1, [5, 6, 7, 0]), (1, [5, 6, 7, 0]), (None, [9, None, 0]), (3, []), (4, None)], "sample_id long, input_ids array<int>")
    masked = G.mlm_mask(df, 0.5, 3)
    assert masked._jdf.queryExecution().optimizedPlan().toString().count("md5(") == 1
    number = F.transform("input_ids", lambda x, i: unit_hash(3, F.col("sample_id"), i))
    rows = masked.withColumn("u", number).collect()
    assert any(v != -100 for r in rows for v in r.mlm_labels or [])
    for r in rows:
        want = [x if x and u < 0.5 else -100 for x, u in zip(r.input_ids or [], r.u or [])]
        assert (r.mlm_labels or []) == want
        assert (r.mlm_input_ids or []) == [2 if y != -100 else x for x, y in zip(r.input_ids or [], want)]


@pytest.mark.parametrize("p", [-0.5, 0.0, 2.0 ** -40, 0.15, 0.35, 0.5, 0.7, 1 - 2.0 ** -40, 1.0, 2.0])
def test_a_chance_is_the_unit_hash_below_it(spark, p):
    df = spark.range(3000)
    assert df.where(chance(p, 7, F.col("id")) != (unit_hash(7, F.col("id")) < p)).count() == 0


def test_a_chance_at_the_hash_itself(spark):
    u = [r[0] for r in spark.range(200).select(unit_hash("s", F.col("id"))).orderBy("id").collect()]
    at = [chance(p, "s", F.lit(i)) for i, v in enumerate(u) for p in (v, v + 2.0 ** -32)]
    assert spark.range(1).select(F.array(*at).alias("a")).first().a == [False, True] * len(u)
