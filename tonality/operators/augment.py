"""Augmentation (G1-G6) and token preparation.

All randomness is ``md5(seed:sample_id:position)``; every operator keeps one
output row per input row (C7 makes one per replacement) and works inside the
row with higher-order functions, so nothing is regrouped."""
from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tonality.functions.hashing import chance, hash32, unit_hash
from tonality.functions.labels import literal_map
from tonality.functions.text import sentences, tokenize_words, words
from tonality.operators.ordering import dense_index
from tonality.operators.stats import written

NEGATIONS = ["not", "n't"]
PAD_ID, UNK_ID, MASK_ID = 0, 1, 2
MASK_TOKEN = "[MASK]"
#: Label of a position that is no target.
NO_TARGET = -100
#: Frequent tokens looked up inside the row: how many, of what length, in how many hash buckets.
HOT_TOKENS, HOT_CHARS, HOT_BUCKETS = 4096, 40, 1024
ROW_GROUP_BYTES = 8 << 20


def replace_keyword_variants(df: DataFrame, pattern: str, replacements: list[str], text: str = "text") -> DataFrame:
    """One copy of each row per replacement, the pattern (ignoring case,
    Unicode boundaries) replaced by it; ``replacement`` tags the copy."""
    reps = F.explode(F.array(*[F.lit(r) for r in replacements])).alias("replacement")
    out = df.select("*", reps)
    return out.withColumn(text, F.regexp_replace(F.col(text), F.lit("(?iU)" + pattern), F.col("replacement")))


def _drop_one(ws: Column, drop: Column) -> Column:
    """``ws`` without position ``drop``, joined with a space; ``drop`` must be a
    precomputed value (a lambda does not share sub-expressions with its row)."""
    return F.array_join(F.filter(ws, lambda w, j: j != drop), " ")


def random_deletion_sentence(df: DataFrame, seed: int = 0, text: str = "text", key: str = "sample_id") -> DataFrame:
    """G1: in every sentence with more than one word delete one word chosen by
    hash(seed, key, sentence position); sentences re-joined with a space."""
    per = F.transform(F.transform(sentences(text), lambda s: words(s)),
                      lambda ws, i: F.struct(ws.alias("ws"), (hash32(seed, F.col(key), i) % F.size(ws))
                                             .cast("int").alias("drop")))
    out = F.transform("_sent", lambda x: F.when(F.size(x["ws"]) > 1, _drop_one(x["ws"], x["drop"]))
                      .otherwise(F.array_join(x["ws"], " ")))
    return df.withColumn("_sent", per).withColumn(text, F.array_join(out, " ")).drop("_sent")


def random_deletion_text(df: DataFrame, seed: int = 0, text: str = "text", key: str = "sample_id") -> DataFrame:
    """Delete one word of the whole text; texts of at most one word stay as
    they are; the rest is joined with a space (the reference glued words, T9)."""
    t = df.withColumn("_ws", words(text))
    t = t.withColumn("_drop", (hash32(seed, F.col(key)) % F.size("_ws")).cast("int"))
    return t.withColumn(text, F.when(F.size("_ws") > 1, _drop_one(F.col("_ws"), F.col("_drop")))
                        .otherwise(F.col(text))).drop("_ws", "_drop")


# A negation followed by a token, matched left to right without overlap (the
# reference's rule: the pair is consumed, a trailing negation stays).
_NEG_PAIR = r"(?<![^ ])(?:not|n't) ([^ ]+)"
_MARK = "\u0001"


def _marked_tokens(text: str) -> Column:
    """Tokens joined by spaces, each negated token prefixed by a marker and its
    negation removed; one linear regex pass."""
    joined = F.array_join(tokenize_words(text), " ")
    return F.split(F.regexp_replace(joined, _NEG_PAIR, _MARK + "$1"), " ")


def _resolve(tok: Column, antonym: Column) -> Column:
    word = F.substring(tok, 2, 1 << 30)
    return F.when(tok.startswith(_MARK), F.coalesce(antonym, word)).otherwise(tok)


def negation_antonym(df: DataFrame, antonyms, text: str = "text") -> DataFrame:
    """``not X`` / ``n't X`` -> antonym of X (X itself when it has none).

    ``antonyms`` is a dict, which becomes a map literal (a projection, no shuffle), or
    a ``(word, antonym)`` table, which is joined with the negated tokens only; those are
    then put back per text by a 256-bit hash of its tokens, so rows that share a key or a
    text stay rows of their own.  Of several antonyms of a word, in any case, the smallest
    is taken."""
    marked = _marked_tokens(text)
    if isinstance(antonyms, dict):
        amap = literal_map({k.lower(): v for k, v in antonyms.items()})
        out = F.transform(marked, lambda t: _resolve(t, F.try_element_at(amap, F.lower(F.substring(t, 2, 1 << 30)))))
        return df.withColumn(text, F.array_join(out, " "))
    t = df.withColumn("_m", marked).withColumn("_h", F.sha2(F.array_join("_m", " "), 256))
    ex = t.select("_h", F.posexplode("_m").alias("_pos", "_tok")).where(F.col("_tok").startswith(_MARK))
    lk = antonyms.groupBy(F.lower("word").alias("_lw")).agg(F.min("antonym").alias("_ant"))
    hits = ex.join(lk, F.lower(F.substring("_tok", 2, 1 << 30)) == lk["_lw"], "inner")
    g = hits.groupBy("_h").agg(F.map_from_entries(F.collect_set(F.struct("_pos", "_ant"))).alias("_amap"))
    j = t.join(g, "_h", "left")
    out = F.transform("_m", lambda tok, i: _resolve(tok, F.try_element_at(F.col("_amap"), i)))
    return j.withColumn(text, F.array_join(out, " ")).drop("_m", "_amap", "_h")


def keyword_mask(df: DataFrame, words_: list[str], p: float = 0.35, seed: int = 0, text: str = "text",
                 key: str = "sample_id") -> DataFrame:
    """With probability ``p`` per row, every whole-word occurrence of the
    keywords (ignoring case) becomes ``[MASK]``; ``masked`` tells which rows."""
    pat = r"(?iU)\b(" + "|".join(re.escape(w) for w in words_) + r")\b"
    chosen = unit_hash(seed, F.col(key)) < p
    return df.withColumn("masked", chosen).withColumn(
        text, F.when(chosen, F.regexp_replace(F.col(text), pat, MASK_TOKEN)).otherwise(F.col(text)))


def lower_tokens(text: str = "text") -> Column:
    """Tokens of the lower-cased text (as an uncased tokenizer does)."""
    return tokenize_words(F.lower(text))


def build_vocab(df: DataFrame, tokens: str = "tokens", first_id: int = 3) -> DataFrame:
    """C14 vocabulary: every token of every text counted (partial aggregate),
    ids dense from ``first_id`` by (count desc, token) without a one-task window."""
    # explode_outer + not-null: a plain explode makes Catalyst infer a size(tokens) > 0
    # filter and push it (the whole tokenising regex) below any repartition
    counts = (df.select(F.explode_outer(tokens).alias("token")).where(F.col("token").isNotNull())
              .groupBy("token").agg(F.count(F.lit(1)).alias("n")))
    return dense_index(counts, [F.desc("n"), F.asc("token")], "token_id", start=first_id)


def with_row_id(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder with ``_row``, a number of its own for every row.
    Small row groups let later scans of the files run in many tasks."""
    return written(df.withColumn("_row", F.monotonically_increasing_id()), "rows", {"parquet.block.size": ROW_GROUP_BYTES})


def frequent_ids(tokens: DataFrame, vocab: DataFrame, most: int = HOT_TOKENS) -> list[dict]:
    """Ids of about the ``most`` most frequent tokens of ``tokens(token)``, found by a mergeable
    counter, as one small dict for each of ``HOT_BUCKETS`` hash buckets.  Frequent tokens that
    the vocabulary lacks are in it as unknown.  At most ``most`` tokens of ``HOT_CHARS``
    characters, whatever the size of the data."""
    short = tokens.where(F.length("token") <= HOT_CHARS)
    top = short.agg(F.expr(f"approx_top_k(token, {most}, {4 * most})").alias("_t")).select(F.explode("_t.item").alias("token"))
    top = top.withColumn("_bucket", _bucket(F.col("token"))).cache()
    out: list[dict] = [{} for _ in range(HOT_BUCKETS)]
    for r in top.collect():
        out[r["_bucket"]][r["token"]] = UNK_ID
    for r in vocab.select("token", "token_id").join(F.broadcast(top), "token").collect():
        out[r["_bucket"]][r["token"]] = r["token_id"]
    top.unpersist()
    return out


def _bucket(token: Column) -> Column:
    return F.pmod(F.hash(token), F.lit(HOT_BUCKETS))


def _literal(hot: list[dict]) -> Column:
    """The buckets as one constant, folded when the plan is optimised."""
    def one(b: dict) -> str:
        pairs = ", ".join(f"cast(X'{t.encode().hex()}' AS string), {i}" for t, i in b.items())
        return f"map({pairs})" if b else "cast(map() AS map<string, int>)"
    return F.expr(f"array({', '.join(map(one, hot))})")


def look_up(frequent: Column, token: Column) -> Column:
    """The value of ``token`` in a constant made of hash buckets; null if it has none."""
    return F.try_element_at(F.get(frequent, _bucket(token)), token)


def constant_map(values: dict) -> Column:
    """A dict of strings to whole numbers as a constant for ``look_up``, which takes time that
    does not grow with the number of entries."""
    spark = SparkSession.active()
    out: list[dict] = [{} for _ in range(HOT_BUCKETS)]
    for r in spark.createDataFrame([(k,) for k in values], "k string").select("k", _bucket(F.col("k")).alias("b")).collect():
        out[r["b"]][r["k"]] = values[r["k"]]
    return _literal(out)


def rare_tokens(t: DataFrame, frequent: Column) -> DataFrame:
    """(_row, pos, token): the tokens of ``_kept`` that are not in ``frequent``; what is shuffled by token."""
    rare = F.transform("_kept", lambda x, i: F.when(look_up(frequent, x).isNull(), F.struct(i.alias("pos"), x.alias("token"))))
    x = t.select("_row", F.explode_outer(F.array_compact(rare)).alias("_x")).where(F.col("_x").isNotNull())
    return x.select("_row", "_x.pos", "_x.token")


def encode_tokens(df: DataFrame, vocab: DataFrame, max_len: int = 512, tokens: str = "tokens",
                  key: str = "sample_id", keep: tuple = ()) -> DataFrame:
    """C14 encoding: the first ``max_len`` tokens -> ids (unknown -> 1), padded
    with 0 to ``max_len``, with an attention mask; one output row for every input row.

    Frequent tokens are looked up inside the row in a literal of bounded size, so no token
    that makes up much of the data is ever a join key; the others are joined with the
    vocabulary and put back by row (at most ``max_len`` a row)."""
    if "_row" not in df.columns:
        df = with_row_id(df.select(key, *keep, tokens))
    kept = F.slice(F.coalesce(F.col(tokens), F.array().cast("array<string>")), 1, max_len)
    t = df.select("_row", key, *keep, kept.alias("_kept"))
    hot = frequent_ids(t.select(F.explode_outer("_kept").alias("token")), vocab)
    frequent = _literal(hot)
    ids = F.transform("_kept", lambda x: look_up(frequent, x))
    ex = rare_tokens(t, frequent)
    found = ex.join(vocab.select("token", F.col("token_id").cast("int").alias("id")), "token")
    found = found.groupBy("_row").agg(F.map_from_entries(F.collect_list(F.struct("pos", "id"))).alias("_rare"))
    j = t.select("_row", key, *keep, ids.alias("_ids")).join(found, "_row", "left")
    whole = F.transform("_ids", lambda x, i: F.coalesce(x, F.try_element_at("_rare", i), F.lit(UNK_ID)))
    j = j.select(key, *keep, F.size("_ids").alias("n_tokens"), whole.alias("_ids"))
    pad = F.lit(max_len) - F.col("n_tokens")
    return j.select(key, *keep, "n_tokens", F.concat("_ids", F.array_repeat(F.lit(PAD_ID), pad)).alias("input_ids"),
                    F.concat(F.array_repeat(F.lit(1), F.col("n_tokens")), F.array_repeat(F.lit(0), pad)).alias("attention_mask"))


def mlm_mask(df: DataFrame, p: float = 0.15, seed: int = 0, ids: str = "input_ids", key: str = "sample_id") -> DataFrame:
    """Each non-padding position is a target with probability ``p``: its input
    id becomes [MASK] and its label keeps the id; labels elsewhere are -100.  A position
    is hashed once, for its label; the input ids follow the labels (no id is negative)."""
    def chosen(x, i):
        return (x != PAD_ID) & chance(p, seed, F.col(key), i)
    labels = F.transform(ids, lambda x, i: F.when(chosen(x, i), x).otherwise(F.lit(NO_TARGET)))
    return df.withColumn("mlm_labels", labels).withColumn(
        "mlm_input_ids", F.zip_with(ids, "mlm_labels", lambda x, y: F.when(y != NO_TARGET, F.lit(MASK_ID)).otherwise(x)))


def pivot_translate(df: DataFrame, tm_out: DataFrame, tm_back: DataFrame, text: str = "text") -> DataFrame:
    """Two-hop translation through translation-memory tables
    ``(src, tgt)``; rows missing either hop get status ``not finished``."""
    def key(c):  # texts meet by a 256-bit hash; neither is sorted nor compared whole
        return F.sha2(F.col(c), 256)
    o = tm_out.select(key("src").alias("_s1"), key("tgt").alias("_mid"))
    b = tm_back.select(key("src").alias("_s2"), F.col("tgt").alias("back_translated"))
    j = df.withColumn("_s1", key(text)).join(o, "_s1", "left").join(b, F.col("_mid") == b["_s2"], "left")
    status = F.when(F.col("back_translated").isNotNull(), "finished").otherwise("not finished")
    return j.withColumn("status", status).drop("_s1", "_s2", "_mid")
