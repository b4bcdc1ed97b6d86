"""Registered queries: augmentation (G), token preparation (C14) and the masked
token accuracy (H24)."""
from __future__ import annotations

from pyspark.sql import functions as F

from tonality.functions.hashing import chance
from tonality.operators import augment as G
from tonality.operators import evaluate as ev
from tonality.plans.registry import r6, register
from tonality.plans.views_sql import H, with_views
from tonality.sources import tables as tb

SEED = 7
WS = "regexp_extract_all({}, '\\S+')"
W = r"[^\p{L}\p{N}_]"
SENTS = ("list_filter(list_transform(regexp_extract_all(text, '[^.!?]+[.!?]*'), "
         "lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: length(x) > 0)")
TOKS = "regexp_extract_all(replace(text, 'n''t', ' n''t'), 'n''t|[\\p{L}\\p{N}_]+|[^\\p{L}\\p{N}_\\s]')"


def U(key_sql: str) -> str:
    return f"(CAST({H(key_sql)} AS DOUBLE) / CAST(4294967296 AS DOUBLE))"


@register("random_deletion_sentence", with_views(f"""
SELECT sample_id, array_to_string(list_transform(s, lambda x, i:
         CASE WHEN len({WS.format('x')}) > 1
              THEN array_to_string(list_filter({WS.format('x')}, lambda w, j:
                     j - 1 <> {H(f"'{SEED}:' || CAST(sample_id AS VARCHAR) || ':' || CAST(i - 1 AS VARCHAR)")}
                              % len({WS.format('x')})), ' ')
              ELSE array_to_string({WS.format('x')}, ' ') END), ' ') AS text
FROM (SELECT sample_id, {SENTS} AS s FROM texts)""", "texts"))
def q_random_deletion_sentence(spark, d):
    """G1: one random word deleted from each sentence of more than one word."""
    return G.random_deletion_sentence(tb.texts(spark, d), SEED).select("sample_id", "text")


@register("random_deletion_text", with_views(f"""
SELECT sample_id, CASE WHEN len(ws) > 1
         THEN array_to_string(list_filter(ws, lambda w, j:
                j - 1 <> {H(f"'{SEED}:' || CAST(sample_id AS VARCHAR)")} % len(ws)), ' ')
         ELSE text END AS text
FROM (SELECT sample_id, text, {WS.format('text')} AS ws FROM texts)""", "texts"))
def q_random_deletion_text(spark, d):
    """One random word deleted from each text (one-word texts unchanged)."""
    return G.random_deletion_text(tb.texts(spark, d), SEED).select("sample_id", "text")


_ANT_SQL = "SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in tb.ANTONYMS.items()) + ") a(word, antonym)"


def negation_sql(rel: str) -> str:
    """G3 over a relation (sample_id, text), with the CTE ``ant`` (``_ANT_SQL``)."""
    return f"""
SELECT p.sample_id, coalesce(z.text, '') AS text
FROM {rel} p LEFT JOIN (
  SELECT sample_id, string_agg(out, ' ' ORDER BY pos) AS text FROM (
    SELECT y.sample_id, y.pos,
           CASE WHEN y.consumed THEN coalesce(a.antonym, y.tok) WHEN y.neg AND y.pos < y.n THEN NULL ELSE y.tok END AS out
    FROM (SELECT *, coalesce(prev_neg AND prev_off % 2 = 0, false) AS consumed FROM (
            SELECT *, lag(neg) OVER (PARTITION BY sample_id ORDER BY pos) AS prev_neg,
                      lag(off) OVER (PARTITION BY sample_id ORDER BY pos) AS prev_off FROM (
              SELECT *, pos - min(pos) OVER (PARTITION BY sample_id, neg, grp) AS off FROM (
                SELECT *, pos - row_number() OVER (PARTITION BY sample_id, neg ORDER BY pos) AS grp FROM (
                  SELECT *, tok IN ('not', 'n''t') AS neg FROM (
                    SELECT sample_id, unnest(t) AS tok, unnest(generate_series(1, len(t))) AS pos, len(t) AS n
                    FROM (SELECT sample_id, {TOKS} AS t FROM {rel}))))))) y
    LEFT JOIN ant a ON lower(y.tok) = a.word)
  GROUP BY sample_id) z USING (sample_id)"""


@register("negation_antonym", with_views(negation_sql("probe_texts"), "probe_texts", extra={"ant": _ANT_SQL}))
def q_negation_antonym(spark, d):
    """``not X`` / ``n't X`` -> antonym of X, left to right."""
    return G.negation_antonym(tb.probe_texts(spark, d), tb.ANTONYMS).select("sample_id", "text")


def _mask_sql(x: str) -> str:
    pat = f"'(^|{W})(the|and)({W}|$)'"
    once = f"regexp_replace({x}, {pat}, '\\1[MASK]\\3', 'gi')"
    return f"regexp_replace({once}, {pat}, '\\1[MASK]\\3', 'gi')"


@register("keyword_mask", with_views(f"""
SELECT sample_id, {U("'0:' || CAST(sample_id AS VARCHAR)")} < 0.35 AS masked,
       CASE WHEN {U("'0:' || CAST(sample_id AS VARCHAR)")} < 0.35 THEN {_mask_sql('text')} ELSE text END AS text
FROM texts""", "texts"))
def q_keyword_mask(spark, d):
    """Keywords (``the``, ``and``) masked in a seeded 35 % of the rows."""
    return G.keyword_mask(tb.texts(spark, d), ["the", "and"], 0.35, 0).select("sample_id", "masked", "text")


# The reference's token lengths for training and for its baseline.
MAX_LEN, BASELINE_LEN = 512, 256
_VOCAB = {
    "t": f"SELECT sample_id, dataset, {TOKS.replace('replace(text,', 'replace(lower(text),')} AS toks FROM texts",
    "vocab": "SELECT token, row_number() OVER (ORDER BY n DESC, token) + 2 AS token_id FROM "
             "(SELECT token, count(*) AS n FROM (SELECT unnest(toks) AS token FROM t) GROUP BY token)",
}


def _enc(n: int) -> dict[str, str]:
    return _VOCAB | {
        "e": f"SELECT sample_id, unnest(list_slice(toks, 1, {n})) AS token, "
             f"unnest(generate_series(0, len(list_slice(toks, 1, {n})) - 1)) AS pos FROM t",
        "ids": "SELECT e.sample_id, list(CAST(coalesce(v.token_id, 1) AS INTEGER) ORDER BY e.pos) AS ids "
               "FROM e LEFT JOIN vocab v USING (token) GROUP BY e.sample_id",
        "enc": f"SELECT t.sample_id, t.dataset, CAST(len(coalesce(ids, [])) AS INTEGER) AS n_tokens, "
               f"list_concat(coalesce(ids, []), list_transform(range({n} - len(coalesce(ids, []))), lambda x: 0)) "
               f"AS input_ids FROM t LEFT JOIN ids USING (sample_id)",
    }


_ENC = _enc(MAX_LEN)


def _encoded(spark, d, max_len: int = MAX_LEN):
    # tokenised once, for the vocabulary and for the encoding
    t = G.with_row_id(tb.texts(spark, d).select("sample_id", "dataset", G.lower_tokens("text").alias("tokens")))
    vocab = G.build_vocab(t, "tokens")
    return G.encode_tokens(t, vocab, max_len, keep=("dataset",))


@register("build_vocab", with_views("SELECT token, token_id FROM vocab", "texts", extra=_VOCAB))
def q_build_vocab(spark, d):
    """C14: vocabulary of all tokens, ids by frequency (0 pad, 1 unknown, 2 mask)."""
    t = tb.texts(spark, d).select("sample_id", G.lower_tokens("text").alias("tokens"))
    return G.build_vocab(t, "tokens").select("token", "token_id")


_IDS = "SELECT sample_id, n_tokens, array_to_string(input_ids, ',') AS input_ids FROM enc"


@register("pad_truncate_tokens", with_views(_IDS, "texts", extra=_ENC))
def q_pad_truncate_tokens(spark, d):
    """C14: token ids truncated / padded to 512 with the attention mask length."""
    e = _encoded(spark, d)
    return e.select("sample_id", "n_tokens", F.array_join("input_ids", ",").alias("input_ids"))


@register("pad_truncate_tokens_baseline", with_views(_IDS, "texts", extra=_enc(BASELINE_LEN)))
def q_pad_truncate_tokens_baseline(spark, d):
    """C14: the same with the baseline's length of 256."""
    e = _encoded(spark, d, BASELINE_LEN)
    return e.select("sample_id", "n_tokens", F.array_join("input_ids", ",").alias("input_ids"))


def _mlm_sql(ids: str) -> str:
    return (f"list_transform({ids}, lambda x, i: CASE WHEN x <> 0 AND "
            f"{U(chr(39) + '0:' + chr(39) + ' || CAST(sample_id AS VARCHAR) || ' + chr(39) + ':' + chr(39) + ' || CAST(i - 1 AS VARCHAR)')}"
            f" < 0.15 THEN x ELSE -100 END)")


@register("mlm_mask", with_views(f"""
SELECT sample_id, array_to_string(lab, ',') AS mlm_labels,
       array_to_string(list_transform(list_zip(input_ids, lab), lambda z: CASE WHEN z[2] <> -100 THEN 2 ELSE z[1] END), ',')
         AS mlm_input_ids
FROM (SELECT sample_id, input_ids, {_mlm_sql('input_ids')} AS lab FROM enc)""", "texts", extra=_ENC))
def q_mlm_mask(spark, d):
    """15 % of the token positions become [MASK] targets (labels -100 elsewhere)."""
    m = G.mlm_mask(_encoded(spark, d), 0.15, 0)
    return m.select("sample_id", F.array_join("mlm_labels", ",").alias("mlm_labels"),
                    F.array_join("mlm_input_ids", ",").alias("mlm_input_ids"))


@register("masked_token_accuracy", with_views(f"""
SELECT dataset, sum(n_ok) AS n_correct, sum(n_scored) AS n_scored,
       {r6('coalesce(sum(n_ok) / nullif(sum(n_scored), 0), 0.0)')} AS accuracy
FROM (SELECT dataset,
             len(list_filter(list_zip(lab, pred), lambda z: z[1] <> -100 AND z[1] = z[2])) AS n_ok,
             len(list_filter(lab, lambda x: x <> -100)) AS n_scored
      FROM (SELECT dataset, lab,
                   list_transform(input_ids, lambda x, i: CASE WHEN
                     {U(chr(39) + 'pred:' + chr(39) + ' || CAST(sample_id AS VARCHAR) || ' + chr(39) + ':' + chr(39) + ' || CAST(i - 1 AS VARCHAR)')}
                     < 0.7 THEN x ELSE 1 END) AS pred
            FROM (SELECT *, {_mlm_sql('input_ids')} AS lab FROM enc)))
GROUP BY dataset""", "texts", extra=_ENC))
def q_masked_token_accuracy(spark, d):
    """Accuracy over masked token positions (label != -100), per dataset."""
    m = G.mlm_mask(_encoded(spark, d), 0.15, 0)
    m = m.withColumn("mlm_predictions", F.transform(
        "input_ids", lambda x, i: F.when(chance(0.7, "pred", F.col("sample_id"), i), x).otherwise(F.lit(1))))
    return ev.masked_token_accuracy(m, ["dataset"])


_TM = {
    "tm_out": f"SELECT text AS src, min('[fr] ' || text) AS tgt FROM documents "
              f"WHERE {H(chr(39) + 'tm1:' + chr(39) + ' || CAST(doc_id AS VARCHAR)')} % 10 <> 0 GROUP BY text",
    "tm_back": f"SELECT '[fr] ' || text AS src, min(text || ' [en]') AS tgt FROM documents "
               f"WHERE {H(chr(39) + 'tm2:' + chr(39) + ' || CAST(doc_id AS VARCHAR)')} % 10 <> 0 GROUP BY 1",
}


@register("pivot_translate", with_views("""
SELECT l.sample_id, b.tgt AS back_translated,
       CASE WHEN b.tgt IS NOT NULL THEN 'finished' ELSE 'not finished' END AS status
FROM texts l LEFT JOIN tm_out o ON l.text = o.src LEFT JOIN tm_back b ON o.tgt = b.src""", "texts",
                                      extra=_TM))
def q_pivot_translate(spark, d):
    """Two-hop translation by translation memories; misses -> ``not finished``."""
    out, back = tb.translation_memories(spark, d)
    return G.pivot_translate(tb.texts(spark, d), out, back).select("sample_id", "back_translated", "status")
