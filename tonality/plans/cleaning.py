"""Registered queries: filters (B), text functions (C1-C13), label encoding (D)
and annotation consensus (E)."""
from __future__ import annotations

from pyspark.sql import functions as F

from tonality.functions import labels as L
from tonality.functions import text as X
from tonality.operators import filters as B
from tonality.operators import labeling as LB
from tonality.operators import sentence_model as SM
from tonality.operators.stats import written
from tonality.plans.registry import register
from tonality.plans.views_sql import _prompt_sql, with_views
from tonality.sources import tables as tb

W = r"[^\p{L}\p{N}_]"  # a non-word character (Unicode), for the oracle's word boundaries


def ww_sql(x: str, word: str, repl: str, flags: str = "gi") -> str:
    """Whole-word replace with Unicode boundaries in DuckDB (two passes so that
    adjacent matches sharing a boundary are both replaced)."""
    pat = f"'(^|{W}){word}({W}|$)'"
    once = f"regexp_replace({x}, {pat}, '\\1{repl}\\2', '{flags}')"
    return f"regexp_replace({once}, {pat}, '\\1{repl}\\2', '{flags}')"


def kw_sql(x: str, word_regex: str) -> str:
    return (f"regexp_matches(regexp_replace(lower({x}), '{W}+', '  ', 'g'), '(^| ){word_regex}( |$)')")


# ---- B: projections and filters ---------------------------------------------------------
@register("conform_columns", """
SELECT d.doc_id AS sample_id, d.text, d.source, l.toxic AS label
FROM documents d JOIN labels l ON d.doc_id = l.doc_id""")
def q_conform_columns(spark, d):
    """B1: rename to (sample_id, text, label) and drop unused columns."""
    raw = tb.read(spark, d, "documents").join(tb.read(spark, d, "labels"), "doc_id")
    return B.conform_columns(raw, {"doc_id": "sample_id", "toxic": "label"}, ["quality", "n_chars", "lang"])


_LABEL_STR = "CASE WHEN sample_id % 7 = 3 THEN 'n/a' ELSE CAST(label AS VARCHAR) || '.0' END"


@register("cast_label_int", with_views(f"""
SELECT sample_id, label_text, CAST(try_cast(label_text AS DOUBLE) AS INTEGER) AS label,
       try_cast(label_text AS DOUBLE) IS NULL AS rejected
FROM (SELECT sample_id, {_LABEL_STR} AS label_text FROM labeled_text)""", "labeled_text"))
def q_cast_label_int(spark, d):
    """B2: float-text labels to INT; unparsable rows flagged as rejected (quarantine)."""
    lt = tb.labeled_text(spark, d).select(
        "sample_id", F.when(F.col("sample_id") % 7 == 3, "n/a")
        .otherwise(F.concat(F.col("label").cast("string"), F.lit(".0"))).alias("label_text"))
    good, bad = B.cast_label_int(lt.withColumn("label", F.col("label_text")), "label")
    return good.withColumn("rejected", F.lit(False)).unionByName(
        bad.withColumn("label", F.lit(None).cast("int")).withColumn("rejected", F.lit(True)))


@register("drop_unlabeled", with_views("SELECT sample_id, labeler_4 FROM annotations WHERE labeler_4 IS NOT NULL",
                                       "annotations"))
def q_drop_unlabeled(spark, d):
    """Rows without a label (labeler_4 missing) dropped."""
    return B.drop_unlabeled(tb.annotations(spark, d).select("sample_id", "labeler_4"), "labeler_4")


@register("require_fields", with_views("""
SELECT sample_id, labeler_1, labeler_2, labeler_3, labeler_4 FROM annotations
WHERE text IS NOT NULL AND labeler_1 IS NOT NULL AND labeler_2 IS NOT NULL AND labeler_3 IS NOT NULL
  AND labeler_4 IS NOT NULL""", "annotations"))
def q_require_fields(spark, d):
    """Rows with every mandatory field present."""
    a = B.require_fields(tb.annotations(spark, d), ["text", "labeler_1", "labeler_2", "labeler_3", "labeler_4"])
    return a.drop("text")


@register("filter_equals", "SELECT doc_id, source, n_chars FROM documents WHERE lang = 'en'")
def q_filter_equals(spark, d):
    """``lang = 'en'`` (the headline filter), pushed to the Parquet scan."""
    return B.filter_equals(tb.read(spark, d, "documents"), "lang", "en").select("doc_id", "source", "n_chars")


@register("filter_word_count_between", """
SELECT doc_id, source, CAST(len(regexp_extract_all(text, '\\S+')) AS INTEGER) AS word_count FROM documents
WHERE source = 'src1' AND len(regexp_extract_all(text, '\\S+')) BETWEEN 130 AND 250""")
def q_filter_word_count_between(spark, d):
    """Source ``src1`` with 130-250 words."""
    f = B.filter_word_count_between(tb.read(spark, d, "documents"), 130, 250, "src1")
    return f.select("doc_id", "source", X.word_count("text").alias("word_count"))


@register("filter_keyword", "SELECT doc_id FROM documents WHERE contains(text, 'The')")
def q_filter_keyword(spark, d):
    """Texts containing ``The`` (case-sensitive substring)."""
    return B.filter_keyword(tb.read(spark, d, "documents"), "The").select("doc_id")


@register("filter_keyword_ci", "SELECT doc_id FROM documents WHERE contains(lower(text), 'the')")
def q_filter_keyword_ci(spark, d):
    """Texts containing ``the`` ignoring case."""
    return B.filter_keyword(tb.read(spark, d, "documents"), "THE", case_sensitive=False).select("doc_id")


@register("filter_keyword_pattern",
          f"SELECT doc_id FROM documents WHERE {kw_sql('text', 'the[\\p{L}\\p{N}_]*')}")
def q_filter_keyword_pattern(spark, d):
    """Texts matching ``\\bthe\\w*\\b`` ignoring case (Unicode word classes)."""
    return B.filter_keyword_pattern(tb.read(spark, d, "documents"), r"\bthe\w*\b").select("doc_id")


@register("drop_class", with_views("SELECT sample_id, label FROM labeled_text WHERE label <> 0", "labeled_text"))
def q_drop_class(spark, d):
    """Negatives removed before two-class work."""
    return B.drop_class(tb.labeled_text(spark, d), label=0).select("sample_id", "label")


@register("filter_relevant_articles", with_views("""
SELECT url, time_published FROM feed
WHERE len(list_filter(ticker_sentiment, lambda x: x.ticker = 'CLICK'
                       AND try_cast(x.relevance_score AS DOUBLE) > 0.7)) > 0""", "feed"))
def q_filter_relevant_articles(spark, d):
    """Articles with a CLICK entry whose relevance exceeds 0.7."""
    return B.filter_relevant_articles(tb.feed(spark, d), "CLICK", 0.7).select("url", "time_published")


@register("with_row_index", """
SELECT doc_id, source, row_number() OVER (ORDER BY source, doc_id) - 1 AS row_index FROM documents""")
def q_with_row_index(spark, d):
    """Dense 0-based index in (source, doc_id) order, without a single-task window."""
    return B.with_row_index(tb.read(spark, d, "documents").select("doc_id", "source"), ["source", "doc_id"])


# ---- C: text functions --------------------------------------------------------------
def _probe(sql_expr: str) -> str:
    return with_views(f"SELECT sample_id, {sql_expr} AS text FROM probe_texts", "probe_texts")


def _probe_q(fn):
    def build(spark, d):
        p = tb.probe_texts(spark, d)
        return p.select("sample_id", fn(F.col("text")).alias("text"))
    return build


register("strip_urls", _probe("regexp_replace(text, 'https://\\S+', '', 'g')"))(
    _probe_q(X.strip_urls))
register("remove_whole_word", _probe(ww_sql("text", "user", "")))(
    _probe_q(lambda c: X.remove_whole_word(c, "user")))
register("unescape_apostrophe", _probe("replace(text, '&#39;', '''')"))(_probe_q(X.unescape_apostrophe))
register("keep_basic_chars", _probe("regexp_replace(text, '[^A-Za-z0-9\\s.,!?''\"-]', '', 'g')"))(
    _probe_q(X.keep_basic_chars))
register("keep_printable_ascii", _probe("regexp_replace(text, '[^\\x20-\\x7E]+', '', 'g')"))(
    _probe_q(X.keep_printable_ascii))


@register("word_count", with_views(
    "SELECT sample_id, CAST(len(regexp_extract_all(text, '\\S+')) AS INTEGER) AS word_count FROM probe_texts",
    "probe_texts"))
def q_word_count(spark, d):
    """Whitespace word count (Python ``split()`` semantics)."""
    return tb.probe_texts(spark, d).select("sample_id", X.word_count("text").alias("word_count"))


# Counterfactual replacements of the keyword.
REPLACEMENTS = ["share", "pay", "cut"]


@register("replace_keyword_variants", with_views(" UNION ALL ".join(
    f"SELECT sample_id, '{r}' AS replacement, {ww_sql('text', 'the', r, 'gi')} AS text FROM texts"
    for r in REPLACEMENTS), "texts"))
def q_replace_keyword_variants(spark, d):
    """Three counterfactual copies per row, ``\\bthe\\b`` -> share / pay / cut."""
    from tonality.operators.augment import replace_keyword_variants
    return replace_keyword_variants(tb.texts(spark, d), r"\bthe\b", REPLACEMENTS).select(
        "sample_id", "replacement", "text")


@register("build_prompt", with_views(
    f"SELECT sample_id, {_prompt_sql('text')} "
    f"AS prompt FROM texts", "texts"))
def q_build_prompt(spark, d):
    """Instruction prompt around each text."""
    return tb.texts(spark, d).select("sample_id", X.build_prompt("text").alias("prompt"))


_ANS = ("CASE WHEN contains(generated, 'Answer: ') THEN lower(trim(string_split(generated, 'Answer: ')[-1])) "
        "ELSE 'Error' END")


@register("extract_answer", with_views(f"SELECT sample_id, {_ANS} AS answer FROM generations", "generations"))
def q_extract_answer(spark, d):
    """Answer after the last ``Answer: `` (``Error`` when absent)."""
    return tb.generations(spark, d).select("sample_id", X.extract_answer("generated").alias("answer"))


@register("normalize_sentiment_text", with_views(f"""
SELECT sample_id, CASE WHEN contains(lower(a), 'positive') THEN 'positive'
                       WHEN contains(lower(a), 'negative') THEN 'negative' ELSE 'neutral' END AS sentiment
FROM (SELECT sample_id, {_ANS} AS a FROM generations)""", "generations"))
def q_normalize_sentiment_text(spark, d):
    """Free-text answer -> positive / negative / neutral."""
    return tb.generations(spark, d).select(
        "sample_id", X.normalize_sentiment_text(X.extract_answer("generated")).alias("sentiment"))


@register("model_family", with_views("""
SELECT model, model_type, dataset, sample_id,
       CASE WHEN lower(model) LIKE '%distilroberta%' THEN 'distilRoberta'
            WHEN lower(model) LIKE '%distilbert%' THEN 'distilBert'
            WHEN lower(model) LIKE '%finbert%' THEN 'finBert'
            WHEN lower(model) LIKE '%electra%' THEN 'Electra' END AS family
FROM raw_predictions""", "raw_predictions"))
def q_model_family(spark, d):
    """C11: model name -> family key (order of tests matters)."""
    return tb.raw_predictions(spark, d).select("model", "model_type", "dataset", "sample_id",
                                               X.model_family("model").alias("family"))


@register("split_sentences", """
SELECT sample_id, unnest(generate_series(0, len(s) - 1)) AS pos, unnest(s) AS sentence
FROM (SELECT doc_id AS sample_id,
             list_filter(list_transform(regexp_extract_all(text, '[^.!?]+[.!?]*'),
                                        lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')),
                         lambda x: length(x) > 0) AS s
      FROM documents)""")
def q_split_sentences(spark, d):
    """One row per sentence with its position."""
    return tb.read(spark, d, "documents").select(
        F.col("doc_id").alias("sample_id"), F.posexplode_outer(X.sentences("text")).alias("pos", "sentence")).where(
        F.col("sentence").isNotNull())


# fragments with abbreviations and the same words elsewhere, so that there is something to learn
ABBREVIATED = [" Dr. Miller met Prof. Ito at noon in May, e.g. on lots. They rose and left.",
               " In May the lots rose. Mr. Chan left with Dr. Lee, approx. at noon. They met on lots.",
               " Lots left in May rose at noon. They met approx. two others, i.e. Dr. No and K. Wu."]
_CORE_RE, _TYPE_RE = "'^[^\\p{L}\\p{N}]+|[^\\p{L}\\p{N}.]+$'", "'^\\p{L}+(\\.\\p{L}+)*\\.?$'"
_PERIOD_RE, _STRONG_RE, _UPPER_RE = """'\\.["'')\\]]*$'""", """'[!?]["'')\\]]*$'""", "'^[^\\p{L}\\p{N}]*\\p{Lu}'"
_BOUNDARY_CTES = {
    "ax": "SELECT doc_id AS sample_id, text || CASE doc_id % 3 " + " ".join(
        f"WHEN {i} THEN '{t}'" for i, t in enumerate(ABBREVIATED)) + " END AS text FROM documents",
    "ws": "SELECT sample_id, regexp_extract_all(text, '\\S+') AS ws FROM ax",
    "w0": "SELECT sample_id, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS i FROM ws",
    "w1": f"SELECT *, regexp_replace(w, {_CORE_RE}, '', 'g') AS core FROM w0",
    "wt": f"SELECT *, CASE WHEN regexp_matches(core, {_TYPE_RE}) THEN lower(regexp_replace(core, '\\.$', '')) END AS type, "
          "ends_with(core, '.') AS per FROM w1",
    "ab0": "SELECT type, count_if(per) AS k, count_if(NOT per) AS r, length(replace(type, '.', '')) AS len FROM wt "
           "WHERE type IS NOT NULL GROUP BY type HAVING count_if(per) > 0",
    "ab": "SELECT type, k AS n_period, r AS n_plain, score FROM (SELECT *, 2 * (k * (ln(0.99) - ln(p)) + CASE WHEN r > 0 THEN "
          "r * (ln(1 - 0.99) - ln(1 - p)) ELSE 0 END) * exp(-len) * (length(type) - len + 1) * pow(CAST(len AS DOUBLE), -r) AS score "
          "FROM ab0, (SELECT count_if(per) / count(*) AS p FROM wt)) WHERE score >= 0.3",
    "nx": f"SELECT *, coalesce(regexp_matches(lag(w) OVER o, {_PERIOD_RE}) AND NOT coalesce(lag(type) OVER o, '') IN (SELECT type FROM ab), "
          f"false) AS after, regexp_matches(w, {_UPPER_RE}) AS up FROM wt WINDOW o AS (PARTITION BY sample_id ORDER BY i)",
    "st0": "SELECT type, count_if(after AND up) AS k, count(*) AS n FROM nx WHERE type IS NOT NULL GROUP BY type HAVING count_if(after AND up) > 0",
    "st": "SELECT type, k AS n_start, n AS n_all, score FROM (SELECT *, 2 * (k * (ln(k / n) - ln(p)) + CASE WHEN n > k THEN (n - k) * "
          "(ln(1 - k / n) - ln(1 - p)) ELSE 0 END) AS score FROM st0, (SELECT count_if(after) / count(*) AS p FROM nx) WHERE k / n > p) "
          "WHERE score >= 30",
    "fl": f"SELECT *, regexp_matches(w, {_STRONG_RE}) OR (regexp_matches(w, {_PERIOD_RE}) AND (NOT (coalesce(type, '') IN (SELECT type FROM ab) "
          f"OR length(coalesce(type, '')) = 1) OR coalesce(lead(up) OVER o AND coalesce(lead(type) OVER o, '') IN (SELECT type FROM st), false))) "
          "AS fin FROM nx WINDOW o AS (PARTITION BY sample_id ORDER BY i)",
    "gr": "SELECT *, coalesce(sum(CAST(fin AS INTEGER)) OVER (PARTITION BY sample_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) "
          "AS g FROM fl",
}


def _boundary_sql(last: str) -> str:
    return "WITH " + ", ".join(f"{k} AS ({v})" for k, v in _BOUNDARY_CTES.items()) + " " + last


def _abbreviated(spark, d):
    frag = F.element_at(F.array(*[F.lit(x) for x in ABBREVIATED]), (F.col("doc_id") % len(ABBREVIATED) + 1).cast("int"))
    return tb.read(spark, d, "documents").select(F.col("doc_id").alias("sample_id"), F.concat("text", frag).alias("text"))


@register("sentence_boundary_types", _boundary_sql(
    "SELECT 'abbreviation' AS kind, type, n_period AS n_hit, n_plain AS n_other, round(score, 6) AS score FROM ab UNION ALL "
    "SELECT 'starter', type, n_start, n_all - n_start, round(score, 6) FROM st"))
def q_sentence_boundary_types(spark, d):
    """Abbreviations and sentence starters learned from the whole corpus."""
    t = _abbreviated(spark, d)
    ab = written(SM.learn_abbreviations(t), "abbreviations")
    st = SM.learn_starters(t, ab)
    return ab.select(F.lit("abbreviation").alias("kind"), "type", F.col("n_period").alias("n_hit"), F.col("n_plain").alias("n_other"), "score").unionByName(
        st.select(F.lit("starter").alias("kind"), "type", F.col("n_start").alias("n_hit"), (F.col("n_all") - F.col("n_start")).alias("n_other"), "score"))


@register("split_sentences_learned", _boundary_sql(
    "SELECT sample_id, row_number() OVER (PARTITION BY sample_id ORDER BY g) - 1 AS pos, sentence FROM "
    "(SELECT sample_id, g, string_agg(w, ' ' ORDER BY i) AS sentence FROM gr GROUP BY sample_id, g)"))
def q_split_sentences_learned(spark, d):
    """Sentences split at learned boundaries, one row each with its position."""
    t = _abbreviated(spark, d)
    ab = written(SM.learn_abbreviations(t), "abbreviations")
    st = written(SM.learn_starters(t, ab), "starters")
    out = t.select("sample_id", F.posexplode_outer(SM.sentences("text", ab, st)).alias("pos", "sentence"))
    return out.where(F.col("sentence").isNotNull()).withColumn("pos", F.col("pos").cast("long"))


_TOK_SQL = ("regexp_extract_all(replace(text, 'n''t', ' n''t'), "
            "'n''t|[\\p{L}\\p{N}_]+|[^\\p{L}\\p{N}_\\s]')")


@register("tokenize_words", with_views(f"""
SELECT sample_id, CAST(len(t) AS INTEGER) AS n_tokens, array_to_string(t, ' ') AS tokens
FROM (SELECT sample_id, {_TOK_SQL} AS t FROM probe_texts)""", "probe_texts"))
def q_tokenize_words(spark, d):
    """Word tokens with ``n't`` split off."""
    t = X.tokenize_words("text")
    return tb.probe_texts(spark, d).select("sample_id", F.size(t).cast("int").alias("n_tokens"),
                                           F.array_join(t, " ").alias("tokens"))


def _treebank_sql(x: str) -> str:
    quoted = lambda v: "'" + v.replace("'", "''") + "'"
    for pattern, replacement in X.TREEBANK_RULES:
        x = f"regexp_replace({x}, {quoted(pattern)}, {quoted(replacement)}, 'g')"
    return f"regexp_extract_all({x}, '[^ \\t\\n\\r\\f\\x0b]+')"


# fragments with the marks that the rules are about
TREEBANK_FRAGMENTS = [' He said "it\'ll rise," didn\'t he?', " The firm's gain (5%) -- wow... they cannot lose.",
                      " 'Tis gonna be 3,000: we've seen 'em, more'n once.", " [a] \"b\" c; d & e!", ""]


def _treebank_texts_sql() -> str:
    cases = " ".join(f"WHEN {i} THEN '" + t.replace("'", "''") + "'" for i, t in enumerate(TREEBANK_FRAGMENTS))
    return f"(SELECT doc_id AS sample_id, text || CASE doc_id % {len(TREEBANK_FRAGMENTS)} {cases} END AS text FROM documents)"


@register("tokenize_treebank", f"""
SELECT sample_id, CAST(len(t) AS INTEGER) AS n_tokens, array_to_string(t, ' ') AS tokens
FROM (SELECT sample_id, {_treebank_sql('text')} AS t FROM {_treebank_texts_sql()})""")
def q_tokenize_treebank(spark, d):
    """Word tokens by the Treebank rules."""
    frag = F.element_at(F.array(*[F.lit(x) for x in TREEBANK_FRAGMENTS]), (F.col("doc_id") % len(TREEBANK_FRAGMENTS) + 1).cast("int"))
    t = tb.read(spark, d, "documents").select(F.col("doc_id").alias("sample_id"),
                                              X.treebank_tokens(F.concat("text", frag)).alias("t"))
    return t.select("sample_id", F.size("t").cast("int").alias("n_tokens"), F.array_join("t", " ").alias("tokens"))


# ---- D: label encoding ----------------------------------------------------------------
@register("label_from_score", with_views("""
SELECT sample_id, score, CAST(CASE WHEN score <= -0.4 THEN 0 WHEN score <= 0.5 THEN 1 ELSE 2 END AS INTEGER) AS label
FROM labeled_text""", "labeled_text"))
def q_label_from_score(spark, d):
    """Score -> label (<= -0.4 negative, <= 0.5 neutral, else positive)."""
    return tb.labeled_text(spark, d).select("sample_id", "score", L.label_from_score("score").alias("label"))


@register("label_from_name", with_views("""
SELECT sample_id, labeler_1,
       CAST(CASE labeler_1 WHEN 'NEGATIVE' THEN 0 WHEN 'NEUTRAL' THEN 1 WHEN 'POSITIVE' THEN 2 END AS INTEGER) AS label,
       CAST(CASE lower(labeler_1) WHEN 'positive' THEN 0 WHEN 'negative' THEN 1 WHEN 'neutral' THEN 2 END AS INTEGER)
         AS finbert_label
FROM annotations""", "annotations"))
def q_label_from_name(spark, d):
    """Label names -> canonical ids and -> the finBert id space."""
    a = tb.annotations(spark, d)
    return a.select("sample_id", "labeler_1", L.label_from_name("labeler_1", L.ANNOTATION_NAMES).alias("label"),
                    F.try_element_at(L.literal_map(L.FAMILY_NAMES["finBert"]), F.lower("labeler_1"))
                    .cast("int").alias("finbert_label"))


def _remap_sql(col: str, m: dict) -> str:
    return "CAST(CASE " + " ".join(f"WHEN {col} = {k} THEN {v}" for k, v in m.items()) + " END AS INTEGER)"


_REMAP_SPACES = ["finbert", "distilbert", "synthetic_tweets", "twitter_news", "two_class"]


@register("label_remap", with_views(
    "SELECT sample_id, label, " + ", ".join(f"{_remap_sql('label', L.REMAPS[s])} AS from_{s}" for s in _REMAP_SPACES)
    + f", {_remap_sql('label', L.TO_MARKET)} AS to_market FROM labeled_text", "labeled_text"))
def q_label_remap(spark, d):
    """D3: every named integer remap applied to the labels."""
    lt = tb.labeled_text(spark, d)
    cols = [L.label_remap("label", s).alias(f"from_{s}") for s in _REMAP_SPACES]
    return lt.select("sample_id", "label", *cols, L.label_remap("label", "", L.TO_MARKET).alias("to_market"))


@register("label_two_class", with_views("""
SELECT sample_id, CAST(CASE label WHEN 1 THEN 0 WHEN 2 THEN 1 END AS INTEGER) AS label
FROM labeled_text WHERE label <> 0""", "labeled_text"))
def q_label_two_class(spark, d):
    """Neutral 0 / positive 1 after dropping negatives."""
    return LB.label_two_class(tb.labeled_text(spark, d)).select("sample_id", "label")


_JSON = "replace(Decisions, '''', '\"')"
_VALS = f"list_distinct(list_transform(map_values(json_transform({_JSON}, '\"MAP(VARCHAR, VARCHAR)\"')), lambda v: lower(trim(v))))"


@register("label_unanimous_map", with_views(f"""
SELECT sample_id, Decisions,
       CAST(CASE WHEN json_valid({_JSON}) AND len({_VALS}) = 1
                 THEN CASE {_VALS}[1] WHEN 'negative' THEN 0 WHEN 'neutral' THEN 1 WHEN 'positive' THEN 2 END
            END AS INTEGER) AS label
FROM aspects""", "annotations", "aspects"))
def q_label_unanimous_map(spark, d):
    """Aspect map text -> label when all aspects agree, else null."""
    a = tb.aspects(spark, d)
    return a.select("sample_id", "Decisions", L.label_unanimous_map("Decisions").alias("label"))


@register("label_from_generated", with_views(f"""
SELECT sample_id, CAST(CASE {_ANS} WHEN 'positive' THEN 2 WHEN 'negative' THEN 0 ELSE 1 END AS INTEGER) AS label
FROM generations""", "generations"))
def q_label_from_generated(spark, d):
    """Generated answer -> 2 / 0, anything else (``Error`` too) -> 1."""
    return tb.generations(spark, d).select("sample_id", L.label_from_generated("generated").alias("label"))


# ---- E: annotation consensus --------------------------------------------------------
_CONS = """
SELECT sample_id, text, label AS agreement, CAST(n AS INTEGER) AS consensus_count FROM (
  SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY n DESC, label) AS r FROM (
    SELECT sample_id, text, CAST(CASE v WHEN 'NEGATIVE' THEN 0 WHEN 'NEUTRAL' THEN 1 WHEN 'POSITIVE' THEN 2 END
                                 AS INTEGER) AS label, count(*) AS n
    FROM (SELECT sample_id, text, unnest([labeler_1, labeler_2, labeler_3, labeler_4]) AS v FROM annotations)
    WHERE v IS NOT NULL GROUP BY ALL))
WHERE r = 1"""


@register("consensus_label", with_views("SELECT sample_id, agreement, consensus_count FROM c", "annotations",
                                        extra={"c": _CONS}))
def q_consensus_label(spark, d):
    """Majority label of four annotators and its votes (tie -> smallest label)."""
    return LB.consensus_label(tb.annotations(spark, d)).select("sample_id", "agreement", "consensus_count")


@register("consensus_all_agree", with_views(
    "SELECT sample_id, text, agreement AS label FROM c WHERE consensus_count = 4", "annotations", extra={"c": _CONS}))
def q_consensus_all_agree(spark, d):
    """Texts where all four annotators agree."""
    return LB.consensus_subset(LB.consensus_label(tb.annotations(spark, d)), 4)


@register("consensus_subset", with_views(
    "SELECT sample_id, text, agreement AS label FROM c WHERE consensus_count >= 3", "annotations", extra={"c": _CONS}))
def q_consensus_subset(spark, d):
    """The consensus subset at the 75 % level (3 of 4 annotators)."""
    return LB.consensus_subset(LB.consensus_label(tb.annotations(spark, d)), 3)


@register("consensus_75", with_views(
    "SELECT sample_id, text, agreement AS label FROM c WHERE consensus_count >= 3", "annotations", extra={"c": _CONS}))
def q_consensus_75(spark, d):
    """Texts where at least three of four annotators agree."""
    return LB.consensus_subset(LB.consensus_label(tb.annotations(spark, d)), 3)
