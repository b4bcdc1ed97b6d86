"""Registered queries: dataset catalogue and assembly."""
from __future__ import annotations


from pyspark.sql import functions as F

from tonality.operators import assemble as A
from tonality.operators import evaluate as ev
from tonality.operators import filters as B
from tonality.operators.labeling import label_universal
from tonality.operators.stats import written
from tonality.plans.augmentation import _ANT_SQL, negation_sql
from tonality.plans.registry import r6, register
from tonality.plans.views_sql import tallies_sql, with_views
from tonality.sources import catalog as C
from tonality.sources import tables as tb

_GRP = "CAST(CAST(regexp_extract(dataset, 'src(\\d+)', 1) AS INTEGER) // 5 AS INTEGER)"
_NAME = "['negative', 'neutral', 'positive'][{} + 1]"
_OTHER = "CASE WHEN sample_id % 3 = 0 THEN (label + 1) % 3 ELSE label END"
_NATIVE = {  # score, label_name, label, decisions, output
    "score": "score, NULL, NULL, NULL, NULL",
    "name": f"NULL, {_NAME.format('label')}, NULL, NULL, NULL",
    "pm1": "NULL, NULL, CASE WHEN label = 2 THEN 1 ELSE -1 END, NULL, NULL",
    "decisions": f"NULL, NULL, NULL, replace('{{\"A\": \"' || {_NAME.format('label')} || '\", \"B\": \"' || "
                 f"{_NAME.format(_OTHER)} || '\"}}', '\"', chr(39)), NULL",
    "output": f"NULL, NULL, NULL, NULL, 'Mostly ' || upper({_NAME.format('label')}) || ' I think'",
    "synthetic_tweets": "NULL, NULL, [2, 0, 1][label + 1], NULL, NULL",
}


def _raw_sql() -> str:
    parts = ["SELECT '' AS dataset, CAST(0 AS BIGINT) AS sample_id, '' AS text, CAST(0 AS DOUBLE) AS score, '' AS label_name, "
             "CAST(0 AS INTEGER) AS label, '' AS decisions, '' AS output WHERE false"]
    for name, (group, rule, _) in C.CATALOG.items():
        text = (f"text || '{C.BACK_TRANSLATED}'" if name.startswith("back_translated_") else
                "neg" if name.startswith("negation_") else "text")
        parts.append(f"SELECT '{name}', sample_id, {text}, {_NATIVE[rule]} FROM grouped WHERE grp = {group}")
    return " UNION ALL ".join(parts)


_RAWS = {
    "ant": _ANT_SQL,
    "negated": f"SELECT sample_id, text || '{C.NEGATED}' AS text FROM labeled_text",
    "negation": negation_sql("negated"),
    "grouped": f"SELECT l.*, n.text AS neg, {_GRP} AS grp FROM labeled_text l JOIN negation n USING (sample_id) "
               f"WHERE ({_GRP} <> 0 OR type = 'headline') AND ({_GRP} <> 2 OR label <> 1)",
    "raw": _raw_sql(),
}
_OPINION = "split_part(decisions, chr(39), {})"
_UNIVERSAL = f"""CAST(CASE
  WHEN dataset LIKE '%fiqa' THEN CASE WHEN score <= -0.4 THEN 0 WHEN score <= 0.5 THEN 1 WHEN score IS NOT NULL THEN 2 END
  WHEN dataset LIKE '%phrasebank' THEN CASE lower(label_name) WHEN 'negative' THEN 0 WHEN 'neutral' THEN 1 WHEN 'positive' THEN 2 END
  WHEN dataset LIKE '%stock_tweets' THEN CASE label WHEN 1 THEN 2 WHEN -1 THEN 0 END
  WHEN dataset LIKE '%aspect' THEN CASE WHEN {_OPINION.format(4)} = {_OPINION.format(8)} THEN
    CASE {_OPINION.format(4)} WHEN 'negative' THEN 0 WHEN 'neutral' THEN 1 WHEN 'positive' THEN 2 END END
  WHEN dataset = 'instruction' THEN CASE WHEN contains(lower(output), 'positive') THEN 2 WHEN contains(lower(output), 'negative') THEN 0 ELSE 1 END
  WHEN dataset = 'synthetic_tweets' THEN CASE label WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 0 END END AS INTEGER)"""
_W = r"[^\p{L}\p{N}_]"
_USER = f"'(^|{_W})user({_W}|$)'"
_UNESCAPED = "replace(text, '&#39;', chr(39))"
_CLEAN = (f"CASE WHEN dataset = 'fiqa' THEN regexp_replace(text, 'https://\\S+', '', 'g') "
          f"WHEN dataset = 'stock_tweets' THEN regexp_replace(regexp_replace(text, {_USER}, '\\1\\2', 'gi'), {_USER}, '\\1\\2', 'gi') "
          f"WHEN dataset IN ('back_translated_phrasebank', 'back_translated_stock_tweets') "
          f"THEN regexp_replace({_UNESCAPED}, '[^A-Za-z0-9\\s.,!?''\"-]', '', 'g') "
          f"WHEN dataset = 'back_translated_aspect' THEN {_UNESCAPED} ELSE text END")


@register("union_datasets", with_views("SELECT dataset, sample_id, text, score, label_name, label, decisions, output FROM raw",
                                       "labeled_text", extra=_RAWS))
def q_union_datasets(spark, d):
    """the corpora stacked by column name (missing columns null), from one written frame."""
    raw = written(C.raw_datasets(spark, d), "corpora")
    return A.union_datasets([raw.where(F.col("dataset") == n) for n in C.CATALOG])


@register("label_universal", with_views(f"SELECT dataset, sample_id, {_UNIVERSAL} AS label FROM raw",
                                        "labeled_text", extra=_RAWS))
def q_label_universal(spark, d):
    """One projection picks each corpus's label rule by dataset name."""
    return label_universal(C.raw_datasets(spark, d), C.universal_rules()).select("dataset", "sample_id", "label")


@register("dataset_catalog", with_views(f"""
SELECT dataset, sample_id, {_CLEAN} AS text, {_UNIVERSAL} AS label FROM raw""", "labeled_text", extra=_RAWS))
def q_dataset_catalog(spark, d):
    """A4: every catalogue corpus cleaned and conformed to (dataset, sample_id, text, label)."""
    return C.dataset_catalog(spark, d)


@register("dedup_text", """
SELECT min(doc_id) AS sample_id, text, arg_min(lang, doc_id) AS lang FROM documents GROUP BY text""")
def q_dedup_text(spark, d):
    """exact duplicate texts dropped, first (smallest id) kept."""
    docs = tb.read(spark, d, "documents").select(F.col("doc_id").alias("sample_id"), "text", "lang")
    return A.dedup_text(docs)


def _rank_sql(seed: int, part: str = "") -> str:
    p = f"PARTITION BY {part} " if part else ""
    return (f"row_number() OVER ({p}ORDER BY md5('{seed}:' || CAST(sample_id AS VARCHAR)), sample_id) - 1 AS rn, "
            f"count(*) OVER ({p.strip()}) AS n")


@register("random_split", with_views(f"""
SELECT sample_id, label, CASE WHEN rn < n - ceil(n * CAST(0.3 AS DOUBLE)) THEN 'train' ELSE 'test' END AS split
FROM (SELECT sample_id, label, {_rank_sql(42)} FROM labeled_text)""", "labeled_text"))
def q_random_split(spark, d):
    """seeded 70 / 30 split with exact sizes."""
    return A.random_split(tb.labeled_text(spark, d).select("sample_id", "label"), 0.3, 42)


_THREE = f"""
SELECT sample_id, label, CASE WHEN rn < rest - ceil(rest * CAST(0.25 AS DOUBLE)) THEN 'train'
                              WHEN rn < rest THEN 'valid' ELSE 'test' END AS split
FROM (SELECT *, n - ceil(n * CAST(0.2 AS DOUBLE)) AS rest
      FROM (SELECT sample_id, label, {_rank_sql(42)} FROM labeled_text))"""


def _three(spark, d):
    return A.three_way_split(tb.labeled_text(spark, d).select("sample_id", "label"), 42)


@register("three_way_split", with_views(_THREE, "labeled_text"))
def q_three_way_split(spark, d):
    """60 / 20 / 20 train / valid / test by two nested splits."""
    return _three(spark, d)


@register("stratified_split", with_views(f"""
SELECT sample_id, label, CASE WHEN rn < n - ceil(n * CAST(0.4 AS DOUBLE)) THEN 'train' ELSE 'test' END AS split
FROM (SELECT sample_id, label, {_rank_sql(1694, 'label')} FROM labeled_text)""", "labeled_text"))
def q_stratified_split(spark, d):
    """per-class 60 / 40 split keeping class proportions."""
    return A.stratified_split(tb.labeled_text(spark, d).select("sample_id", "label"), "label", 0.4, 1694)


@register("shuffle_take", """
SELECT doc_id AS sample_id, source FROM documents
WHERE len(regexp_extract_all(text, '\\S+')) BETWEEN 130 AND 250
ORDER BY md5('42:' || CAST(doc_id AS VARCHAR)), doc_id LIMIT 1000""")
def q_shuffle_take(spark, d):
    """articles of 130-250 words, seeded shuffle, the first min(1000, n)."""
    docs = B.filter_word_count_between(tb.read(spark, d, "documents"), 130, 250)
    return A.shuffle_take(docs.select(F.col("doc_id").alias("sample_id"), "source"), 1000, 42)


QUOTAS = {0: 30, 1: 40, 2: 150}


@register("class_quota", with_views(f"""
SELECT sample_id, label FROM (
  SELECT sample_id, label, row_number() OVER (PARTITION BY label ORDER BY sample_id) AS rn FROM labeled_text)
WHERE rn <= CASE label {' '.join(f'WHEN {k} THEN {v}' for k, v in QUOTAS.items())} END""", "labeled_text"))
def q_class_quota(spark, d):
    """the first 30 / 40 / 150 rows of classes 0 / 1 / 2."""
    return A.class_quota(tb.labeled_text(spark, d).select("sample_id", "label"), QUOTAS)


@register("class_skip", with_views("""
SELECT sample_id, label FROM (
  SELECT sample_id, label, row_number() OVER (PARTITION BY label ORDER BY sample_id) AS rn FROM labeled_text)
WHERE label <> 2 OR rn > 100""", "labeled_text"))
def q_class_skip(spark, d):
    """F8: the first 100 positives dropped, everything else kept."""
    return A.class_skip(tb.labeled_text(spark, d).select("sample_id", "label"), 2, 100)


@register("class_augment_pull", with_views("""
SELECT sample_id, label, split FROM s WHERE label = 0
UNION ALL
SELECT * FROM (SELECT sample_id, label, split FROM s WHERE label = 1 ORDER BY sample_id LIMIT 50)""", "labeled_text",
                                           extra={"s": _THREE}))
def q_class_augment_pull(spark, d):
    """all negatives from every split plus the first 50 neutral rows."""
    return A.class_augment_pull(_three(spark, d), 0, 1, 50)


@register("class_distribution", with_views("SELECT split, label, count(*) AS n FROM s GROUP BY ALL", "labeled_text",
                                           extra={"s": _THREE}))
def q_class_distribution(spark, d):
    """rows per label and split."""
    return A.class_distribution(_three(spark, d), ("split",))


@register("balance_plan", with_views("""
SELECT label, n, max(n) OVER () AS max_n, min(n) OVER () AS min_n, max(n) OVER () - n AS to_add,
       n - min(n) OVER () AS to_drop
FROM (SELECT label, count(*) AS n FROM labeled_text GROUP BY label)""", "labeled_text"))
def q_balance_plan(spark, d):
    """per class, rows to add or drop to balance the classes."""
    return A.balance_plan(tb.labeled_text(spark, d))


@register("set_difference", """
SELECT DISTINCT trim(split_part(line, '=', 1)) AS name
FROM (SELECT lower(split_part(text, ' ', 1)) || '=' || CAST(doc_id AS VARCHAR) AS line FROM documents WHERE lang = 'en')
WHERE contains(line, '=')
EXCEPT
SELECT DISTINCT trim(split_part(line, '=', 1))
FROM (SELECT lower(split_part(text, ' ', 1)) || '=' || CAST(doc_id AS VARCHAR) AS line FROM documents WHERE lang = 'fr')
WHERE contains(line, '=')""")
def q_set_difference(spark, d):
    """names of ``name=version`` lines in the English set and not in the French one."""
    docs = tb.read(spark, d, "documents")
    line = F.concat(F.lower(F.split_part(F.col("text"), F.lit(" "), F.lit(1))), F.lit("="), F.col("doc_id").cast("string"))
    a = docs.where(F.col("lang") == "en").select(line.alias("line"))
    b = docs.where(F.col("lang") == "fr").select(line.alias("line"))
    return A.set_difference(a, b)


LEARNING_RATES = [1e-5, 3e-5, 5e-5]


@register("param_grid", with_views(f"""
SELECT m.model, t.model_type, lr.learning_rate
FROM (SELECT DISTINCT model FROM raw_predictions) m
CROSS JOIN (SELECT DISTINCT model_type FROM raw_predictions) t
CROSS JOIN (SELECT unnest([{', '.join(repr(x) for x in LEARNING_RATES)}]) AS learning_rate) lr""", "raw_predictions"))
def q_param_grid(spark, d):
    """every combination of the models and model types seen in the
    predictions with a list of learning rates."""
    rp = tb.raw_predictions(spark, d)
    dims = A.product([rp.select("model").distinct(), rp.select("model_type").distinct()])
    grid = A.param_grid({"learning_rate": LEARNING_RATES}, spark).drop("grid_idx")
    return A.product([dims, grid]).select("model", "model_type", "learning_rate")


@register("best_run", with_views(f"""
SELECT model, model_type, dataset, {r6('accuracy')} AS accuracy
FROM ({tallies_sql('predictions', ['model', 'model_type', 'dataset'])})
ORDER BY accuracy DESC, model, model_type, dataset LIMIT 1""", "predictions"))
def q_best_run(spark, d):
    """the most accurate run; ties go to the first run in grid order."""
    m = ev.overall_metrics(tb.predictions(spark, d))
    return A.best_run(m, "accuracy", ("model", "model_type", "dataset")).select(*ev.RUN, "accuracy")
