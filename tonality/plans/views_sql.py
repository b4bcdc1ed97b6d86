"""The views of ``tonality.sources.tables`` written as DuckDB SQL common table
expressions, for the oracle queries."""
from __future__ import annotations

from tonality.sources.tables import ANNOTATION_LABELS, PROBE_FRAGMENTS, run_grid


def H(expr: str) -> str:
    """SQL twin of ``hashing.hash32`` for an already-built key string."""
    return f"(('0x' || substr(md5({expr}), 1, 8))::BIGINT)"


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _ds(col: str) -> str:
    return f"CASE WHEN {H(f"'ds:' || CAST({col} AS VARCHAR)")} % 4 = 0 THEN 'eval_all_agree' ELSE 'eval_75_consent' END"


_RUNS = ", ".join(f"({i}, {_lit(m)}, {_lit(t)})" for i, m, t in run_grid())
_FAMILY = ("CASE WHEN lower(model) LIKE '%distilroberta%' THEN 'distilRoberta' "
           "WHEN lower(model) LIKE '%distilbert%' THEN 'distilBert' "
           "WHEN lower(model) LIKE '%finbert%' THEN 'finBert' "
           "WHEN lower(model) LIKE '%electra%' THEN 'Electra' END")
_REMAP = ("CASE WHEN fam = 'finBert' THEN [2, 0, 1][raw + 1] "
          "WHEN fam = 'distilBert' THEN [1, 0, 2][raw + 1] ELSE raw END")

VIEWS: dict[str, str] = {}

VIEWS["labeled_text"] = f"""
SELECT d.doc_id AS sample_id, d.source AS dataset,
       CASE WHEN d.lang = 'en' THEN 'headline' ELSE 'article' END AS type, d.text,
       ({H("'score:' || CAST(d.doc_id AS VARCHAR)")} - 2147483648) / 2147483648.0 AS score,
       CAST(CASE WHEN l.toxic = 1 THEN 0 WHEN l.quality = 1 THEN 2 ELSE 1 END AS INTEGER) AS label
FROM documents d JOIN labels l ON d.doc_id = l.doc_id"""

VIEWS["texts"] = "SELECT doc_id AS sample_id, source AS dataset, text FROM documents"

_frags = "[" + ", ".join(_lit(f) for f in PROBE_FRAGMENTS) + "]"
VIEWS["probe_texts"] = f"""
SELECT doc_id AS sample_id, text || {_frags}[CAST(doc_id % {len(PROBE_FRAGMENTS)} AS INTEGER) + 1] AS text
FROM documents"""

_names = "[" + ", ".join(_lit(n) for n in ANNOTATION_LABELS) + "]"
_lab = []
for k in range(1, 5):
    v = H(f"'ann:{k}:' || CAST(doc_id AS VARCHAR)")
    base = H("'ann:' || CAST(doc_id AS VARCHAR)")
    e = f"{_names}[CAST(CASE WHEN {v} % 10 < 6 THEN {base} % 3 ELSE {v} % 3 END AS INTEGER) + 1]"
    if k == 4:
        e = f"CASE WHEN {H("'ann:null:' || CAST(doc_id AS VARCHAR)")} % 25 <> 0 THEN {e} END"
    _lab.append(f"{e} AS labeler_{k}")
VIEWS["annotations"] = f"SELECT doc_id AS sample_id, text, {', '.join(_lab)} FROM documents"

VIEWS["eval_samples"] = f"""
SELECT {_ds('e.vec_id')} AS dataset, e.vec_id AS sample_id, d.text, CAST(e.label % 3 AS INTEGER) AS label
FROM embeddings e JOIN documents d ON e.vec_id = d.doc_id"""

VIEWS["raw_predictions"] = f"""
SELECT r.model, r.model_type, {_ds('e.vec_id')} AS dataset, e.vec_id AS sample_id,
       CAST(list_slice(e.embedding, 3 * r.run_idx + 1, 3 * r.run_idx + 3) AS DOUBLE[]) AS logits
FROM embeddings e CROSS JOIN (VALUES {_RUNS}) r(run_idx, model, model_type)
WHERE e.vec_id IN (SELECT doc_id FROM documents)"""

VIEWS["predictions"] = f"""
SELECT model, model_type, dataset, sample_id, text, text_length, true_label, logits,
       CAST({_REMAP} AS INTEGER) AS predicted_label
FROM (
  SELECT *, CAST(list_position(logits, list_max(logits)) - 1 AS INTEGER) AS raw, {_FAMILY} AS fam
  FROM (
    SELECT r.model, r.model_type, {_ds('e.vec_id')} AS dataset, e.vec_id AS sample_id, d.text,
           CAST(len(regexp_extract_all(d.text, '\\S+')) AS INTEGER) AS text_length,
           CAST(e.label % 3 AS INTEGER) AS true_label,
           CAST(list_slice(e.embedding, 3 * r.run_idx + 1, 3 * r.run_idx + 3) AS DOUBLE[]) AS logits
    FROM embeddings e JOIN documents d ON e.vec_id = d.doc_id
    CROSS JOIN (VALUES {_RUNS}) r(run_idx, model, model_type)))"""

VIEWS["secondary_predictions"] = """
SELECT vec_id AS sample_id,
       CAST(list_position(CAST(list_slice(embedding, 61, 62) AS DOUBLE[]),
            list_max(CAST(list_slice(embedding, 61, 62) AS DOUBLE[]))) - 1 AS INTEGER) AS secondary_label
FROM embeddings"""

VIEWS["feed"] = f"""
SELECT 'https://news.example/a/' || CAST(event_id AS VARCHAR) AS url,
       strftime(ts, '%Y%m%dT%H%M%S') AS time_published,
       [{{'ticker': upper(event_type), 'relevance_score': printf('%.4f', value / 100)}},
        {{'ticker': 'IDX', 'relevance_score': printf('%.4f', ({H("'rel:' || CAST(event_id AS VARCHAR)")} % 10000) / 10000.0)}}]
         AS ticker_sentiment
FROM events"""

VIEWS["series"] = """
SELECT symbol, settlement_date, current_short, previous_short, current_short - previous_short AS chg,
       CASE WHEN previous_short = 0 THEN NULL ELSE (current_short - previous_short) * 100.0 / previous_short END
         AS pct_change
FROM (
  SELECT *, coalesce(lag(current_short) OVER (PARTITION BY symbol ORDER BY settlement_date), current_short)
           AS previous_short
  FROM (SELECT upper(event_type) AS symbol, CAST(ts AS DATE) AS settlement_date,
               SUM(CAST(round(value * 100) AS BIGINT)) AS current_short
        FROM events GROUP BY 1, 2))"""

VIEWS["prices"] = """
SELECT o_orderpriority AS symbol, CAST(o_orderdate AS DATE) AS date,
       min_by(o_totalprice, o_orderkey) AS open, max_by(o_totalprice, o_orderkey) AS close,
       count(*) AS volume
FROM orders GROUP BY 1, 2"""


def with_views(body: str, *names: str, extra: dict[str, str] | None = None) -> str:
    """``WITH`` the named views (and extra CTEs, in order) then ``body``."""
    parts = [f"{n} AS ({VIEWS[n]})" for n in names]
    for k, v in (extra or {}).items():
        parts.append(f"{k} AS ({v})")
    return ("WITH " + ",\n".join(parts) + "\n" + body) if parts else body


def tallies_sql(source: str, keys: list[str], truth: str = "true_label", pred: str = "predicted_label",
                extra: str = "") -> str:
    """SQL twin of ``evaluate.label_tallies``: counts, per-class P/R/F1, macro and
    weighted averages and accuracy per group."""
    k = ", ".join(keys)
    cnt = [f"count(*) AS n", f"count_if({truth} = {pred}) AS n_correct"]
    for c in (0, 1, 2):
        cnt += [f"count_if({truth} = {c} AND {pred} = {c}) AS tp_{c}", f"count_if({truth} = {c}) AS true_{c}",
                f"count_if({pred} = {c}) AS pred_{c}"]
    per = []
    for c in (0, 1, 2):
        per += [f"coalesce(tp_{c} / nullif(pred_{c}, 0), 0.0) AS precision_{c}",
                f"coalesce(tp_{c} / nullif(true_{c}, 0), 0.0) AS recall_{c}",
                f"coalesce(2 * tp_{c} / nullif(true_{c} + pred_{c}, 0), 0.0) AS f1_{c}",
                f"CASE WHEN true_{c} + pred_{c} > 0 THEN 1 ELSE 0 END AS present_{c}"]
    avg = []
    npres = "(present_0 + present_1 + present_2)"
    for m in ("precision", "recall", "f1"):
        avg.append(f"coalesce(({m}_0 * present_0 + {m}_1 * present_1 + {m}_2 * present_2) / nullif({npres}, 0), 0.0)"
                   f" AS macro_{m}")
        avg.append(f"coalesce(({m}_0 * true_0 + {m}_1 * true_1 + {m}_2 * true_2) / nullif(n, 0), 0.0) AS weighted_{m}")
    avg.append("coalesce(n_correct / nullif(n, 0), 0.0) AS accuracy")
    extra = (", " + extra) if extra else ""
    return (f"SELECT *, {', '.join(avg)} FROM (SELECT *, {', '.join(per)} FROM "
            f"(SELECT {k}, {', '.join(cnt)}{extra} FROM {source} GROUP BY {k}))")


def _prompt_sql(x: str) -> str:
    from tonality.functions.text import PROMPT_TEMPLATE
    pre, post = PROMPT_TEMPLATE.split("%s")
    return f"({_lit(pre)} || {x} || {_lit(post)})"


def _gen_view() -> str:
    from tonality.sources.tables import GENERATED_ANSWERS
    answers = "[" + ", ".join(_lit(a) for a in GENERATED_ANSWERS) + "]"
    h = H("'gen:' || CAST(doc_id AS VARCHAR)")
    return (f"SELECT doc_id AS sample_id, CASE WHEN {h} % 5 = 0 THEN text "
            f"ELSE {_prompt_sql('text')} || {answers}[CAST({h} % 4 AS INTEGER) + 1] END AS generated FROM documents")


VIEWS["generations"] = _gen_view()
VIEWS["aspects"] = f"""
SELECT sample_id, text AS Title,
  CASE {H("'asp:' || CAST(sample_id AS VARCHAR)")} % 8
    WHEN 0 THEN '{{}}'
    WHEN 1 THEN '{{''ENT_A'': '
    WHEN 2 THEN '{{''ENT_A'': ''bullish'', ''ENT_B'': ''' || lower(labeler_2) || '''}}'
    WHEN 3 THEN '{{''ENT_A'': ''' || lower(labeler_1) || '''}}'
    ELSE '{{''ENT_A'': ''' || lower(labeler_1) || ''', ''ENT_B'': ''' || lower(labeler_2) || '''}}' END AS Decisions
FROM annotations"""
