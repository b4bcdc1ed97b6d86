"""Label encoding: every label space of the reference as a literal map.

Lookups use ``element_at`` on literal maps, so they are projections (no join,
no shuffle); an unknown value becomes null and callers route it to a
quarantine output.
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Label spaces (canonical is 0 negative, 1 neutral, 2 positive).
CANONICAL_NAMES = {"negative": 0, "neutral": 1, "positive": 2}
ANNOTATION_NAMES = {"NEGATIVE": 0, "NEUTRAL": 1, "POSITIVE": 2}
FAMILY_NAMES = {
    "finBert": {"positive": 0, "negative": 1, "neutral": 2},
}
# int -> canonical int, by named source space
REMAPS = {
    "finbert": {0: 2, 1: 0, 2: 1},
    "distilbert": {0: 1, 1: 0, 2: 2},
    "stock_tweets": {1: 2, -1: 0},
    "synthetic_tweets": {0: 1, 1: 2, 2: 0},
    "twitter_news": {0: 0, 1: 2, 2: 1},
    "two_class": {0: 1, 1: 2},
    "canonical": {0: 0, 1: 1, 2: 2},
}
# canonical -> other spaces
TO_MARKET = {0: -1, 1: 0, 2: 1}
TO_TWO_CLASS = {1: 0, 2: 1}
# prediction-id remap by model family (raw model class id -> canonical)
FAMILY_PREDICTION_REMAP = {
    "finBert": {0: 2, 1: 0, 2: 1},
    "distilBert": {0: 1, 1: 0, 2: 2},
}
SCORE_LOW, SCORE_HIGH = -0.4, 0.5


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def literal_map(d: dict) -> Column:
    keys = list(d.keys())
    return F.map_from_arrays(F.array(*[F.lit(k) for k in keys]),
                             F.array(*[F.lit(d[k]) for k in keys]))


def label_from_score(col, lo: float = SCORE_LOW, hi: float = SCORE_HIGH) -> Column:
    """Score <= lo -> 0, <= hi -> 1, else 2 (both bounds inclusive)."""
    c = _c(col)
    return F.when(c <= lo, 0).when(c <= hi, 1).when(c.isNotNull(), 2).cast("int")


def label_from_name(col, names: dict | None = None) -> Column:
    """Label name -> int (canonical by default); unknown -> null."""
    return F.element_at(literal_map(names or CANONICAL_NAMES), F.lower(_c(col)) if names is None else _c(col)).cast("int")


def label_remap(col, from_space: str, to: dict | None = None) -> Column:
    """D3: int -> int by a named mapping (unknown -> null)."""
    mapping = to if to is not None else REMAPS[from_space]
    return F.try_element_at(literal_map(mapping), _c(col).cast("int")).cast("int")


def label_unanimous_map(col) -> Column:
    """Decode ``{'A': 'neutral', ...}``; label only when all values agree.

    Empty or malformed maps and unknown sentiment names give null."""
    m = F.from_json(F.regexp_replace(_c(col), "'", '"'), "map<string,string>")
    vals = F.array_distinct(F.transform(F.map_values(m), lambda v: F.lower(F.trim(v))))
    return F.when(F.size(vals) == 1, F.try_element_at(literal_map(CANONICAL_NAMES), vals[0])).cast("int")


def label_from_generated(col) -> Column:
    """Generated answer -> 2 / 0; anything else, ``Error`` included, -> 1."""
    from tonality.functions.text import extract_answer
    ans = extract_answer(col)
    return F.when(ans == "positive", 2).when(ans == "negative", 0).otherwise(1).cast("int")


def argmax(col) -> Column:
    """H1: index of the largest element; the first index wins ties."""
    c = _c(col)
    return (F.array_position(c, F.array_max(c)) - 1).cast("int")


def remap_prediction(raw, family) -> Column:
    """Raw model class id -> canonical by model family (identity otherwise)."""
    per_family = F.try_element_at(
        F.create_map(*[x for fam, m in FAMILY_PREDICTION_REMAP.items() for x in (F.lit(fam), literal_map(m))]),
        _c(family))
    return F.coalesce(F.try_element_at(per_family, _c(raw)), _c(raw)).cast("int")
