"""C12 with learned boundaries: abbreviations and sentence starters counted in the corpus.

Unsupervised, after Kiss and Strunk (2006).  A word type is an abbreviation if a final period
follows it far more often than chance, the more so the shorter it is and the more periods it holds,
the less the more often it stands without one.  A sentence starter is a type that follows periods
of other words more often than chance.  Both are learned by aggregates over the words of the whole
corpus and then applied inside the row, as a constant of bounded size."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonality.operators.augment import constant_map, look_up
from tonality.operators.stats import written

# The published thresholds of the abbreviation and the starter score, and the
# probability that a period follows an abbreviation.
ABBREVIATION_SCORE, STARTER_SCORE, FOLLOWS = 0.3, 30.0, 0.99
#: Types kept of each kind, best scores first: the size of the constant.
MOST_TYPES = 10_000

CORE = r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}.]+$"
TYPE = r"^\p{L}+(\.\p{L}+)*\.?$"
STRONG_END, PERIOD_END = r"""[!?]["')\]]*$""", r"""\.["')\]]*$"""
UPPER = r"^[^\p{L}\p{N}]*\p{Lu}"
_CUT = "\u0001"


def _core(w: Column) -> Column:
    return F.regexp_replace(w, CORE, "")


def word_type(w: Column) -> Column:
    """The lower-cased type of a word without its final period; null for others than words."""
    core = _core(w)
    return F.when(core.rlike(TYPE), F.lower(F.regexp_replace(core, r"\.$", "")))


def _words(text: str) -> Column:
    return F.regexp_extract_all(F.col(text), F.lit(r"\S+"), 0)


def learn_abbreviations(texts: DataFrame, text: str = "text") -> DataFrame:
    """(type, n_period, n_plain, score): the types that pass for abbreviations."""
    w = texts.select(F.explode_outer(_words(text)).alias("w")).where(F.col("w").isNotNull())
    # words of a form are counted first, so the patterns run once for each form
    forms = w.groupBy("w").agg(F.count(F.lit(1)).alias("_n"))
    forms = forms.select("_n", word_type(F.col("w")).alias("type"), _core(F.col("w")).endswith(".").alias("_p"))
    types = written(forms.groupBy("type").agg(F.sum(F.when(F.col("_p"), F.col("_n")).otherwise(0)).alias("n_period"),
                                              F.sum(F.when(~F.col("_p"), F.col("_n")).otherwise(0)).alias("n_plain")), "word-types")
    total = types.agg(F.sum("n_period").alias("_b"), F.sum(F.col("n_period") + F.col("n_plain")).alias("_all"))
    t = types.where(F.col("type").isNotNull() & (F.col("n_period") > 0)).crossJoin(F.broadcast(total))  # one row
    p = F.col("_b") / F.col("_all")
    k, rest = F.col("n_period"), F.col("n_plain")
    plain = F.when(rest > 0, rest * (F.log(F.lit(1 - FOLLOWS)) - F.log(1 - p))).otherwise(0.0)
    ratio = 2 * (k * (F.log(F.lit(FOLLOWS)) - F.log(p)) + plain)
    letters = F.length(F.replace("type", F.lit("."), F.lit("")))
    periods = F.length("type") - letters + 1
    score = ratio * F.exp(-letters) * periods * F.pow(letters.cast("double"), -rest.cast("double"))
    return t.select("type", "n_period", "n_plain", score.alias("score")).where(F.col("score") >= ABBREVIATION_SCORE)


def _constant(types: DataFrame) -> Column:
    best = types.orderBy(F.desc("score"), "type").limit(MOST_TYPES).select("type").collect()
    return constant_map({r["type"]: 1 for r in best})


def learn_starters(texts: DataFrame, abbreviations: DataFrame, text: str = "text") -> DataFrame:
    """(type, n_start, n_all, score): capitalised types that follow other words' periods."""
    known = _constant(abbreviations)
    ws = texts.select(_words(text).alias("ws"))

    def follows(w: Column, i: Column) -> Column:
        before = F.get("ws", i - 1)
        return (i > 0) & before.rlike(PERIOD_END) & look_up(known, F.coalesce(word_type(before), F.lit(""))).isNull()

    pairs = ws.select(F.explode_outer(F.transform("ws", lambda w, i: F.struct(
        w.alias("w"), follows(w, i).alias("_after")))).alias("x")).where(F.col("x").isNotNull()).select("x.*")
    forms = pairs.groupBy("w", "_after").agg(F.count(F.lit(1)).alias("_n"))
    forms = forms.select("_n", "_after", word_type(F.col("w")).alias("type"), F.col("w").rlike(UPPER).alias("_upper"))
    types = written(forms.groupBy("type").agg(
        F.sum(F.when(F.col("_after") & F.col("_upper"), F.col("_n")).otherwise(0)).alias("n_start"),
        F.sum(F.when(F.col("_after"), F.col("_n")).otherwise(0)).alias("_after"), F.sum("_n").alias("n_all")), "start-types")
    total = types.agg(F.sum("_after").alias("_b"), F.sum("n_all").alias("_all"))
    t = types.where(F.col("type").isNotNull() & (F.col("n_start") > 0)).crossJoin(F.broadcast(total))  # one row
    p, q = F.col("_b") / F.col("_all"), F.col("n_start") / F.col("n_all")
    other = F.col("n_all") - F.col("n_start")
    rest = F.when(other > 0, other * (F.log(1 - q) - F.log(1 - p))).otherwise(0.0)
    score = 2 * (F.col("n_start") * (F.log(q) - F.log(p)) + rest)
    return t.where(q > p).select("type", "n_start", "n_all", score.alias("score")).where(F.col("score") >= STARTER_SCORE)


def sentences(text: str, abbreviations: DataFrame, starters: DataFrame) -> Column:
    """Array of sentences, their words joined by single spaces.  A word ends one with ! or ?, with
    a period unless it is an abbreviation or an initial, and at the end of the text; after an
    abbreviation only a capitalised starter begins a new one."""
    known, start = _constant(abbreviations), _constant(starters)

    def is_end(w: Column, after: Column) -> Column:
        kind = F.coalesce(word_type(w), F.lit(""))
        open_ = look_up(known, kind).isNotNull() | (F.length(kind) == 1)
        begins = after.rlike(UPPER) & look_up(start, F.coalesce(word_type(after), F.lit(""))).isNotNull()
        return w.rlike(STRONG_END) | (w.rlike(PERIOD_END) & (~open_ | F.coalesce(begins, F.lit(False))))

    def cut(ws: Column) -> Column:
        marked = F.transform(ws, lambda w, i: F.when(is_end(w, F.get(ws, i + 1)), F.concat(w, F.lit(_CUT))).otherwise(w))
        return F.filter(F.split(F.array_join(marked, " "), _CUT + " ?"), lambda s: s != "")

    return F.transform(F.array(_words(text)), cut)[0]
