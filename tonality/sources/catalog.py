"""A4: the dataset catalogue.  Each named corpus of the reference is a set of rows of one
lazy frame over the driver tables, with its own native columns, cleaning steps and label
rule; ``dataset_catalog`` conforms them to ``(dataset, sample_id, text, label)`` in the
canonical label space.

A source group (the source number divided by 5) feeds one base corpus with its
back-translated and negation-edited copies, so all corpora come from a single scan and
join: each row is unfolded into the corpora of its group by a projection."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tonality.functions import labels as L
from tonality.functions import text as X
from tonality.operators.augment import negation_antonym
from tonality.operators.labeling import label_universal
from tonality.sources.tables import ANTONYMS, labeled_text

# Corpus name -> (source group, label rule, cleaning steps).  The first thirteen
# are numbered 0 to 12 by the reference.
CATALOG = {
    "fiqa": (0, "score", ("strip_urls",)),
    "phrasebank": (1, "name", ()),
    "stock_tweets": (2, "pm1", ("remove_user",)),
    "aspect": (3, "decisions", ()),
    "instruction": (3, "output", ()),
    "back_translated_fiqa": (0, "score", ()),
    "back_translated_phrasebank": (1, "name", ("unescape", "basic_chars")),
    "back_translated_stock_tweets": (2, "pm1", ("unescape", "basic_chars")),
    "back_translated_aspect": (3, "decisions", ("unescape",)),
    "negation_fiqa": (0, "score", ()),
    "negation_phrasebank": (1, "name", ()),
    "negation_stock_tweets": (2, "pm1", ()),
    "negation_aspect": (3, "decisions", ()),
    "synthetic_tweets": (3, "synthetic_tweets", ()),
}
LABEL_NAMES = ["negative", "neutral", "positive"]
# what a translation hop and a negated sentence leave in a text
BACK_TRANSLATED = " It&#39;s the same – they say."
NEGATED = " They do not like it."
NATIVE = ["score", "label_name", "label", "decisions", "output"]
_STEPS = {"strip_urls": X.strip_urls, "remove_user": lambda c: X.remove_whole_word(c, "user"),
          "unescape": X.unescape_apostrophe, "basic_chars": X.keep_basic_chars}


def source_group(col: str = "dataset") -> Column:
    return (F.regexp_extract(F.col(col), r"src(\d+)", 1).cast("int") / 5).cast("int")


def _native(rule: str) -> dict[str, Column]:
    """The label columns as the reference finds them in a corpus of this rule."""
    names = F.array(*[F.lit(n) for n in LABEL_NAMES])
    name = lambda c: F.element_at(names, c + 1)
    if rule == "score":
        return {"score": F.col("score")}
    if rule == "name":
        return {"label_name": name(F.col("label"))}
    if rule == "pm1":  # no neutral class in this corpus
        return {"label": F.when(F.col("label") == 2, 1).otherwise(-1).cast("int")}
    if rule == "decisions":  # a map text; every third row has two opinions
        other = F.when(F.col("sample_id") % 3 == 0, (F.col("label") + 1) % 3).otherwise(F.col("label"))
        return {"decisions": F.concat(F.lit("{'A': '"), name(F.col("label")), F.lit("', 'B': '"), name(other.cast("int")), F.lit("'}"))}
    if rule == "output":  # a generated answer
        return {"output": F.concat(F.lit("Mostly "), F.upper(name(F.col("label"))), F.lit(" I think"))}
    inverse = {v: k for k, v in L.REMAPS[rule].items()}
    return {"label": L.label_remap("label", "", inverse)}


def raw_datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every corpus as the reference reads it: (dataset, sample_id, text, native columns)."""
    lt = labeled_text(spark, sf_dir).withColumn("_group", source_group())
    # the score corpus keeps headlines only, the stock corpus has no neutral class
    lt = lt.where((F.col("_group") != 0) | (F.col("type") == "headline")).where((F.col("_group") != 2) | (F.col("label") != 1))
    lt = negation_antonym(lt.withColumn("_negated", F.concat("text", F.lit(NEGATED))), ANTONYMS, "_negated")
    types = dict(zip(NATIVE, ["double", "string", "int", "string", "string"]))

    def row(name: str, rule: str) -> Column:
        text = (F.col("_negated") if name.startswith("negation_") else
                F.concat("text", F.lit(BACK_TRANSLATED)) if name.startswith("back_translated_") else F.col("text"))
        native = _native(rule)
        return F.struct(F.lit(name).alias("dataset"), text.alias("text"),
                        *[native.get(c, F.lit(None)).cast(t).alias(c) for c, t in types.items()])

    rows = F.when(F.lit(False), None)
    for g in sorted({g for g, _, _ in CATALOG.values()}):
        rows = rows.when(F.col("_group") == g, F.array(*[row(n, rule) for n, (own, rule, _) in CATALOG.items() if own == g]))
    return lt.select("sample_id", F.inline(rows)).select("dataset", "sample_id", "text", *NATIVE)


def clean(df: DataFrame) -> DataFrame:
    """Each corpus's own cleaning steps, in one projection."""
    text = F.when(F.lit(False), None)
    for name, (_, _, steps) in CATALOG.items():
        c = F.col("text")
        for step in steps:
            c = _STEPS[step](c)
        text = text.when(F.col("dataset") == name, c) if steps else text
    return df.withColumn("text", text.otherwise(F.col("text")))


def dataset_catalog(spark: SparkSession, sf_dir: str, name: str | None = None) -> DataFrame:
    """A4: one corpus (or all), cleaned and labelled canonically: (dataset, sample_id, text, label)."""
    raw = raw_datasets(spark, sf_dir)
    if name is not None:
        raw = raw.where(F.col("dataset") == name)
    return label_universal(clean(raw), universal_rules()).select("dataset", "sample_id", "text", "label")


def universal_rules() -> dict[str, str]:
    return {name: rule for name, (_, rule, _) in CATALOG.items()}
