"""Line dedup over overlapping windows of three lines.

Every three consecutive lines of a text are hashed to 128 bits.  Where a window occurs more
than once in the whole table, all occurrences but the first (by document, then position) are
removed: the lines that any such occurrence covers are merged per document and dropped.

Lines are what stands between line feeds, so empty lines count.  Defined results: a null text
counts as empty; a text of fewer than three lines stays as it is; windows within one document
count like those of different ones; rows that repeat both ``doc_id`` and text keep and lose
the same lines, and rows with the same ``doc_id`` and different texts follow each other by
the text's hash; a null ``doc_id`` comes first; other columns are ignored.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonality.llm.common import table, text_or_empty

WIDTH = 3


def _lines():
    return F.split("text", "\n", -1)


def _windows(width: int):
    """(position, two 64-bit hashes) of each window; each hash covers all its lines."""
    first = F.transform(F.col("_lines"), lambda x: F.xxhash64(x))
    second = F.transform(F.col("_lines"), lambda x: F.xxhash64(F.lit(width), x))
    pair = F.arrays_zip(first.alias("a"), second.alias("b"))

    def window(i):
        parts = [F.col("_hashes")[i + F.lit(j)] for j in range(width)]
        return F.struct(i.alias("pos"), F.xxhash64(*[p["a"] for p in parts]).alias("h1"),
                        F.xxhash64(*[p["b"] for p in parts]).alias("h2"))

    return pair, F.transform(F.sequence(F.lit(0), F.size("_hashes") - F.lit(width)), window)


def remove_repeated_windows(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, text, n_lines, n_removed) for every row of ``docs``."""
    base = docs.select("doc_id", text_or_empty().alias("text")).withColumn("_row", F.xxhash64("text"))
    hashes, windows = _windows(width)
    places = (base.select("doc_id", "_row", _lines().alias("_lines")).where(F.size("_lines") >= width)
              .select("doc_id", "_row", hashes.alias("_hashes"))
              .select("doc_id", "_row", F.explode(windows).alias("_w"))
              .select("doc_id", "_row", "_w.pos", "_w.h1", "_w.h2"))
    place = F.struct("doc_id", "_row", "pos")
    firsts = (places.groupBy("h1", "h2").agg(F.min(place).alias("_first"), F.count(F.lit(1)).alias("_n"))
              .where(F.col("_n") > 1).select("h1", "h2", "_first"))
    later = places.join(firsts, ["h1", "h2"]).where(place != F.col("_first"))
    covered = later.groupBy("doc_id", "_row").agg(F.collect_set("pos").alias("_at"))  # at most the lines of one text
    covered = covered.select(F.col("doc_id").alias("_d"), F.col("_row").alias("_r"), F.array_distinct(F.flatten(
        F.transform("_at", lambda p: F.sequence(p, p + F.lit(width - 1))))).alias("_gone"))
    out = base.join(covered, base["doc_id"].eqNullSafe(covered["_d"]) & (base["_row"] == covered["_r"]), "left")
    lines = _lines()
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - F.lit(1)), F.col("_gone"))
    text = F.array_join(F.transform(kept, lambda i: F.get(F.col("_lines"), i)), "\n")
    return out.withColumn("_lines", lines).select(
        "doc_id", F.when(F.col("_gone").isNull(), F.col("text")).otherwise(text).alias("text"),
        F.size("_lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("_gone"), F.lit(0)).cast("long").alias("n_removed"))


def op3_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Every document without its later occurrences of three-line windows."""
    return remove_repeated_windows(table(spark, sf_dir, "documents"))


SQL = """
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
w AS (
  SELECT doc_id, i - 1 AS pos, ls[i] || chr(10) || ls[i + 1] || chr(10) || ls[i + 2] AS win
  FROM (SELECT doc_id, ls, unnest(range(1, len(ls) - 1)) AS i FROM d WHERE len(ls) >= 3)),
r AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY win ORDER BY doc_id, pos) AS n FROM w),
gone AS (SELECT DISTINCT doc_id, pos + k AS at FROM r, (VALUES (0), (1), (2)) v(k) WHERE n > 1),
l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(0, len(ls))) AS at FROM d),
k AS (
  SELECT l.doc_id, string_agg(CASE WHEN g.at IS NULL THEN l.line END, chr(10) ORDER BY l.at) AS text,
         count(*) AS n_lines, count(g.at) AS n_removed
  FROM l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.at = g.at GROUP BY l.doc_id)
SELECT doc_id, coalesce(text, '') AS text, n_lines, n_removed FROM k
"""
