"""Benchmark decontamination by pigeonhole edit matching.

A test item of m characters with an error budget of k edits is cut into k + 1 pieces: any
stretch of text within k edits of the item holds at least one piece unchanged.  All pieces
go into one Aho-Corasick automaton; each exact piece hit names a window of the document
where the item would have to lie, and Myers' bit-parallel algorithm finds the smallest
edit distance there.

Both sides are compared in lower case with every run of other characters than letters and
digits as one space.  The budget is ``floor(rate * m)``.

Defined results: null or empty texts and items match nothing; an item whose pieces would
be shorter than ``MIN_PIECE`` characters gets a smaller budget; repeated items and repeated
documents each keep one row per (doc_id, item_id), with the smallest distance and then the
smallest end; other columns are ignored.
"""
from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonality.llm.common import scalar, ship, table

ERROR_RATE = 0.08
MIN_PIECE = 10
#: Characters of test items in one automaton; more items are searched in several passes.
PASS_CHARS = 2_000_000

_WORDS = re.compile(r"[^\W_]+")
OUT = "doc_id long, item_id long, edits long, n_chars long, end long"


def normal(text: str | None) -> str:
    return " ".join(_WORDS.findall(text.lower())) if text else ""


def budget(m: int, rate: float = ERROR_RATE) -> int:
    return max(0, min(int(rate * m), m // MIN_PIECE - 1))


def pieces(item: str, k: int) -> list[tuple[int, str]]:
    """k + 1 consecutive pieces of nearly the same length, with their offsets."""
    cuts = [len(item) * i // (k + 1) for i in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def masks(item: str) -> dict[str, int]:
    out: dict[str, int] = defaultdict(int)
    for i, c in enumerate(item):
        out[c] |= 1 << i
    return dict(out)


def closest(peq: dict[str, int], m: int, text: str) -> tuple[int, int]:
    """(smallest edit distance of the item to any stretch of ``text``, end of the first such
    stretch), by Myers' bit-vectors; Python's integers hold items of any length."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, end = full, 0, m, m, 0
    for j, c in enumerate(text):
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (full & ~(xh | pv))
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
            if score < best:
                best, end = score, j + 1
        ph <<= 1
        mh <<= 1
        pv = (mh | ~(xv | ph)) & full
        mv = ph & xv & full
    return best, end


class Matcher:
    """The automaton of one pass and what its pieces stand for."""

    def __init__(self, items: list[tuple[int, str]], rate: float):
        import ahocorasick
        self.items = []
        where = defaultdict(list)
        for item_id, text in items:
            k = budget(len(text), rate)
            self.items.append((item_id, masks(text), len(text), k))
            for offset, piece in pieces(text, k):
                where[piece].append((len(self.items) - 1, offset))
        self.auto = ahocorasick.Automaton()
        for piece, uses in where.items():
            self.auto.add_word(piece, (len(piece), uses))
        self.auto.make_automaton()

    def find(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item_id, edits, item length, end) of every item within its budget."""
        starts = defaultdict(set)
        for last, (n, uses) in self.auto.iter(text):
            for which, offset in uses:
                starts[which].add(last - n + 1 - offset)
        out = []
        for which, places in starts.items():
            item_id, peq, m, k = self.items[which]
            spans: list[list[int]] = []
            for s in sorted(places):  # the item would lie in [s - k, s + m + k)
                if spans and s - k <= spans[-1][1]:
                    spans[-1][1] = s + m + k
                else:
                    spans.append([s - k, s + m + k])
            best = None
            for a, b in spans:
                a = max(0, a)
                d, end = closest(peq, m, text[a:b])
                if d <= k and (best is None or d < best[0]):
                    best = (d, a + end)
            if best:
                out.append((item_id, best[0], m, best[1]))
        return out


def _found(docs: DataFrame, benchmark: DataFrame, rate: float, pass_chars: int) -> DataFrame:
    """(doc_id, _row, item_id, edits, n_chars, end): each item that a row holds within the
    item's budget; ``_row`` is xxhash64 of the text.

    Each pass takes a bounded part of the test items to the executors and reads all
    documents; the number of passes follows from the items' size."""
    spark = docs.sparkSession
    ship(spark)
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where(F.length("text") > 0)
    total = scalar(items, F.sum(F.length("text")))[0] or 0
    passes = max(1, -(-int(total) // pass_chars))
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("doc_id"), F.xxhash64("text").alias("_row"),
                        F.col("doc_id").cast("long").isNull().alias("_none"), "text").where(F.length("text") > 0)
    parts = []
    for p in range(passes):
        rows = items.where(F.pmod(F.xxhash64("text"), F.lit(passes)) == p).collect()
        held = spark.sparkContext.broadcast(sorted({(r.item_id, n) for r in rows if (n := normal(r.text))}))

        def scan(batches: Iterator[pd.DataFrame], held=held) -> Iterator[pd.DataFrame]:
            matcher = Matcher(held.value, rate) if held.value else None
            for pdf in batches:
                found = [(*own, *m) for *own, t in zip(pdf["_row"], pdf["_none"], pdf["doc_id"], pdf["text"])
                         for m in matcher.find(normal(t))] if matcher else []
                yield pd.DataFrame(found, columns=["_row", "_none", "doc_id", "item_id", "edits", "n_chars", "end"])

        parts.append(texts.mapInPandas(scan, f"_row long, _none boolean, {OUT}"))
    found = parts[0]
    for more in parts[1:]:
        found = found.unionByName(more)
    return found.withColumn("doc_id", F.when(~F.col("_none"), F.col("doc_id"))).drop("_none")  # long ids stay exact beside nulls


def find_leaks(docs: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE, pass_chars: int = PASS_CHARS) -> DataFrame:
    """(doc_id, item_id, edits, n_chars, end): each item that a document holds within the
    item's budget; ``end`` counts characters of the normal form."""
    found = _found(docs, benchmark, rate, pass_chars)
    best = F.min(F.struct("edits", "end", "n_chars")).alias("b")
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "b.edits", "b.n_chars", "b.end")


def remove_leaks(docs: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE, pass_chars: int = PASS_CHARS) -> DataFrame:
    """``docs`` without the rows that hold a test item.  Each row is judged by its own text, also
    if its ``doc_id`` is null or repeats."""
    leaked = _found(docs, benchmark, rate, pass_chars).select(F.col("doc_id").alias("_leaked"), F.col("_row").alias("_hash")).distinct()
    same = docs["doc_id"].cast("long").eqNullSafe(leaked["_leaked"]) & (F.xxhash64(docs["text"]) == leaked["_hash"])
    return docs.join(leaked, same, "left_anti")


def op10_decontaminate(spark, sf_dir: str) -> DataFrame:
    """All benchmark items against all documents."""
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
