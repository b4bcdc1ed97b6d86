"""Phrase collocation mining by marginalising the longest windows.

Every word starts one window of ``MAX_WORDS`` lead columns, padded with nulls where its piece of
text ends.  Only these windows are counted; Spark's ROLLUP over (lang, w1, ..., w5) then sums them
for each shorter prefix, which gives the frequency of every phrase and, for the empty prefix, the
number of words.

A phrase cannot be more frequent than a part of it.  So a window may be padded from its first part of
up to ``PRUNED`` words that occurs less than ``least`` times, without changing the frequency of any
phrase that occurs ``least`` times.  A pass over the texts for each length finds such parts: 64-bit
hashes of those whose own parts are frequent are counted, and the frequent ones marked in a bitmap
of bounded size (``MAX_BITS``), which the next pass gets by broadcast.  A collision only leaves a window longer than
need be; it never changes a frequency.

Defined results: a null text counts as empty and a null ``lang`` as 'und'; rows that repeat each
other are counted each; ``doc_id`` and other columns are not read; no words give no rows.
"""
from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonality.llm.common import saved, ship, table, text_or_empty

MAX_WORDS = 5
LEAST = 100
#: Windows are padded at the first part of up to so many words that is too rare.
PRUNED = 3
TOP = 2000
#: Words of a block; a block holds whole texts, one at least.
BLOCK_WORDS = 4_000_000
MIN_BITS, MAX_BITS, BITS_EACH = 1 << 16, 1 << 28, 16

_UPPER, _LOWER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"
_ENDS = b".,;:!?\n\x0b\x0c\r"
_FOLD = bytes.maketrans(_UPPER + b"\t" + _ENDS, _LOWER + b" " + b"\n" * len(_ENDS))
_WORDS = [f"w{i}" for i in range(1, MAX_WORDS + 1)]


class Block:
    """Words of some texts as one array of codes; 0 ends a piece."""

    def __init__(self):
        self.next = count(1)
        self.codes: dict[str, defaultdict] = {}
        self.parts: list[np.ndarray] = []
        self.size = 0

    def add(self, lang: str, text: bytes) -> None:
        if lang not in self.codes:
            self.codes[lang] = defaultdict(self.next.__next__, {b"": -1, b"\n": 0})
        words = text.translate(_FOLD).replace(b"\n", b" \n ").split(b" ")
        words.append(b"\n")
        codes = np.fromiter(map(self.codes[lang].__getitem__, words), np.int32, len(words))
        codes = codes[codes >= 0]
        self.parts.append(codes)
        self.size += len(codes)

    def close(self) -> tuple[np.ndarray, list, np.ndarray, list]:
        """(codes, word of each code, language of each code, languages)"""
        seq = np.concatenate(self.parts) if self.parts else np.zeros(0, np.int32)
        langs = list(self.codes)
        size = 1 + sum(len(c) - 2 for c in self.codes.values())
        names, lang_of = [b""] * size, np.zeros(size, np.int32)
        for k, known in enumerate(self.codes.values()):
            for word, code in known.items():
                if code > 0:
                    names[code], lang_of[code] = word, k
        return seq, names, lang_of, langs


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    block = Block()
    for batch in batches:
        langs = batch.column("lang").to_pylist()
        texts = batch.column("text").cast(pa.binary()).to_pylist()
        for lang, text in zip(langs, texts):
            block.add(lang, text)
            if block.size >= BLOCK_WORDS:
                yield block
                block = Block()
    if block.size:
        yield block


def word_hashes(names: list, lang_of: np.ndarray, langs: list) -> np.ndarray:
    heads = [xxhash.xxh3_64_intdigest(x.encode()) for x in langs]
    out = np.fromiter((xxhash.xxh3_64_intdigest(w, heads[k]) for w, k in zip(names, lang_of.tolist())), np.uint64, len(names)) if langs else np.zeros(1, np.uint64)
    return out


def longer_hashes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of word sequences from those of the sequences without the last word and of that word."""
    x = a * np.uint64(0x9E3779B97F4A7C15) + ((b << np.uint64(31)) | (b >> np.uint64(33)))
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def marked(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = keys & np.uint64(len(bitmap) * 64 - 1)
    return ((bitmap[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1)).astype(bool)


def frequent_parts(block: Block, maps: list) -> tuple:
    """The closed block with, for each length m from 1 to one more than there are bitmaps, the places
    where m words begin of which all parts are marked (``alive``), and the hashes of the longest."""
    seq, names, lang_of, langs = block.close()
    hashes = word_hashes(names, lang_of, langs)
    known = np.ones(len(names), bool)
    known[0] = False
    alive, at = [known[seq]], np.flatnonzero(known[seq])
    keys = hashes[seq[at]]
    for m, bitmap in enumerate(maps, 1):
        good = at[marked(bitmap, keys)]
        alive[-1] = np.zeros(len(seq), bool)
        alive[-1][good] = True
        longer = np.zeros(len(seq), bool)
        longer[:-1] = alive[-1][:-1] & alive[-1][1:]
        kept = longer[at]
        at, keys = at[kept], keys[kept]
        keys = longer_hashes(keys, hashes[seq[at + m]])
        alive.append(longer)
    return seq, names, lang_of, langs, alive, keys


def _bitmap(docs: DataFrame, least: int, maps: list) -> np.ndarray:
    """Marks of the sequences of one word more than ``maps`` has bitmaps that occur ``least`` times."""
    held = docs.sparkSession.sparkContext.broadcast(maps)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            key, n = np.unique(frequent_parts(block, held.value)[-1], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n.astype(np.int64))], ["key", "n"])

    counts = docs.mapInArrow(keys, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    frequent = saved(counts.where(F.col("n") >= least).select("key"), "frequent-keys")
    bits = MIN_BITS
    while bits < min(MAX_BITS, frequent.count() * BITS_EACH):
        bits *= 2
    at = F.col("key").bitwiseAND(F.lit(bits - 1))
    bit = F.expr("shiftleft(1L, cast(at & 63 as int))")
    cells = frequent.select(at.alias("at")).groupBy(F.shiftright("at", 6).alias("cell")).agg(F.bit_or(bit).alias("mask"))
    got = cells.toPandas()  # at most MAX_BITS / 64 rows
    out = np.zeros(bits // 64, np.uint64)
    out[got["cell"].to_numpy(np.int64)] = got["mask"].to_numpy(np.int64).view(np.uint64)
    return out


def _unique(a: np.ndarray, b: np.ndarray, width: int) -> tuple[np.ndarray, int]:
    values, inverse = np.unique(a.astype(np.int64) * width + b, return_inverse=True)
    return inverse, len(values)


def window_table(block: Block, maps: list) -> pa.RecordBatch:
    """The block's distinct padded windows and their numbers: (lang, w1, ..., w5, n)."""
    seq, names, lang_of, langs, alive, _ = frequent_parts(block, maps)
    size, word = len(names), alive[0]
    rare = np.bincount(lang_of[seq[(seq > 0) & ~word]], minlength=len(langs))
    # a window reaches m words while all its sequences of the marked lengths are marked
    reach = [word, *alive[1:-1]]
    while len(reach) < MAX_WORDS:
        step = np.zeros(len(seq), bool)
        step[:-1] = reach[-1][:-1] & reach[-1][1:]
        reach.append(step)
    pair = reach[1]
    single = np.bincount(seq[word & ~pair], minlength=size)
    start = np.flatnonzero(pair)
    cols = [seq[start]]
    for j in range(1, MAX_WORDS):
        cols.append(np.where(reach[j][start], seq[np.minimum(start + j, len(seq) - 1)], 0))
    key, width = _unique(cols[0], cols[1], size)
    for col in cols[2:]:
        key, width = _unique(key, col, size)
    first = np.full(width, len(start), np.int64)
    np.minimum.at(first, key, np.arange(len(start)))
    many = np.bincount(key, minlength=width)
    some, alone = np.flatnonzero(rare), np.flatnonzero(single)
    text = pa.array(names, pa.binary()).cast(pa.string())
    none = np.zeros(len(some) + len(alone), np.int64)
    lead = np.concatenate([np.zeros(len(some), np.int64), alone, cols[0][first]])
    lang = np.concatenate([some, lang_of[alone], lang_of[cols[0][first]]])
    arrays = [pa.array(langs, pa.string()).take(pa.array(lang))]
    for codes in (lead, *(np.concatenate([none, c[first]]) for c in cols[1:])):
        arrays.append(text.take(pa.array(codes, mask=codes == 0)))
    arrays.append(pa.array(np.concatenate([rare[some], single[alone], many]).astype(np.int64)))
    return pa.RecordBatch.from_arrays(arrays, ["lang", *_WORDS, "n"])


def phrase_counts(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(lang, words, f): the phrases of 1 to ``MAX_WORDS`` words that occur ``least`` times, and
    with an empty array the number of all words of each language."""
    ship(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col("lang"), F.lit("und")).alias("lang"), text_or_empty().alias("text"))
    maps: list = []
    for _ in range(PRUNED):
        maps.append(_bitmap(rows, least, maps))
    held = docs.sparkSession.sparkContext.broadcast(maps)

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            out = window_table(block, held.value)
            for lo in range(0, out.num_rows, 50_000):
                yield out.slice(lo, 50_000)

    found = rows.mapInArrow(windows, ", ".join(f"{c} string" for c in ("lang", *_WORDS)) + ", n long")
    # equal windows of all blocks become one before their prefixes are summed
    found = found.groupBy("lang", *_WORDS).agg(F.sum("n").alias("n"))
    sums = found.rollup("lang", *_WORDS).agg(F.sum("n").alias("f"), F.grouping_id().alias("_g"))
    # bit i of the grouping id stands for a column summed over, the last column first
    depth = sum(((F.shiftright("_g", i).bitwiseAND(F.lit(1)) == 0).cast("int") for i in range(MAX_WORDS)), F.lit(0))
    words = F.array(*[F.col(w) for w in _WORDS])
    sums = sums.where(F.col("_g") < (1 << MAX_WORDS)).withColumn("_depth", depth)
    whole = (F.col("_depth") == 0) | (F.get(words, F.col("_depth") - 1).isNotNull() & (F.col("f") >= least))
    return sums.where(whole).select("lang", F.slice(words, 1, F.col("_depth")).alias("words"), "f")


def _joined(words: Column) -> Column:
    return F.array_join(words, " ")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, absorbed_percent: int = 100) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``top`` phrases by score."""
    counts = saved(phrase_counts(docs, least), "phrase-counts").withColumn("size", F.size("words"))
    # written, so that the planner knows its size: a row for each language
    totals = saved(counts.where("size = 0").select("lang", F.col("f").alias("n")), "phrase-totals")
    parts = counts.where("size > 0").select("lang", _joined(F.col("words")).alias("phrase"), "f")
    phrases = counts.where("size > 1").select("lang", "words", "size", F.col("f").alias("a"))
    # every way to cut a phrase in two
    cuts = phrases.select("lang", _joined(F.col("words")).alias("phrase"), "a", "words", "size",
                          F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", _joined(F.slice("words", 1, F.col("k"))).alias("_first"),
                       _joined(F.slice("words", F.col("k") + 1, F.col("size") - F.col("k"))).alias("_rest"))
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("_first"), F.col("f").alias("l")), ["lang", "_first"])
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("_rest"), F.col("f").alias("r")), ["lang", "_rest"])
    cuts = cuts.join(totals, "lang")
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    score = F.call_function("div", F.lit(1000).cast("decimal(4,0)") * wide("a") * F.col("n").cast("decimal(15,0)"), wide("l") * wide("r"))
    cuts = cuts.select("lang", "phrase", "a", "n", F.struct(score.alias("score"), "k", "l", "r").alias("_cut"))
    scored = cuts.groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.first("n").alias("n"), F.min("_cut").alias("_cut"))
    # the most frequent longer candidate around each phrase
    spans = [(i, j) for j in range(2, MAX_WORDS) for i in range(1, MAX_WORDS - j + 2)]
    inner = F.filter(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in spans]),
                     lambda s: (s["i"] + s["j"] - 1 <= F.col("size")) & (s["j"] < F.col("size")))
    around = phrases.where("size > 2").select("lang", "words", "a", F.explode(inner).alias("_s"))
    around = around.select("lang", _joined(F.slice("words", F.col("_s.i"), F.col("_s.j"))).alias("phrase"), "a")
    around = around.groupBy("lang", "phrase").agg(F.max("a").alias("_longer"))
    kept = scored.join(around, ["lang", "phrase"], "left").where(
        F.col("_longer").isNull() | (100 * F.col("_longer") < absorbed_percent * F.col("a")))
    kept = kept.select("lang", "phrase", "a", "_cut.l", "_cut.r", "n", "_cut.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return kept.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top).select(
        "lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark, sf_dir: str) -> DataFrame:
    """The best phrases of every language of ``documents``."""
    return collocations(table(spark, sf_dir, "documents"))


SQL = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                   '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM p),
n AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM w GROUP BY lang),
g AS (
  SELECT lang, list_slice(ws, i, i + m - 1) AS ws, m
  FROM (SELECT lang, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM w, (VALUES (1), (2), (3), (4), (5)) v(m) WHERE len(ws) >= m)),
f AS (SELECT lang, array_to_string(ws, ' ') AS phrase, ws, m, count(*) AS f FROM g GROUP BY lang, ws, m HAVING count(*) >= 100),
cut AS (
  SELECT lang, phrase, f AS a, k, array_to_string(list_slice(ws, 1, k), ' ') AS p1, array_to_string(list_slice(ws, k + 1, m), ' ') AS p2
  FROM (SELECT *, unnest(range(1, m)) AS k FROM f WHERE m > 1)),
s AS (
  SELECT c.lang, c.phrase, c.a, c.k, x.f AS l, y.f AS r, n.n,
         CAST((1000::HUGEINT * c.a * n.n) // (x.f::HUGEINT * y.f) AS BIGINT) AS score
  FROM cut c JOIN f x ON c.lang = x.lang AND c.p1 = x.phrase JOIN f y ON c.lang = y.lang AND c.p2 = y.phrase JOIN n ON c.lang = n.lang),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
around AS (
  SELECT lang, phrase, max(f) AS f
  FROM (SELECT lang, array_to_string(list_slice(ws, i, i + j - 1), ' ') AS phrase, f
        FROM (SELECT *, unnest(range(1, m - j + 2)) AS i FROM f, (VALUES (2), (3), (4)) v(j) WHERE j < m))
  GROUP BY lang, phrase)
SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank, b.phrase, a, l, r, n, score
FROM b LEFT JOIN around o ON b.lang = o.lang AND b.phrase = o.phrase
WHERE o.f IS NULL OR o.f < a
QUALIFY rank <= 2000
"""
