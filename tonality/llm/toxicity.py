"""Toxicity scores from a weighted lexicon matched by Aho-Corasick.

Texts are folded first: case, look-alike letters of other scripts, digits and signs used as
letters, invisible characters, punctuation.  The lexicon holds whole words and word beginnings
whose frequency in toxic documents is significantly higher than in clean ones; its weights
are log odds learned from labelled documents.  At each word the longest lexicon entry counts
once.  Exception phrases (an entry next to a given word, where the phrase is harmless) cancel
the entries they cover.  The summed weight is normalised by the text's length, and a logistic
curve fitted to the labels turns it into a score.

Only ``doc_id`` and ``text`` are read for a score; labels are read for training rows alone.

Defined results: null and empty texts score like any text without a hit; rows with the same
``doc_id`` are scored one by one; without training rows of both labels the score is the share
of toxic training rows (0 if there are none); other columns are ignored.
"""
from __future__ import annotations

import math
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonality.llm.common import ship, table, text_or_empty

#: Labelled documents that the lexicon and the curve are learned from, at most.
TRAIN_ROWS = 20_000
MIN_Z = 3.0
MIN_WEIGHT = 1.0
PREFIXES = range(4, 9)
PRIOR = 3.0
#: An entry counts at most so often in one document while learning: one odd document proves little.
DOC_CAP = 3
MIN_PHRASE = 8

# Letters that look like a Latin letter, and the signs used for one.
_LOOKALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ɡ": "g", "һ": "h", "і": "i", "ј": "j", "к": "k", "м": "m",
    "н": "h", "о": "o", "р": "p", "ԛ": "q", "г": "r", "ѕ": "s", "т": "t", "у": "y", "ѵ": "v", "ԝ": "w", "х": "x",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u",
    "χ": "x", "ı": "i", "ł": "l", "ø": "o", "đ": "d",
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "|": "i",
}
_INVISIBLE = "­​‌‍⁠﻿"
# Everyday phrases in which an insult is none.
EXCEPTIONS = ("trash can", "trash bin", "take out the trash", "circus clown", "clown fish", "pond scum",
              "garbage collector", "garbage collection", "pathetic fallacy")


def _folding() -> dict[int, str | None]:
    to: dict[int, str | None] = {ord(k): v for k, v in _LOOKALIKES.items()}
    to |= {ord(k.upper()): v for k, v in _LOOKALIKES.items() if len(k.upper()) == 1 and k.upper() != k}
    for i in range(26):
        to[ord("A") + i] = chr(ord("a") + i)
        to[0xFF21 + i] = to[0xFF41 + i] = chr(ord("a") + i)
    # i and l stand for each other in disguised words (and so does 1): one symbol for both
    to = {k: "i" if v == "l" else v for k, v in to.items()} | {ord("l"): "i"}
    to |= dict.fromkeys(map(ord, _INVISIBLE))
    to |= {c: " " for c in range(128) if c not in to and not chr(c).isalnum()}
    to |= {c: " " for c in range(0x2010, 0x2050) if c not in to}
    return to


_FOLD = _folding()


def fold(text: str) -> str:
    """Folded words between single spaces, with a space at both ends."""
    if not text.isascii():
        text = unicodedata.normalize("NFC", text).lower()
    return " " + " ".join(text.translate(_FOLD).split()) + " "


def entries_of(word: str) -> list[str]:
    """The lexicon entries a folded word could match: itself, and its beginnings."""
    return [f" {word} "] + [f" {word[:n]}" for n in PREFIXES if n < len(word)]


@dataclass
class Lexicon:
    weights: dict[str, float]
    exceptions: list[str]
    curve: tuple[float, ...] = (0.0, 0.0, 0.0, 0.0)

    def automaton(self):
        import ahocorasick
        auto = ahocorasick.Automaton()
        for e, w in self.weights.items():
            auto.add_word(e, (len(e), w, ""))
        for e in self.exceptions:
            old = auto.get(e, None)
            auto.add_word(e, (len(e), old[1] if old else 0.0, "x"))
        auto.make_automaton()
        return auto


def measures(auto, text: str) -> tuple[float, float, int]:
    """(summed weight, the same per hundred words, hits) of a folded text."""
    hits: dict[int, tuple[int, float]] = {}
    covered: list[tuple[int, int]] = []
    if len(auto):
        for last, (n, weight, kind) in auto.iter(text):
            begin = last - n + 1
            if kind:
                covered.append((begin, last))
            elif n > hits.get(begin, (0, 0.0))[0]:
                hits[begin] = (n, weight)
    if covered:
        hits = {b: h for b, h in hits.items() if not any(x <= b and b + h[0] - 1 <= y for x, y in covered)}
    total = math.fsum(w for _, w in hits.values())
    words = max(1, text.count(" ") - 1)
    return total, 100.0 * total / (words + 20.0), len(hits)


def _features(total: float, density: float, hits: int) -> tuple[float, ...]:
    return 1.0, math.log1p(total), math.log1p(density), math.log1p(hits)


def probability(curve, total: float, density: float, hits: int) -> float:
    x = sum(a * b for a, b in zip(curve, _features(total, density, hits)))
    return 1.0 / (1.0 + math.exp(-max(-40.0, min(40.0, x))))


def _fit(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Logistic regression by Newton steps, with a small ridge."""
    beta, ridge = np.zeros(x.shape[1]), 1e-2 * np.eye(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ beta)
        beta = beta + step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(beta.tolist())


def _counts(rows: DataFrame, terms) -> DataFrame:
    """(term, toxic, clean): occurrences in each class; ``terms`` lists those of a folded text."""
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        both = (Counter(), Counter())
        for pdf in batches:
            for t, y in zip(pdf["text"], pdf["toxic"]):
                for e, n in Counter(terms(fold(t))).items():
                    both[int(y)][e] += min(n, DOC_CAP) if e else n
            if len(both[0]) + len(both[1]) > 200_000:
                yield from frames(*both)
                both = (Counter(), Counter())
        yield from frames(*both)

    def frames(clean: Counter, toxic: Counter) -> Iterator[pd.DataFrame]:
        names = list(clean.keys() | toxic.keys())
        for lo in range(0, len(names), 10_000):
            part = names[lo:lo + 10_000]
            yield pd.DataFrame({"term": part, "toxic": [toxic[n] for n in part], "clean": [clean[n] for n in part]})

    found = rows.mapInPandas(count, "term string, toxic long, clean long")
    return found.groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def learn(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Lexicon:
    """Lexicon, exceptions and curve from at most ``train_rows`` labelled documents (those with
    the smallest hashed ids); ``labels`` has (doc_id, toxic).  Every significant entry and phrase
    of these documents is taken."""
    ship(docs.sparkSession)
    picked = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where(F.col("toxic").isin(0, 1))
    picked = picked.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    rows = docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(picked), "doc_id")  # train_rows at most
    exceptions = [fold(e) for e in EXCEPTIONS]

    def of_words(text: str) -> list[str]:
        return [e for w in text.split() for e in entries_of(w)] + [""] * (text.count(" ") - 1)

    counts = _counts(rows, of_words)
    words = counts.where(F.col("term") == "").first()
    if words is None or not words.toxic or not words.clean:
        shares = picked.agg(F.avg("toxic").alias("s")).first().s
        p = min(max(shares or 0.0, 1e-9), 1 - 1e-9)
        return Lexicon({}, exceptions, (math.log(p / (1 - p)), 0.0, 0.0, 0.0))
    ratio = words.toxic / words.clean
    a, b = F.col("toxic") + F.lit(PRIOR * ratio / (1 + ratio)), F.col("clean") + F.lit(PRIOR / (1 + ratio))
    weight = F.log(a / b) - F.lit(math.log(ratio))
    z = weight / F.sqrt(1 / a + 1 / b)
    best = (counts.where((F.col("term") != "") & (F.col("toxic") > 0)).select("term", weight.alias("w"), z.alias("z"))
            .where((F.col("w") >= MIN_WEIGHT) & (F.col("z") >= MIN_Z))
            .collect())  # words of train_rows documents
    weights = {r.term: r.w for r in sorted(best, key=lambda r: (-r.z, r.term))}
    # a longer entry that says no more than its own beginning is not needed
    for e in sorted(weights, key=len, reverse=True):
        shorter = [weights[e[:n]] for n in range(5, len(e)) if e[:n] in weights]
        if shorter and abs(weights[e] - shorter[-1]) < 0.25:
            del weights[e]
    lexicon = Lexicon(weights, exceptions)
    if not weights:
        return _curve(rows, lexicon)

    # phrases of an entry and its neighbour that occur in clean documents only
    def phrases(text: str) -> list[str]:
        w = text.split()
        hit = [any(e in weights for e in entries_of(x)) for x in w]
        return [f" {x} {y} " for i, (x, y) in enumerate(zip(w, w[1:])) if hit[i] or hit[i + 1]]

    harmless = _counts(rows, phrases).where((F.col("clean") >= MIN_PHRASE) & (F.col("toxic") == 0))
    lexicon.exceptions += [r.term for r in harmless.orderBy(F.desc("clean"), "term").collect()]  # phrases of train_rows documents
    return _curve(rows, lexicon)


def _curve(rows: DataFrame, lexicon: Lexicon) -> Lexicon:
    held = rows.sparkSession.sparkContext.broadcast(lexicon)

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        auto = held.value.automaton()
        for pdf in batches:
            got = [measures(auto, fold(t)) for t in pdf["text"]]
            yield pd.DataFrame(got, columns=["total", "density", "hits"]).assign(toxic=pdf["toxic"].to_numpy())

    seen = rows.mapInPandas(measure, "total double, density double, hits long, toxic int").collect()  # train_rows at most
    seen.sort()
    x = np.asarray([_features(r.total, r.density, r.hits) for r in seen])
    lexicon.curve = _fit(x, np.asarray([float(r.toxic) for r in seen]))
    return lexicon


def score(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """(doc_id, score, hits, weight): every row of ``docs`` scored by its text."""
    ship(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        auto, curve = held.value.automaton(), held.value.curve
        for pdf in batches:
            got = [measures(auto, fold(t)) for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "score": [probability(curve, *g) for g in got],
                                "hits": [n for _, _, n in got], "weight": [s for s, _, _ in got]})

    return docs.select("doc_id", text_or_empty().alias("text")).mapInPandas(
        run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double, hits long, weight double")


def keep_clean(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """The rows of ``docs`` whose text scores below 0.5, with all their columns."""
    ship(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(lexicon)

    @F.pandas_udf("double")
    def toxic(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        auto, curve = held.value.automaton(), held.value.curve
        for part in texts:
            yield pd.Series([probability(curve, *measures(auto, fold(t))) for t in part], dtype=float)

    return docs.where(toxic(text_or_empty()) < 0.5)


def remainder(n: int):
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(n))


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from the labels outside the held-out fold.  A document
    without an id is scored and counts as held out: no label can name it."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    lexicon = learn(docs, labels.where(remainder(5) != 0))
    return score(docs, lexicon).select("doc_id", F.coalesce(remainder(5) == 0, F.lit(True)).alias("held_out"), "score",
                                       (F.col("score") >= 0.5).cast("int").alias("predicted"), "hits", "weight")
