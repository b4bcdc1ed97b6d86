"""Operator 12 against its SQL and a plain count of all phrases."""
import re
from collections import Counter

import numpy as np

from tests.conftest import SF_DIR
from tests.llm.helpers import CLASH, DOCS, edge_docs, edge_rows, empty_docs
from tests.oracle_compare import compare, duck
from tonality.llm import collocations as co


def brute(rows, least, top=co.TOP, percent=100):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n-\r]", low):
            ws = re.findall("[^ \t]+", piece)
            n[lang] += len(ws)
            for m in range(1, 6):
                f.update((lang, *ws[i:i + m]) for i in range(len(ws) - m + 1))
    cand = {p: a for p, a in f.items() if len(p) > 2 and a >= least}
    out = {}
    for p, a in cand.items():
        lang, ws = p[0], p[1:]
        cuts = []
        for k in range(1, len(ws)):
            left, right = f[(lang, *ws[:k])], f[(lang, *ws[k:])]
            cuts.append((1000 * a * n[lang] // (left * right), k, left, right))
        score, _, left, right = min(cuts)
        if any(q[0] == lang and len(q) > len(p) and 100 * b >= percent * a and
               any(q[1:][i:i + len(ws)] == ws for i in range(len(q) - len(ws))) for q, b in cand.items()):
            continue
        out.setdefault(lang, []).append((-score, -a, " ".join(ws).encode(), a, left, right, n[lang], score))
    return sorted((lang, rank, r[2].decode(), *r[3:]) for lang, rs in out.items() for rank, r in enumerate(sorted(rs)[:top], 1))


def rows_of(df):
    return sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect())


def frame(spark, rows):
    df = spark.createDataFrame([(i, t, lang, "x", None) for i, (lang, t) in enumerate(rows)], DOCS)
    return df.selectExpr("*", *[f"'clash' AS {c}" for c in (*CLASH, "words", "phrase", "w1", "key", "f", "_g")])


def test_whole_table_matches_sql(spark):
    got = compare(spark, duck(SF_DIR), "op12", co.op12_collocations, co.SQL, SF_DIR)
    assert got["status"] == "match" and got["spark_rows"] > 0


def test_small_texts_against_a_plain_count(spark):
    rng = np.random.default_rng(5)
    words = ["New", "york", "a", "of", "é", "the", "x|y", "ÀB"]
    rows = [("en", None), (None, "new york, New York! new\tyork  new york"), ("und", "NEW york"), ("fr", ""), ("en", " \t.,")]
    for i in range(120):
        text = "".join(str(w) + str(rng.choice([" ", " ", " ", "  ", "\t", ". ", "\n"])) for w in rng.choice(words, 30))
        rows.append((["en", "fr", None][i % 3], text))
    rows += rows[:20]  # repeated rows count
    for least, percent in ((2, 100), (5, 80), (9, 100)):
        want = brute(rows, least, percent=percent)
        assert rows_of(co.collocations(frame(spark, rows), least, absorbed_percent=percent)) == want and want
    assert rows_of(co.collocations(frame(spark, rows), 2, top=7)) == brute(rows, 2, top=7)


def test_edges(spark):
    assert co.collocations(empty_docs(spark)).collect() == []
    got = rows_of(co.collocations(edge_docs(spark), 2))
    rows = [("en", t) for _, t, *_ in edge_rows()]
    assert got == brute(rows, 2)


def test_products_beyond_64_bits(spark):
    """One language with counts of which the products pass a long, fed in as counted phrases."""
    big = 3_000_000_000
    counts = spark.createDataFrame([("en", [], 10 ** 13), ("en", ["a"], big), ("en", ["b"], big + 7), ("en", ["a", "b"], big - 1)],
                                   "lang string, words array<string>, f long")
    original, co.phrase_counts = co.phrase_counts, lambda docs, least: counts
    try:
        r = co.collocations(None).first()
    finally:
        co.phrase_counts = original
    assert (r.a, r.l, r.r, r.score) == (big - 1, big, big + 7, 1000 * (big - 1) * 10 ** 13 // (big * (big + 7)))


def test_windows_are_padded_at_rare_parts_and_counts_stay_whole():
    block = co.Block()
    for _ in range(3):
        block.add("en", b"a b c d e f. a b zz")
    maps = []
    for _ in range(co.PRUNED):
        key, n = np.unique(co.frequent_parts(block, maps)[-1], return_counts=True)
        bitmap = np.zeros(1024, np.uint64)
        for k in key[n >= 4].tolist():
            bitmap[(k % 65536) >> 6] |= np.uint64(1 << (k % 64))
        maps.append(bitmap)
    out = [tuple(r.values()) for r in co.window_table(block, maps).to_pylist()]
    assert sum(r[-1] for r in out) == 27
    assert ("en", "a", "b", None, None, None, 6) in out and ("en", "b", None, None, None, None, 6) in out
    assert ("en", None, None, None, None, None, 15) in out and len(out) == 3
