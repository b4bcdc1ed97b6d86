"""Operators 3, 7, 8, 9 and 10 against SQL twins, brute force and edge cases."""
import itertools
import random
from collections import defaultdict

import numpy as np
import pytest

from tests.conftest import SF_DIR
from tests.llm.helpers import LONG, docs, edge_docs, edge_rows, empty_docs, read
from tests.oracle_compare import compare, duck
from tonality.llm import decontaminate, graph, jaccard_join, license_scan, line_dedup, queries, topk


@pytest.mark.parametrize("name", [n for n, (_, sql) in queries.registered().items() if sql])
def test_sql_twin(spark, name):
    build, sql = queries.registered()[name]
    r = compare(spark, duck(SF_DIR), name, build, sql, SF_DIR)
    assert r["status"] == "match" and r["spark_rows"] > 0, r


# ---------------------------------------------------------------- 3 line dedup
def plain_windows(rows):
    seen, out = set(), {}
    for i, t in sorted(rows):
        lines = (t or "").split("\n")
        gone = set()
        for p in range(len(lines) - 2):
            w = tuple(lines[p:p + 3])
            if w in seen:
                gone.update((p, p + 1, p + 2))
            seen.add(w)
        out[i] = "\n".join(x for p, x in enumerate(lines) if p not in gone)
    return out


def test_line_dedup_overlaps(spark):
    rng = random.Random(1)
    rows = [(i, "\n".join(rng.choice("abc") for _ in range(rng.randrange(1, 12)))) for i in range(60)]
    got = {r.doc_id: r.text for r in line_dedup.remove_repeated_windows(docs(spark, [(i, t, "x") for i, t in rows])).collect()}
    assert got == plain_windows(rows)


def test_line_dedup_edges(spark):
    got = line_dedup.remove_repeated_windows(edge_docs(spark)).collect()
    assert len(got) == len(edge_rows())
    by = {r.doc_id: r for r in got}
    assert by[8].n_removed == 0 and (by[9].text, by[9].n_removed) == ("l5", 3)
    assert by[2].text == "" and by[6].text == LONG
    assert line_dedup.remove_repeated_windows(empty_docs(spark)).count() == 0
    same = docs(spark, [(1, "a\nb\nc", "x"), (1, "a\nb\nc", "x"), (2, "a\nb\nc", "x"), (None, "q\nr\ns", "x")])
    assert sorted(r.n_removed for r in line_dedup.remove_repeated_windows(same).collect()) == [0, 0, 0, 3]


# ---------------------------------------------------------------- 7 top-k
def test_topk_against_plain_products(spark):
    rng = np.random.default_rng(2)
    vectors = [(i, [float(x) for x in rng.integers(-3, 3, 8) / 4]) for i in range(300)]  # many ties
    rows = spark.createDataFrame(vectors, "vec_id long, embedding array<float>").repartition(7)
    got = defaultdict(list)
    for r in topk.search(rows, rows.where("vec_id % 50 = 0"), 5).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    whole = {i: np.floor(256 * np.asarray(v)).astype(int) for i, v in vectors}
    for q in range(0, 300, 50):
        want = sorted(((int(whole[q] @ v), -i) for i, v in whole.items() if i != q), reverse=True)[:5]
        assert got[q] == [(-i, s) for s, i in want]


def test_topk_edges(spark):
    rows = [(0, [1.0, 2.0]), (1, None), (2, [1.0, None]), (3, [float("nan"), 1.0]), (4, [float("inf"), 0.0]), (5, [1.0, 2.0, 0.5]),
            (6, []), (7, [1.0, 2.0]), (7, [1.0, 2.0]), (None, [1.0, 1.0]), (8, [1e30, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "'c' AS score", "'c' AS rank")
    got = topk.search(df, df.where("vec_id IN (0, 50)"), 5).collect()
    assert [(r.rank, r.vec_id) for r in sorted(got, key=lambda r: r.rank)] == [(1, 8), (2, 5), (3, 7), (4, 7), (5, 6)]
    assert topk.search(df.limit(0), df.limit(0), 5).count() == 0
    assert [r.vec_id for r in topk.search(df.where("vec_id IN (0, 5)"), df.where("vec_id = 0"), 5).collect()] == [5]


# ---------------------------------------------------------------- 8 licences
def test_license_variants(spark):
    mit = dict(license_scan.KNOWN)["MIT"]
    variant = "Copyright (c) 2020 Someone\n\n" + mit.replace("License\n", "LICENCE\n").replace("sublicense", "sub-license").replace(
        "COPYRIGHT HOLDERS", "copyright holders").replace(" ", "  ").replace("\"", "''")
    rows = docs(spark, [(1, mit, "x"), (2, variant, "x"), (3, mit + " extra", "x"), (4, "words\nreleased under the MIT licence\nwords", "x")])
    got = {r.doc_id: (r.license_id, r.notices) for r in license_scan.scan(rows).collect()}
    assert got == {1: ("MIT", ""), 2: ("MIT", ""), 3: (None, ""), 4: (None, "MIT-notice")}
    known = spark.createDataFrame([("Z", "Some Words!"), ("A", "some words"), ("E", "..."), ("N", None)], "license_id string, text string")
    got = license_scan.scan(docs(spark, [(1, "SOME, words", "x"), (2, "", "x")]), known).collect()
    assert sorted((r.doc_id, r.license_id) for r in got) == [(1, "A"), (2, None)]


def test_license_texts_and_notices_beyond_the_sql(spark):
    files = sorted(license_scan.FOLDER.glob("*.txt"))
    rows = [(k, f"Copyright (c) 2021 Someone\n{f.read_text()}", "x") for k, f in enumerate(files)]
    lines = {"# SPDX-License-Identifier: GPL-2.0-or-later": "GPL-2.0-notice", "Licensed under the BSD 3-Clause License.": "BSD-3-Clause-notice",
             "This software is licensed under the Mozilla Public License, version 2.0": "MPL-2.0-notice", "Licensed under my own terms.": ""}
    rows += [(100 + k, f"some code\n{line}\nmore code", "x") for k, line in enumerate(lines)]
    got = {r.doc_id: r for r in license_scan.scan(docs(spark, rows)).collect()}
    assert [got[k].license_id for k in range(len(files))] == [f.stem.split("__")[0] for f in files]
    assert [got[100 + k].notices for k in range(len(lines))] == list(lines.values())


def test_license_rows_with_null_or_repeated_ids(spark):
    rows = [(None, "x\nReleased under the MIT License.", "x"), (None, "plain", "x"), (5, "Licensed under CC BY-NC 4.0.", "x"), (5, "other", "y")]
    got = {(r.doc_id, r.notices) for r in license_scan.scan(docs(spark, rows)).collect()}
    assert got == {(None, "MIT-notice"), (None, ""), (5, "CC-BY-NC-4.0-notice"), (5, "")}


def test_license_edges(spark):
    got = license_scan.scan(edge_docs(spark)).collect()
    assert len(got) == len(edge_rows()) and all(r.license_id is None for r in got)
    assert license_scan.scan(empty_docs(spark)).count() == 0


# ---------------------------------------------------------------- 9 Jaccard join
def shingle_set(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def plain_components(rows):
    sets = [(i, shingle_set(t)) for i, t in rows]
    up = list(range(len(sets)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(range(len(sets)), 2):
        x, y = sets[a][1], sets[b][1]
        if x and y and 100 * len(x & y) >= 80 * len(x | y):
            up[root(a)] = root(b)
    ids = defaultdict(list)
    for k, (i, _) in enumerate(sets):
        ids[root(k)].append(i)
    return [(i, len(s), min([j for j in ids[root(k)] if j is not None], default=None)) for k, (i, s) in enumerate(sets)]


def near_copies(seed, groups, size, words=120, most=8):
    rng = random.Random(seed)
    rows = []
    for _ in range(groups):
        base = [f"w{rng.randrange(400)}" for _ in range(words)]
        for _ in range(size):
            t = list(base)
            for _ in range(rng.randrange(most)):
                t[rng.randrange(len(t))] = f"e{rng.randrange(10 ** 6)}"
            rows.append(" ".join(t[:len(t) - rng.randrange(6)]))
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("block,bucket", [(4096, 400_000), (8, 500)])
def test_jaccard_components(spark, monkeypatch, block, bucket):
    """Groups whose members are only partly similar to each other; small blocks and buckets
    send large groups through the block pairs."""
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    monkeypatch.setattr(jaccard_join, "KEYS_PER_BUCKET", bucket)
    rows = near_copies(4, 6, 40) + [(1000 + i, " ".join(f"u{i}x{j}" for j in range(60)) + " shared passage of some words " * 2) for i in range(30)]
    got = jaccard_join.near_duplicates(docs(spark, [(i, t, "x") for i, t in rows])).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(plain_components(rows))


@pytest.mark.parametrize("block,bucket", [(4096, 400_000), (8, 500)])
def test_jaccard_join_has_every_link(spark, monkeypatch, block, bucket):
    """Pairs inside a component too, each class of equal sets standing for its documents."""
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    monkeypatch.setattr(jaccard_join, "KEYS_PER_BUCKET", bucket)
    rows = near_copies(3, 12, 40, most=3)
    rows += [(500 + i, t) for i, t in rows[:5]] + [(900, ""), (901, None)]
    links, members = jaccard_join.join(docs(spark, [(i, t, "x") for i, t in rows]))
    got, of = {(r.a, r.b) for r in links.collect()}, {r.doc_id: r for r in members.collect()}
    assert all(a < b for a, b in got) and len(of) == len(rows)
    sets = {i: set(jaccard_join.shingles(t or "").tolist()) for i, t in rows}
    count = dict.fromkeys(sets, 0)
    for x in sets:
        for y in sets:
            if x < y and sets[x] and sets[y]:
                a, b = sorted((of[x].class_id, of[y].class_id))
                linked = 5 * len(sets[x] & sets[y]) >= 4 * len(sets[x] | sets[y])
                assert linked == (a == b or (a, b) in got)
                count[x], count[y] = count[x] + linked, count[y] + linked
    assert {i: r.n_links for i, r in of.items()} == count and len(got) > len(rows)


def test_jaccard_edges(spark):
    key = lambda r: tuple(-1 if v is None else v for v in r)
    got = jaccard_join.near_duplicates(edge_docs(spark)).collect()
    want = plain_components([(i, t) for i, t, _ in edge_rows()])
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=key) == sorted(want, key=key)
    assert jaccard_join.near_duplicates(empty_docs(spark)).count() == 0
    assert jaccard_join.near_duplicates(docs(spark, [(1, None, "x"), (2, "", "x")])).count() == 2
    kept = sorted((r.doc_id for r in jaccard_join.keep_one(edge_docs(spark)).collect()), key=lambda x: x or 0)
    assert kept == [None, 1, 2, 3, 4, 5, 6, 8, 9, 11]


def test_near_copies_without_links_make_no_pair_of_every_two(spark, monkeypatch):
    """A group whose classes are all a little too different: the signatures allow most pairs."""
    rng, size = random.Random(12), 120
    base = [f"w{i}" for i in range(400)]
    rows = []
    for k in range(size):
        t = list(base)
        for slot in rng.sample(range(1, 79), 5):
            t[5 * slot] = f"e{k}x{slot}"
        rows.append((k, " ".join(t)))
    counts, plain = [], jaccard_join.saved

    def saved(df, name):
        out = plain(df, name)
        if {"a", "b"} <= set(out.columns):
            counts.append((name, out.count()))
        return out

    monkeypatch.setattr(jaccard_join, "saved", saved)
    got = jaccard_join.near_duplicates(docs(spark, [(i, t, "x") for i, t in rows])).collect()
    want = plain_components(rows)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(want)
    assert len({c for _, _, c in want}) > 1
    assert max(n for _, n in counts) < size * (size - 1) // 8, counts


def test_clusters_join_what_exact_links_join():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    sets = [np.unique(np.concatenate([base[rng.random(300) > 0.12], rng.integers(0, 1 << 63, 8, dtype=np.uint64)])) for _ in range(60)]
    held, joined = jaccard_join.Sets(sets), jaccard_join.Joined(np.arange(60))
    i, j = np.triu_indices(60, 1)
    ok = held.similar(i, j)
    exact = [5 * len(np.intersect1d(sets[a], sets[b])) >= 4 * len(np.union1d(sets[a], sets[b])) for a, b in zip(i, j)]
    assert ok.tolist() == exact and 0 < ok.sum() < len(ok)
    used = joined.join(i[ok], j[ok])
    assert len(used) == 60 - len(set(joined.label.tolist()))
    assert (joined.label[i[ok]] == joined.label[j[ok]]).all()


def test_tree_pairs_lose_nothing():
    rng = np.random.default_rng(1)
    base = [rng.integers(0, 1 << 63, rng.integers(20, 2500), dtype=np.uint64) for _ in range(20)]
    sets = []
    for _ in range(400):
        b = base[rng.integers(20)]
        sets.append(np.unique(np.concatenate([b[rng.random(len(b)) > 0.3 * rng.random()], rng.integers(0, 1 << 63, 5, dtype=np.uint64)])))
    n, comp = np.asarray([len(s) for s in sets]), rng.integers(0, 150, 400)
    raw = [jaccard_join.bitmap(s).tobytes() for s in sets]
    bits = jaccard_join.matrix(raw)
    assert len({len(b) for b in raw}) > 1
    for a, b in ((0, 1), (2, 300), (17, 399)):
        assert jaccard_join.apart([raw[a]], [raw[b]])[0] <= len(np.setxor1d(sets[a], sets[b]))
    for split in (None, 150):
        i, j = jaccard_join.tree_pairs(n, bits, comp, split)
        got = {tuple(sorted(p)) for p in zip(i.tolist(), j.tolist())}
        for a, b in itertools.combinations(range(400), 2):
            c = len(np.intersect1d(sets[a], sets[b]))
            if comp[a] != comp[b] and 5 * c >= 4 * (n[a] + n[b] - c) and (split is None or a < split <= b):
                assert (a, b) in got
        assert split is None or all(a < split <= b for a, b in got)


def test_components(spark):
    rng = random.Random(7)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, x) for x in range(101, 150)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
    assert got == {x: root(x) for x in list(up)}


# ---------------------------------------------------------------- 10 decontamination
def plain_distance(item, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)


def test_myers_distance():
    rng = random.Random(5)
    for _ in range(200):
        item = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 90)))
        text = "".join(rng.choice("abc") for _ in range(rng.randrange(0, 120)))
        assert decontaminate.closest(decontaminate.masks(item), len(item), text)[0] == plain_distance(item, text)


@pytest.mark.parametrize("pass_chars", [10 ** 6, 150])
def test_leaks_against_plain_distances(spark, pass_chars):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 8)))
    items = [(k, " ".join(word() for _ in range(20))) for k in range(6)] + [(90, ""), (91, None), (92, "tiny")]
    rows = []
    for i in range(60):
        t = [word() for _ in range(30)]
        if i % 3:
            x = list(items[i % 6][1])
            for _ in range(rng.randrange(16)):
                x[rng.randrange(len(x))] = rng.choice(["", "z", "zq"])
            t[10:10] = ["".join(x).upper() + "!"]
        rows.append((i, " ".join(t), "x"))
    bench = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS doc_id", "2 AS edits")
    got = {(r.doc_id, r.item_id): r.edits for r in decontaminate.find_leaks(docs(spark, rows), bench, pass_chars=pass_chars).collect()}
    want = {}
    for (i, t, _), (k, item) in itertools.product(rows, items):
        q = decontaminate.normal(item)
        if q:
            d = plain_distance(q, decontaminate.normal(t))
            if d <= decontaminate.budget(len(q)):
                want[i, k] = d
    assert got == want and len(want) > 10


def test_leaks_edges(spark):
    bench = spark.createDataFrame([(1, "a b c d e f g"), (1, "a b c d e f g"), (2, None)], "item_id long, text string")
    got = decontaminate.find_leaks(edge_docs(spark), bench).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(1, 1), (7, 1)]
    assert decontaminate.find_leaks(empty_docs(spark), bench).count() == 0
    assert decontaminate.find_leaks(edge_docs(spark), bench.limit(0)).count() == 0
    left = decontaminate.remove_leaks(edge_docs(spark), bench)
    assert left.count() == len(edge_rows()) - 3 and left.columns == edge_docs(spark).columns


def test_leaks_are_removed_row_by_row(spark):
    item = "what is the tallest mountain on earth above the level of the sea"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    big = (1 << 53) + 1
    rows = [(None, f"so {item} then", "x"), (None, "clean without id", "x"), (7, item, "x"), (7, "clean twin", "x"),
            (big, f"{item} again", "x"), (big - 1, "clean neighbour", "x"), (9, None, "x")]
    kept = decontaminate.remove_leaks(docs(spark, rows), bench).collect()
    assert sorted(str(r.text) for r in kept) == ["None", "clean neighbour", "clean twin", "clean without id"]
    assert {r.doc_id for r in decontaminate.find_leaks(docs(spark, rows), bench).collect()} == {None, 7, big}


def test_queries_find_every_whole_item(spark):
    got = {(r.doc_id, r.item_id) for r in decontaminate.op10_decontaminate(spark, SF_DIR).collect()}
    items = [(k, decontaminate.normal(t)) for k, t in read(SF_DIR, "benchmark", "item_id, text")]
    texts = [(i, decontaminate.normal(t)) for i, t in read(SF_DIR, "documents", "doc_id, text")]
    assert {(i, k) for i, t in texts for k, q in items if q in t} <= got


def test_jaccard_query(spark):
    rows = read(SF_DIR, "documents", "doc_id, text")
    sets = {i: shingle_set(t) for i, t in rows}
    where = defaultdict(set)
    for i, s in sets.items():
        for x in s:
            where[x].add(i)
    near = {p for v in where.values() if len(v) > 1 for p in itertools.combinations(sorted(v), 2)}
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in near:
        if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.op9_jaccard_join(spark, SF_DIR).collect()}
    assert got == {i: (len(s), root(i)) for i, s in sets.items()}
