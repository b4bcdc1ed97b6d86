"""Operator 11 against its SQL and a plain trie."""
import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from tests.conftest import SF_DIR
from tests.llm.helpers import CLASH, LONG
from tests.oracle_compare import compare, duck
from tonality.llm import prefix_trie as pt

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            tie = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
            convs[c].append(((turn is not None, turn or 0, tie), (role, text)))
    convs = {c: [x for _, x in sorted(v)] for c, v in convs.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        path = tuple(convs.get(base, [])[:h] + own[h:])
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
        ends[path].append(c)
    kids = defaultdict(int)
    for p in members:
        if p:
            kids[p[:-1]] += 1
    leaves, gains = defaultdict(int), defaultdict(int)
    for p, cs in members.items():
        gain = (len(cs) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += kids[p] == 0
            gains[p[:d]] += gain
    return sorted((min(cs), len(p), min(members[p[:-1]]) if p else -1, len(cs), kids[p], leaves[p], gains[p],
                   hashlib.sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest()) for p, cs in members.items())


def rows_of(df):
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves,
                   r.saved_tokens, r.ends_sha256) for r in df.collect())


def conversations(seed, n, hot=0):
    rng = np.random.default_rng(seed)
    rows = [(c, t, "user" if t % 2 == 0 else "bot", " ".join(["x", "y", "z"][int(k)] for k in rng.integers(0, 3, rng.integers(1, 3))))
            for c in range(n) for t in range(int(rng.integers(1, 7)))]
    return rows + [(1000 + 20 * c, t, "system", f"same turn {t} for all") for c in range(hot) for t in range(5)]


@pytest.mark.parametrize("d", [SF_DIR])
def test_whole_table_matches_sql(spark, d):
    got = compare(spark, duck(d), "op11", pt.op11_prefix_trie, pt.SQL, d)
    assert got["status"] == "match" and got["spark_rows"] > 100


@pytest.mark.parametrize("nodes,convs,parts", [(4, 1000, 5), (1000, 3, 7), (1, 1, 3), (60, 50, 1)])
def test_small_shards_share_spines(spark, nodes, convs, parts):
    rows = conversations(nodes, 70, hot=40)
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        shards = pt.write_shards(pt.rebuilt(spark.createDataFrame(rows, SCHEMA)), nodes, convs)
        assert shards.count() >= parts
        assert rows_of(pt.read_nodes(shards)) == brute(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 8)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_edges(spark):
    rows = [(None, 0, "user", "no id"), (1, None, None, None), (1, None, "", ""), (2, 3, "user", None), (2, 3, "user", None), (3, 1, None, "a b"),
            (3, 0, "u", "é 　 ü"), (4, 0, "u", LONG), (5, 0, "u", LONG), (7, 0, "u", "x"), (-21, 2, "u", "x"), (-20, 1, "u", "y"),
            (2 ** 62, 0, "u", " \t\n"), (60, 0, "a", "bc"), (61, 0, "ab", "c"), (61, 0, "ab", "c"), (61, 0, "ab", "d")]
    df = spark.createDataFrame(rows, SCHEMA)
    for c in (*CLASH, "path", "words", "depth", "first", "part"):
        df = df.withColumn(c, pt.F.lit("clash"))
    assert rows_of(pt.prefix_trie(df)) == brute(rows)
    assert pt.prefix_trie(spark.createDataFrame([], SCHEMA)).collect() == []


def test_one_long_conversation(spark):
    rows = [(c, t, "u", f"turn {t}" if t < 3000 else f"{c} {t}") for c in (20, 40, 60) for t in range(3005)]
    shards = pt.write_shards(pt.rebuilt(spark.createDataFrame(rows, SCHEMA)), 2000, 2)
    got = rows_of(pt.read_nodes(shards))
    assert len(got) == 1 + 3000 + 15 and got == sorted(brute_long(rows))


def brute_long(rows):
    """``brute`` takes all prefixes of all conversations; these three share their first 3000 turns."""
    empty = hashlib.sha256(b"").hexdigest()
    total = 2 * 2 * 3000
    out = [(20, 0, -1, 3, 1, 3, total, empty)]
    for d in range(1, 3001):
        out.append((20, d, 20, 3, 1 if d < 3000 else 3, 3, total - 4 * (d - 1), empty))
    for c in (20, 40, 60):
        for d in range(3001, 3006):
            end = d == 3005
            out.append((c, d, 20 if d == 3001 else c, 1, 0 if end else 1, 1, 0, hashlib.sha256(str(c).encode()).hexdigest() if end else empty))
    return out


def test_find_close_and_ranks():
    rng = np.random.default_rng(3)
    for n in (1, 2, 30, 400, 5000):
        bits, depth, left = [1], 1, n - 1
        while left or depth > 1:
            if left and (depth == 1 or rng.random() < 0.55):
                bits.append(1), (depth := depth + 1), (left := left - 1)
            else:
                bits.append(0)
                depth -= 1
        bits = np.asarray([*bits, 0], np.uint8)
        p = pt.Parens(bits, pt.block_minima(pt.excess(bits)))
        stack, want, leaves = [], {}, {}
        for i, b in enumerate(bits.tolist()):
            if b:
                stack.append(i)
            else:
                o = stack.pop()
                want[o] = i
                leaves[o] = int(((bits[o:i] == 1) & (bits[o + 1:i + 1] == 0)).sum())
        close = p.find_close(p.opens)
        assert close.tolist() == [want[o] for o in p.opens.tolist()]
        assert p.leaf_pairs(p.opens, close + 1).tolist() == [leaves[o] for o in p.opens.tolist()]
