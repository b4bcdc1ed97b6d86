"""Operators 1, 2 and 5 against brute force, held-out gain and accuracy; edge cases."""
import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_DIR
from tests.llm.helpers import docs, edge_docs, edge_rows, empty_docs, read
from tonality.llm import pii_crf, suffix_tree, toxicity
from tonality.llm.common import table


# ---------------------------------------------------------------- 1 suffix tree
def tokens(text):
    return (text or "").encode().lower().split() + [None]


def check_base(rows, got):
    counts, texts = Counter(), {}
    for i, t in rows:
        texts.setdefault(i, []).append(tokens(t))
        if i is not None and zlib.crc32(str(i).encode()) % 10:
            counts.update(tokens(t))
    total, distinct = sum(counts.values()), len(counts)
    for r in got:
        for tk in texts[r.doc_id][:1]:
            base = sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in tk)
            assert r.base_score == pytest.approx(base, rel=1e-9)
            assert (r.n_tokens, r.n_known, r.train_tokens) == (len(tk), sum(counts[w] > 0 for w in tk), total)
            assert r.held_out == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 10 == 0)


def test_suffix_tree_base_and_gain(spark):
    got = suffix_tree.op1_suffix_tree(spark, SF_DIR).collect()
    rows = read(SF_DIR, "documents", "doc_id, text")
    assert len(got) == len(rows)
    check_base(rows, got)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_suffix_tree_learns_contexts_and_sums_to_one(spark):
    """After 'alpha' comes 'beta' in training; the state of 'alpha' must say so, and its
    distribution over all words and one unseen word must sum to one."""
    text = " ".join(["alpha beta gamma delta"] * 8 + ["delta gamma beta"] * 8)
    train = [(i, text, "x") for i in range(40)]
    words = ["alpha", "beta", "gamma", "delta", "unseen"]
    probes = [(1000 + k, f"alpha {w}", "x") for k, w in enumerate(words)] + [(2000, "alpha", "x")]
    rows = docs(spark, train + probes)
    got = {r.doc_id: r for r in suffix_tree.score(rows, F.col("doc_id") < 1000).collect()}
    n = got[0].train_tokens + 0.1 * 6
    start = math.log10((40 * 8 + 0.1) / n)
    rest = 10 ** (got[2000].score - start)  # the end after 'alpha'
    singles = {r.doc_id: r.score for r in suffix_tree.score(
        docs(spark, train + [(3000 + k, w, "x") for k, w in enumerate(words)]), F.col("doc_id") < 1000).collect()}
    for k, (w, c) in enumerate(zip(words, (320, 640, 640, 640, 0))):
        if w != "beta":  # 'alpha w' never occurs, so the end is scored in the state of w, as after w alone
            rest += 10 ** (got[1000 + k].score - start - (singles[3000 + k] - math.log10((c + 0.1) / n)))
    left = suffix_tree.DISCOUNT / 320
    beta = (320 - suffix_tree.DISCOUNT) / 320 + left * (640 + 0.1) / n
    assert rest + beta == pytest.approx(1.0, abs=1e-9)
    assert got[1001].score <= start + math.log10(beta)


@pytest.mark.parametrize("total", [0, 10 ** 6, 10 ** 8, 5 * 10 ** 9, 10 ** 12])
def test_suffix_tree_least_counts_do_not_depend_on_the_input(total):
    limits = suffix_tree.Limits(total, total // 100, 4)
    assert (limits.context, limits.next) == (16, 3)


def test_suffix_tree_messages_are_small():
    """What blocks and buckets send each other goes to disk at every level: keys must take less than
    their width, counts and the mass left by a context much less."""
    keys = np.sort(np.random.default_rng(1).integers(0, 1 << 32, 9000, dtype=np.uint64)).astype(np.uint32)
    packed = suffix_tree._planes(keys, True)
    assert suffix_tree._unplanes(packed, np.uint32, True).tolist() == keys.tolist()
    assert len(packed) < 3 * len(keys)
    runs = np.concatenate([keys[::3], keys[1::3], keys[2::3]])  # falls between runs
    assert suffix_tree._unplanes(suffix_tree._planes(runs, True), np.uint32, True).tolist() == runs.tolist()
    counts = np.random.default_rng(2).integers(0, 9, 9000)
    assert len(suffix_tree._planes(counts)) < len(counts)
    assert suffix_tree._unplanes(suffix_tree._planes(counts[:0]), np.int64).tolist() == []


def test_suffix_tree_edges(spark):
    got = suffix_tree.score(edge_docs(spark)).collect()
    rows = [(i, t) for i, t, _ in edge_rows()]
    assert len(got) == len(rows)
    check_base(rows, got)
    assert suffix_tree.score(empty_docs(spark)).count() == 0
    assert suffix_tree.score(docs(spark, [(10, "x", "a")]), F.lit(False)).first().n_known == 0


# ---------------------------------------------------------------- 2 toxicity
def test_toxicity_held_out(spark):
    got = {r.doc_id: r for r in toxicity.op2_toxicity(spark, SF_DIR).collect()}
    marks = read(SF_DIR, "labels", "doc_id, toxic")
    assert len(got) == len(read(SF_DIR, "documents", "doc_id"))
    held = [(got[i].predicted, y) for i, y in marks if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, _ in marks)
    assert sum(a == b for a, b in held) / len(held) > 0.95
    assert sum(a for a, b in held if b) / sum(b for _, b in held) > 0.8
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())


def test_toxicity_folding_longest_entry_and_exceptions():
    assert toxicity.fold("1D10T!") == toxicity.fold("іdіot") == toxicity.fold("idi​ot") == toxicity.fold("IDIOT")
    lex = toxicity.Lexicon({toxicity.fold("trash"): 4.0, toxicity.fold("tra")[:-1]: 1.0}, [toxicity.fold("trash can")])
    auto = lex.automaton()
    assert toxicity.measures(auto, toxicity.fold("such trash here"))[0] == 4.0
    assert toxicity.measures(auto, toxicity.fold("a trash can"))[0] == 0.0
    assert toxicity.measures(auto, toxicity.fold("a trash can of trash"))[0] == 4.0
    short, long = (toxicity.measures(auto, toxicity.fold("trash" + " word" * n))[1] for n in (3, 300))
    assert short > long
    # every match of the automaton, against a search by hand
    text = toxicity.fold("trashy tra trash! TR4SH xtrash")
    words = text.split()
    want = sum(4.0 if w == "trash" else 1.0 if w.startswith("tra") else 0.0 for w in words)
    assert toxicity.measures(auto, text)[0] == want


def test_toxicity_edges(spark):
    df = edge_docs(spark)
    marks = spark.createDataFrame([(1, 1), (5, 0), (None, 1), (8, None), (99, 1)], "doc_id long, toxic int")
    lex = toxicity.learn(df, marks)
    assert toxicity.score(df, lex).count() == len(edge_rows())
    assert toxicity.score(empty_docs(spark), lex).count() == 0
    none = toxicity.learn(empty_docs(spark), marks.limit(0))
    got = toxicity.score(df, none).collect()
    assert all(0 <= r.score < 0.5 for r in got)
    assert toxicity.keep_clean(df, none).columns == df.columns
    assert toxicity.keep_clean(df, none).count() == len(edge_rows())


# ---------------------------------------------------------------- 5 personal data
PATTERNS = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
            ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"),
            ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def plain_base(text):
    out = []
    for k, (kind, pattern) in enumerate(PATTERNS):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m.group())
            ok = {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in m.group().split(".")),
                  "card": 14 <= len(d) <= 19 and pii_crf.luhn(d), "phone": 10 <= len(d) <= 15}[kind]
            if ok:
                out.append((m.start(), k, f"{kind}:{m.start()}:{m.end()}"))
    return [s for _, _, s in sorted(out)]


TRICKY = ["a@b.c_d@e.f", "x@@y.z", "@a.b", "a@b", "a.b@c-d.e-f.g.", "1.2.3.4.5.6.7.8", "256.1.1.1 1.1.1.256", "0001.2.3.4",
          "4111 1111 1111 1111", "4111-1111-1111-1111 4111111111111112", "+1 (017) 555-7713", "+1 2", "++49 30 1234567",
          "4111111111111111 2", "é@x.y ü4111111111111111", "1" * 5000, "a" * 3000 + "@b.cc", "1.2.3.+4 555 555 5555", ""]


def test_base_spans_against_plain_patterns():
    rows = [t or "" for (t,) in read(SF_DIR, "documents", "text")]
    for t in rows + TRICKY + [" ".join(TRICKY)]:
        assert [f"{k}:{a}:{b}" for k, a, b in pii_crf.base_spans(t)] == plain_base(t)


def test_field_carries_labels_over_skip_edges(spark):
    field = pii_crf.learn(table(spark, SF_DIR, "documents"))
    text = "call +1 (017) 555-7713 now. " + "x " * 400 + "or 017 555 7713 later, not 7536784127813051 nor 999.1.1.1"
    base, spans = field.spans(text)
    assert [k for k, _, _ in base] == ["phone"]
    assert [text[a:b] for _, a, b in spans] == ["+1 (017) 555-7713", "017 555 7713"]
    alone = "or 017 555 7713 later"
    assert field.spans(alone)[1] == []


def test_propagation_is_exact_on_a_tree():
    import itertools

    import numpy as np
    rng = np.random.default_rng(3)
    unary, pairs, weight = rng.normal(size=(4, 3)), [(0, 1), (1, 2), (1, 3)], np.asarray([0.7, 1.5, -0.4])
    want = np.zeros((4, 3))
    for y in itertools.product(range(3), repeat=4):
        p = math.exp(sum(unary[i, y[i]] for i in range(4)) + sum(w for (a, b), w in zip(pairs, weight) if y[a] == y[b]))
        for i in range(4):
            want[i, y[i]] += p
    want /= want.sum(1, keepdims=True)
    assert np.allclose(pii_crf.propagate(unary, pairs, weight), want, atol=1e-4)


def test_pii_query_and_edges(spark):
    got = pii_crf.op5_pii_crf(spark, SF_DIR).collect()
    texts = dict(read(SF_DIR, "documents", "doc_id, text"))
    assert len(got) == len(texts)
    for r in got:
        base = plain_base(texts[r.doc_id] or "")
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        spans = [s for s in r.spans.split(",") if s]
        assert set(base) <= set(spans)
        assert [sum(s.startswith(k) for s in spans) for k, _ in PATTERNS] == [r.n_email, r.n_ip, r.n_card, r.n_phone]
    field = pii_crf.learn(empty_docs(spark))
    assert pii_crf.find(edge_docs(spark), field).count() == len(edge_rows())
    assert pii_crf.find(empty_docs(spark), field).count() == 0
