"""Operators 4 and 6, and the pipeline."""
import heapq
import math
import zlib
from collections import Counter
from fractions import Fraction
from types import SimpleNamespace

import numpy as np
import pytest

import corpus_pipeline
from tests.conftest import SF_DIR
from tests.llm.helpers import docs, edge_docs, edge_rows, empty_docs, read
from tonality.llm import decontaminate, grammar_output, jaccard_join, pfair, toxicity
from tonality.llm.common import saved, table


# ---------------------------------------------------------------- 4 token output
def plain_ids(texts):
    import public_tokenizers
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [e.ids + [2] for e in tok.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def check_output(rows, got):
    start, want = 0, []
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    for (i, _), ids in zip(order, plain_ids([t for _, t in order])):
        want.append((i, start, len(ids), zlib.crc32(np.asarray(ids, "<u4").tobytes())))
        start += len(ids)
    key = lambda r: r[1]
    assert sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got), key=key) == want


def test_output_round_trip(spark):
    check_output(read(SF_DIR, "documents", "doc_id, text"), grammar_output.op4_grammar_output(spark, SF_DIR).collect())


def test_output_edges(spark):
    shards = grammar_output.write_shards(edge_docs(spark), shard_tokens=500)
    assert shards.count() > 1
    check_output([(i, t) for i, t, _ in edge_rows()], grammar_output.read_documents(shards).collect())
    assert grammar_output.read_documents(grammar_output.write_shards(empty_docs(spark))).count() == 0


def test_odd_white_space_and_special_marks():
    texts = ["a\tb  c", "<|endoftext|>x y", " lead", "trail ", "x\n\ny", "a\nb c", "\n", "é　x y", "", "don't I'll x.", "a. b, c.\nd"]
    got = grammar_output.encoder().encode(texts * 3)
    assert [np.frombuffer(g, "<u4").tolist() + [2] for g in got] == plain_ids(texts * 3)


def test_new_pieces_are_encoded_together():
    """Exact ids, with one call of the tokenizer's model for the new words of many texts."""
    import public_tokenizers
    enc = grammar_output.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    rng = np.random.default_rng(3)
    parts = ["word", "Bird", "été", "x1", "it's", "well-known", "end.", "so,", "ǆ", "***", "ab$$$", "12.5", "日本", "\nNew", "\n'll", "(a"]
    texts = [" ".join(p + "q" * int(n) if p.isalpha() else p for p, n in zip(rng.choice(parts, 40), rng.integers(0, 9, 40))).strip()
             for _ in range(200)] + ["a  b", "\tword", "end. ", "a\n\nword", "<|endoftext|> word"]
    model, calls = enc.model, []
    enc.model = SimpleNamespace(encode_batch_fast=lambda *a, **k: calls.append(1) or model.encode_batch_fast(*a, **k))
    for _ in range(2):
        assert [np.frombuffer(g, "<u4").tolist() + [2] for g in enc.encode(texts)] == plain_ids(texts)
    assert len(calls) == 1


def words(n, seed=4):
    rng = np.random.default_rng(seed)
    parts = ["an", "the", "tion", "ré", "ing", "ble", "हि", "st", "日", "ou", "ly", "ha"]
    return list(dict.fromkeys("".join(rng.choice(parts, k)) for k in rng.integers(4, 8, n)))


def test_pieces_reach_the_model_in_few_strings_and_keep_their_ids():
    import public_tokenizers
    enc = grammar_output.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    new, given, model = words(3000), [], enc.model
    texts = [" ".join(new[k::20]) for k in range(20)] + ["a\x00b c", "x\x01 y\x02z", "\x02", "हिन्दी $$\nअ", "\nअ a\n\nb", "a\r\n b"]
    enc.model = SimpleNamespace(encode_batch_fast=lambda t, **k: given.extend(t) or model.encode_batch_fast(t, **k))
    assert [np.frombuffer(g, "<u4").tolist() + [2] for g in enc.encode(texts)] == plain_ids(texts)
    assert sum(len(t.split()) for t in given) < len(new) / 8


def test_forgotten_pieces_are_encoded_anew(monkeypatch):
    import public_tokenizers
    monkeypatch.setattr(grammar_output, "CACHE_PIECES", 50)
    monkeypatch.setattr(grammar_output, "JOIN_STRINGS", 7, raising=False)
    enc = grammar_output.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    for seed in (4, 5, 4, 6):
        texts = [" ".join(words(60, seed)), "a  b\t" + "  ".join(words(60, seed)), ""]
        assert [np.frombuffer(g, "<u4").tolist() + [2] for g in enc.encode(texts)] == plain_ids(texts)


def test_remembered_pieces_and_a_shards_grammar_take_little_memory():
    import tracemalloc

    import pyarrow as pa
    import public_tokenizers
    enc = grammar_output.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    new = words(30_000)
    texts = [" ".join(new[k::20]) for k in range(20)]
    enc.encode(["a b"])
    tracemalloc.start()
    arrow = pa.total_allocated_bytes()
    enc.encode(texts)
    assert tracemalloc.get_traced_memory()[0] + pa.total_allocated_bytes() - arrow < 120 * len(new)
    seq = np.tile(np.random.default_rng(5).integers(3, 900, 10_000), 100).astype(np.uint32)
    tracemalloc.reset_peak()
    before = tracemalloc.get_traced_memory()[0]
    grammar_output.compress(seq, 1000, 2)
    peak = tracemalloc.get_traced_memory()[1] - before
    tracemalloc.stop()
    assert peak < 45 * len(seq)


def test_late_rounds_look_at_few_places(monkeypatch):
    """Once all frequent pairs were counted, a round does not hash the whole shard again."""
    rng, scans, partition = np.random.default_rng(6), [], np.partition
    motif = rng.integers(3, 4000, 64)
    seq = np.concatenate([np.append(np.concatenate([rng.integers(3, 4000, 100), motif]), 2) for _ in range(200)]).astype(np.uint32)
    monkeypatch.setattr(np, "partition", lambda *a, **k: scans.append(1) or partition(*a, **k))
    symbols, rules, lengths = grammar_output.compress(seq, 4000, 2)
    assert len(scans) == 1 and len(rules) >= 63
    assert grammar_output.expand(symbols, *grammar_output.expansions(rules, lengths, 4000)).tolist() == seq.tolist()


def test_grammar_expands_and_reads_at_random():
    rng = np.random.default_rng(1)
    motif = rng.integers(3, 60, 12)
    parts = [np.concatenate([rng.integers(3, 60, rng.integers(0, 30)), motif, motif]).astype("<u4") for _ in range(300)]
    row = SimpleNamespace(**grammar_output._pack(0, 0, list(range(300)), [p.tobytes() for p in parts], 60, 2))
    shard = grammar_output.Shard(row)
    assert len(shard.symbols) < 0.6 * row.n_tokens
    for k in range(0, 300, 7):
        ids = np.append(parts[k], 2)
        assert shard.document(k).tolist() == ids.tolist()
        for a, b in ((0, 1), (3, 9), (len(ids) - 4, len(ids)), (0, len(ids))):
            assert shard.tokens(k, a, b).tolist() == ids[a:b].tolist()


def test_grammar_leaves_no_frequent_pair():
    rng = np.random.default_rng(2)
    passage = rng.integers(3, 5000, 700)
    seq = np.concatenate([np.append(np.concatenate([rng.integers(3, 5000, 20), passage]), 2) for _ in range(60)]).astype(np.uint32)
    symbols, rules, lengths = grammar_output.compress(seq, 5000, 2)
    tables = grammar_output.expansions(rules, lengths, 5000)
    assert grammar_output.expand(symbols, *tables).tolist() == seq.tolist()
    left = Counter((a, b) for a, b in zip(symbols[:-1].tolist(), symbols[1:].tolist()) if 2 not in (a, b))
    assert max(left.values()) < grammar_output.MIN_PAIR_COUNT and lengths.max() > 64
    run = np.full(1000, 7, np.uint32)
    symbols, rules, lengths = grammar_output.compress(run, 10, 2)
    assert grammar_output.expand(symbols, *grammar_output.expansions(rules, lengths, 10)).tolist() == run.tolist()


# ---------------------------------------------------------------- 6 mixing
def test_pfair_deviation_stays_below_one_block(spark):
    rows = docs(spark, [(i, f"t{i}", s) for i, s in enumerate(["a"] * 900 + ["b"] * 300 + ["c"] * 200 + ["d"] * 17)])
    weights = spark.createDataFrame([("a", 0.61), ("b", 0.3), ("c", 0.09)], "source string, weight double")
    got = pfair.schedule(rows, weights, block=1).collect()
    assert len(got) == 1417 and len({r.slot for r in got}) == 1417
    assert all(r.release <= r.slot < r.deadline for r in got)
    share = {r.source: r.n / r.q for r in pfair.shares(rows.groupBy("source").count().withColumnRenamed("count", "c"), weights).collect()}
    assert sum(share.values()) == pytest.approx(1.0)
    last = {s: max(r.slot for r in got if r.source == s) for s in share}
    at, seen = {r.slot: r.source for r in got}, Counter()
    for t in range(max(at) + 1):
        seen[at.get(t)] += 1
        for s, w in share.items():
            if t <= last[s]:
                assert abs(seen[s] - w * (t + 1)) < 1


def test_pfair_follows_the_requested_weights_over_many_cycles(spark):
    names = ["a"] * 9000 + ["b"] * 1000 + ["z"] * 40
    weights = spark.createDataFrame([("a", 0.9), ("b", 0.1), ("z", 0.0)], "source string, weight double")
    got = pfair.schedule(docs(spark, [(i, f"t{i}", s) for i, s in enumerate(names)]), weights, block=1).collect()
    at = {r.slot: r.source for r in got}
    assert len(at) == len(names) and sorted(at) == list(range(len(names)))
    assert all(r.release <= r.slot < r.deadline for r in got)
    seen = Counter()
    for t in range(10_000):
        seen[at[t]] += 1
        assert abs(seen["a"] - 0.9 * (t + 1)) < 1 and abs(seen["b"] - 0.1 * (t + 1)) < 1 and not seen["z"]


def turns(blocks, share, slot=0):
    """(source, block, slot, release, deadline) from ``slot`` on: earliest deadline first among
    the released blocks, ties to the smaller source.  Sources without a share follow at the end
    with equal ones."""
    q = math.lcm(*(w.denominator for w in share))
    n = [int(w * q) for w in share]
    start, done = slot, [0] * len(n)
    coming, ready = [(start, k) for k, x in enumerate(n) if x and blocks[k]], []
    while coming or ready:
        if not ready:
            slot = max(slot, coming[0][0])
        while coming and coming[0][0] <= slot:
            release, k = heapq.heappop(coming)
            heapq.heappush(ready, (start - (-(done[k] + 1) * q // n[k]), k, release))
        deadline, k, release = heapq.heappop(ready)
        yield k, done[k], slot, release, deadline
        done[k] += 1
        if done[k] < blocks[k]:
            heapq.heappush(coming, (start + done[k] * q // n[k], k))
        slot += 1
    last = [k for k, x in enumerate(n) if not x]
    if last:
        for k, *rest in turns([blocks[k] for k in last], [Fraction(1, len(last))] * len(last), slot):
            yield last[k], *rest


@pytest.mark.parametrize("chunk", [1024, 7])
def test_turns_equal_one_pass_over_all_blocks(spark, monkeypatch, chunk):
    monkeypatch.setattr(pfair, "CHUNK", chunk)
    counts = {"a": 60, "b": 333, "c": 1, "d": 48, "e": 16, "f": 5}
    for given in (None, {"a": 0.5, "b": 0.1, "c": 0.2, "d": 0.0, "f": 0.0}, {"a": 1e-3, "b": 1e6, "c": 3.0, "d": 0.1, "e": 0.2, "f": 1 / 3}):
        frame = spark.createDataFrame(list(counts.items()), "source string, c long")
        weights = None if given is None else spark.createDataFrame(list(given.items()), "source string, weight double")
        exact = pfair.targets(frame, weights)
        names = list(exact)
        want = [(names[k], *rest) for k, *rest in turns([-(-c // 4) for c, _ in exact.values()], [w for _, w in exact.values()])]
        got = pfair._turns(frame, weights, 4).collect()
        assert sorted(want) == sorted((r.source, r.block, r.slot, r.release, r.deadline) for r in got)
        assert len(want) == sum(-(-c // 4) for c in counts.values())


def test_schedule_runs_no_python(spark):
    rows = docs(spark, [(i, f"t{i}", "ab"[i % 2]) for i in range(200)])
    plan = pfair.schedule(rows)._jdf.queryExecution().executedPlan().toString()
    assert "InPandas" not in plan and "Python" not in plan


def test_mix_edges(spark):
    df = edge_docs(spark)
    got = pfair.schedule(df).collect()
    assert len(got) == len(edge_rows()) and {r.source for r in got} == {"", "x", "y", "z"}
    mixed = pfair.mix(df)
    assert mixed.columns == df.columns and mixed.count() == len(edge_rows())
    assert pfair.schedule(empty_docs(spark)).count() == 0 and pfair.mix(empty_docs(spark)).count() == 0
    zero = spark.createDataFrame([("x", 0.0), ("y", None)], "source string, weight double")
    assert pfair.schedule(df, zero).count() == len(edge_rows())


# ---------------------------------------------------------------- pipeline
def test_pipeline_stages_take_effect(spark):
    frame = table(spark, SF_DIR, "documents")
    columns = frame.columns
    texts = dict(read(SF_DIR, "documents", "doc_id, text"))
    ids = lambda df: [r.doc_id for r in df.select("doc_id").collect()]

    clean = saved(corpus_pipeline.drop_toxic(spark, frame, SF_DIR), "t1")
    labels = table(spark, SF_DIR, "labels").where(toxicity.remainder(5) != 0)
    lexicon = toxicity.learn(frame, labels)
    auto = lexicon.automaton()
    want = {i for i, t in texts.items() if toxicity.probability(lexicon.curve, *toxicity.measures(auto, toxicity.fold(t or ""))) < 0.5}
    assert set(ids(clean)) == want and 0.7 * len(texts) < len(want) < len(texts)

    single = saved(corpus_pipeline.drop_near_duplicates(spark, clean, SF_DIR), "t2")
    comps = {r.doc_id: r.component_id for r in jaccard_join.near_duplicates(clean).collect()}
    assert set(ids(single)) == set(comps.values())

    kept = saved(corpus_pipeline.drop_benchmark_leaks(spark, single, SF_DIR), "t3")
    items = decontaminate.Matcher([(r[0], decontaminate.normal(r[1])) for r in read(SF_DIR, "benchmark", "item_id, text")], decontaminate.ERROR_RATE)
    assert set(ids(kept)) == {i for i in ids(single) if not items.find(decontaminate.normal(texts[i]))}

    mixed = saved(corpus_pipeline.mix_sources(spark, kept, SF_DIR), "t4")
    assert sorted(ids(mixed)) == sorted(ids(kept))
    assert all(df.columns == columns for df in (clean, single, kept, mixed))
    place = {r.doc_id: (r.slot, r.idx) for r in pfair.schedule(kept).collect()}

    out = corpus_pipeline.write_tokens(spark, mixed, SF_DIR).orderBy("start").collect()
    assert [r.doc_id for r in out] == sorted(place, key=place.get)
    encoded = dict(zip(sorted(place), plain_ids([texts[i] for i in sorted(place)])))
    start = 0
    for r in out:
        assert (r.start, r.n_tokens) == (start, len(encoded[r.doc_id]))
        assert r.ids_crc32 == zlib.crc32(np.asarray(encoded[r.doc_id], "<u4").tobytes())
        start += r.n_tokens


@pytest.mark.parametrize("make", [edge_docs, empty_docs])
def test_pipeline_edges(spark, make):
    frame = saved(make(spark), "edge")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = saved(stage(spark, frame, SF_DIR), name)
        assert out.columns == frame.columns
        frame = out
    last = corpus_pipeline.STAGES[-1][1](spark, frame, SF_DIR)
    assert last.count() == frame.count()
