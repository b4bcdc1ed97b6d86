"""Operator 13 against the tokenizers library."""
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tests.conftest import SF_DIR
from tests.llm.helpers import docs, edge_docs, edge_rows, empty_docs, read
from tonality.llm import token_counts as tc


@pytest.fixture(scope="module")
def tok():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def plain(tok, text):
    return len(tok.encode(text or "", add_special_tokens=False).ids)


def test_whole_table_matches_the_library(spark, tok):
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in tc.op13_token_counts(spark, SF_DIR).collect()}
    want = {}
    for i, text in read(SF_DIR, "documents", "doc_id, text"):
        n = plain(tok, text)
        want[i] = (len((text or "").encode()), n, n > 512)
    assert got == want


def test_special_strings_white_space_and_rare_scripts(spark, tok):
    texts = ["<|endoftext|>", "a <|endoftext|> b  <|endoftext|>", "  x\n\n y's  ", "՘ՙx \U00010940 ok", "'''s re's DON'T don't",
             " wide space　", "1234567 ١٢ ½", "\x00\x1f\x85 ​﻿", "tab\t\tend\r\n", "\U0001f600\U0001f468‍\U0001f469"]
    got = {r.doc_id: r.n_tokens for r in tc.token_counts(docs(spark, [(i, t, "x") for i, t in enumerate(texts)])).collect()}
    assert got == {i: plain(tok, t) for i, t in enumerate(texts)}


def test_pre_tokens_of_all_sure_characters_match_the_library(tok):
    pre = tc.PreTokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    for a, b in tc._SURE:
        for lo in range(a, b + 1, 4096):
            chars = [chr(c) for c in range(lo, min(lo + 4096, b + 1)) if not 0xD800 <= c < 0xE000]
            for shape in ("a{}a ", "1{}1 ", " {}\n"):
                text = "".join(shape.format(c) for c in chars)
                assert pre.find(text) == [text[x:y] for _, (x, y) in pre.library(text)]


def test_edges_many_blocks_and_repeats(spark, tok, monkeypatch):
    rows = tc.token_counts(edge_docs(spark)).collect()
    want = sorted((str(i), plain(tok, t)) for i, t, _ in edge_rows())
    assert sorted((str(r.doc_id), r.n_tokens) for r in rows) == want
    assert tc.token_counts(empty_docs(spark)).collect() == []


def test_small_blocks(spark, tok):
    block = tc.Block()
    assert block.pairs == 0 and not block.full()
    texts = [f"word{i % 7} the the {i}" for i in range(40)] + ["", "the"]
    pre = tc.PreTokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    for i, t in enumerate(texts):
        block.add(i if i % 5 else None, len(t), pre.split(t))
    import pandas as pd
    names = list(block.codes)
    right = pd.DataFrame({"idx": range(len(names)), "n_tokens": pre.sizes(names)}).sample(frac=1.0, random_state=1)
    out = tc._sums(block.row(0), right)
    assert out["n_tokens"].tolist() == [plain(tok, t) for t in texts]
    assert [None if pd.isna(x) else x for x in out["doc_id"]] == [i if i % 5 else None for i in range(len(texts))]


def test_each_pre_token_is_encoded_once(spark):
    rows = spark.createDataFrame([(b, i, p) for b in range(30) for i, p in enumerate([" the", " of", "x", "\n"])], "block long, idx int, piece string")
    got = tc.piece_counts(rows).collect()
    assert len(got) == 120 and {r.n_tokens for r in got} == {1}
