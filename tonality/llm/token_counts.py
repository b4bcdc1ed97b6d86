"""Token counts of documents without their token ids.

A byte-level BPE tokenizer cuts a text into pre-tokens and merges bytes inside each of them
alone, so a text's number of tokens is the sum over its distinct pre-tokens of frequency times
pieces.  Documents are read once, in blocks: each block writes its documents' pre-token
frequencies (packed) and its distinct pre-tokens.  The distinct pre-tokens of all blocks meet by
value, each is given to the tokenizer once, and the number goes back to the blocks that hold it.
There the per-document sums are taken.

Pre-tokens come from the tokenizer's own pattern.  Texts with characters that a newer or older
Unicode version may class otherwise (unassigned, recent scripts) go through the library's own
pre-tokenizer.  Special tokens inside a text are cut out first and count one each, as the
library does by default.

Defined results: a null text counts as empty, an empty text has no bytes and no tokens; a null
``doc_id`` stays null; rows that repeat a ``doc_id`` are counted each for itself; other columns
are ignored; no rows give none.  A block holds one text at least, so a task's memory grows with
the longest text and with ``BLOCK_PIECES``.
"""
from __future__ import annotations

import json
import os
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonality.llm.common import saved, ship, table, text_or_empty

TOKENIZER = "byte_bpe_50k.json"
LIMIT = 512
#: A block ends when it holds so many distinct pre-tokens, or so many pairs of document and pre-token.
BLOCK_PIECES = 400_000
BLOCK_PAIRS = 6_000_000
BATCH = 20_000

#: The pattern of byte-level BPE pre-tokens.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters outside these ranges may be classed by another Unicode version than the tokenizer's.
_SURE = ((0x0, 0x557), (0x2000, 0x208E), (0x20A0, 0xA7CD), (0xAC00, 0x107BA), (0x1E900, 0x2B739))
_UNSURE = regex.compile("[^" + "".join(f"{chr(a)}-{chr(b)}" for a, b in _SURE) + "]")

BLOCK_SCHEMA = "block long, doc_ids binary, known binary, n_bytes binary, sizes binary, gaps binary, times binary, pieces array<string>"


class PreTokenizer:
    """The pre-tokens of texts, and the pieces of pre-tokens, by a public tokenizer file."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        spec = json.loads(self.tok.to_str())
        pre = spec["pre_tokenizer"] or {}
        added = spec["added_tokens"]
        if (pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or spec["normalizer"]
                or any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in added)):
            raise ValueError("only byte-level BPE tokenizers without normalizer, prefix space or stripping special tokens")
        marks = sorted((t["content"] for t in added), key=len, reverse=True)
        self.marks = regex.compile("(" + "|".join(map(regex.escape, marks)) + ")") if marks else None
        self.find = regex.compile(PATTERN).findall
        self.library = self.tok.pre_tokenizer.pre_tokenize_str

    def _plain(self, text: str) -> list[str]:
        if text.isascii() or not _UNSURE.search(text):
            return self.find(text)
        return [text[a:b] for _, (a, b) in self.library(text)]

    def split(self, text: str) -> list[str]:
        if self.marks is None or not self.marks.search(text):
            return self._plain(text)
        out: list[str] = []
        for k, part in enumerate(self.marks.split(text)):
            out += [part] if k % 2 else self._plain(part)
        return out

    def sizes(self, pieces: list[str]) -> list[int]:
        return [len(e) for e in self.tok.encode_batch_fast(pieces, add_special_tokens=False)]


_OPEN: dict[str, PreTokenizer] = {}


def pre_tokenizer(path: str | None = None) -> PreTokenizer:
    if path is None:
        import public_tokenizers
        path = public_tokenizers.path(TOKENIZER)
    if path not in _OPEN:
        _OPEN[path] = PreTokenizer(path)
    return _OPEN[path]


def pack(values: np.ndarray) -> bytes:
    """Whole numbers below 2**32, byte planes compressed."""
    planes = values.astype("<u4").view(np.uint8).reshape(-1, 4).T
    return zstandard.ZstdCompressor(level=3).compress(planes.tobytes())


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)


class Block:
    def __init__(self):
        self.codes = defaultdict(count().__next__)
        self.ids, self.known, self.n_bytes, self.sizes, self.gaps, self.times, self.pairs = [], [], [], [], [], [], 0

    def add(self, doc_id, n_bytes: int, pieces: list[str]) -> None:
        codes, times = np.unique(np.fromiter(map(self.codes.__getitem__, pieces), np.int64, len(pieces)), return_counts=True)
        self.known.append(doc_id is not None)
        self.ids.append(doc_id or 0)
        self.n_bytes.append(n_bytes)
        self.sizes.append(len(codes))
        self.gaps.append(np.diff(codes, prepend=0))
        self.times.append(times)
        self.pairs += len(codes)

    def full(self) -> bool:
        return len(self.codes) >= BLOCK_PIECES or self.pairs >= BLOCK_PAIRS

    def row(self, block: int) -> pd.DataFrame:
        return pd.DataFrame([{
            "block": block, "doc_ids": np.asarray(self.ids, "<i8").tobytes(), "known": np.asarray(self.known, bool).tobytes(),
            "n_bytes": np.asarray(self.n_bytes, "<i8").tobytes(), "sizes": pack(np.asarray(self.sizes, np.int64)),
            "gaps": pack(np.concatenate(self.gaps)), "times": pack(np.concatenate(self.times)), "pieces": list(self.codes)}])


def frequencies(docs: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """Blocks of documents: packed per-document frequencies and the block's distinct pre-tokens."""
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    rows = rows.select("doc_id", "text", F.octet_length("text").cast("long").alias("n_bytes"))

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pre, block, seq = pre_tokenizer(tokenizer_path), Block(), TaskContext.get().partitionId() << 32
        for pdf in batches:
            ids = [None if pd.isna(i) else int(i) for i in pdf["doc_id"].astype("Int64")]
            for doc_id, n_bytes, text in zip(ids, pdf["n_bytes"].tolist(), pdf["text"].tolist()):
                block.add(doc_id, n_bytes, pre.split(text))
                if block.full():
                    yield block.row(seq)
                    block, seq = Block(), seq + 1
        if block.ids:
            yield block.row(seq)

    return rows.mapInPandas(split, BLOCK_SCHEMA)


def piece_counts(rows: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """(block, idx, n_tokens) for ``rows(block, idx, piece)``: equal pieces meet in one
    partition, sorted, and each is encoded once."""

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pre, last, size = pre_tokenizer(tokenizer_path), None, 0
        for pdf in batches:
            codes, names = pd.factorize(pdf["piece"])  # in order of appearance: the first may go on from the batch before
            todo = names.tolist()
            known = [size] if todo and todo[0] == last else []
            sizes = known + [n for lo in range(len(known), len(todo), BATCH) for n in pre.sizes(todo[lo:lo + BATCH])]
            if todo:
                last, size = todo[-1], sizes[-1]
            yield pd.DataFrame({"block": pdf["block"], "idx": pdf["idx"], "n_tokens": np.asarray(sizes, np.int64)[codes]})

    return rows.repartition("piece").sortWithinPartitions("piece").mapInPandas(measure, "block long, idx int, n_tokens long")


def _sums(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """One block's documents, with the pieces of its pre-tokens."""
    size = np.zeros(len(right), np.int64)
    size[right["idx"].to_numpy()] = right["n_tokens"].to_numpy()
    b = left.iloc[0]
    gaps, stops = unpack(b["gaps"]), np.cumsum(unpack(b["sizes"]))
    begins = np.concatenate([[0], stops[:-1]]).astype(np.int64)
    upto = np.concatenate([[0], np.cumsum(gaps)])
    codes = upto[1:] - np.repeat(upto[begins], stops - begins)
    tokens = np.concatenate([[0], np.cumsum(unpack(b["times"]) * size[codes])])
    ids = pd.Series(np.frombuffer(b["doc_ids"], "<i8")).astype("Int64").where(np.frombuffer(b["known"], bool))
    return pd.DataFrame({"doc_id": ids, "n_bytes": np.frombuffer(b["n_bytes"], "<i8"), "n_tokens": tokens[stops] - tokens[begins]})


def token_counts(docs: DataFrame, limit: int = LIMIT, tokenizer_path: str | None = None) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row of ``docs(doc_id, text)``."""
    blocks = saved(frequencies(docs, tokenizer_path), "token-blocks")
    sizes = piece_counts(blocks.select("block", F.posexplode("pieces").alias("idx", "piece")), tokenizer_path)
    packed = blocks.drop("pieces").groupBy("block")
    sums = packed.cogroup(sizes.groupBy("block")).applyInPandas(_sums, "doc_id long, n_bytes long, n_tokens long")
    return sums.withColumn("over_limit", F.col("n_tokens") > limit)


def op13_token_counts(spark, sf_dir: str) -> DataFrame:
    """Every document's bytes and tokens."""
    return token_counts(table(spark, sf_dir, "documents"))
