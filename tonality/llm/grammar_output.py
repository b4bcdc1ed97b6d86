"""Token-ID / binary output as Re-Pair compressed shards.

Documents are sorted by ``doc_id`` (range partitions), encoded with a public tokenizer and
cut into shards of bounded size.  In each shard the most frequent adjacent id pairs are
replaced, round after round, by new symbols (nonterminals).  A shard is one row of a
Parquet table: the rules, the expansion length of every rule, the compressed symbols and,
for each document, where its symbols begin.  Any stretch of tokens of any document can be
decoded from its shard alone, without expanding the symbols before it.

Defined results: a null text counts as empty; an empty text becomes the end id alone; rows
with the same ``doc_id`` stay separate documents ordered by their text; a null ``doc_id``
sorts first; other columns are ignored; no rows give no shards.
"""
from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tonality.llm.common import saved, ship, text_or_empty
from tonality.llm.token_counts import pre_tokenizer

END_ID = 2
TOKENIZER = "byte_bpe_50k.json"
SHARD_TOKENS = 2_000_000
MIN_PAIR_COUNT = 32
PAIRS_PER_ROUND = 1024
#: What a worker process remembers: so many pieces, and as many pre-tokens.
CACHE_PIECES = 400_000
#: Texts encoded together: so many, of so many characters or a single one.
BATCH_TEXTS, BATCH_CHARS = 2_048, 6_000_000
#: New pieces in one call of the tokenizer's model, and how many of them stand between two spaces of it.
CALL_PIECES, CHUNK_PIECES = 10_000, 16
#: Strings whose ids are joined at once.
JOIN_STRINGS = 100_000

SHARD_SCHEMA = ("part int, seq int, n_docs long, n_tokens long, terminals int, doc_ids binary, symbol_starts binary, "
                "token_counts binary, rules binary, rule_lengths binary, symbols binary")
_BUCKET_BITS = 18


# ---------------------------------------------------------------- encoding
class Known:
    """Ids of the strings met before: string ``keys[k]`` has ``flat[starts[k]:starts[k + 1]]``."""

    def __init__(self):
        self.keys, self.flat, self.starts = pa.array([], pa.string()), np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def meet(self, strings: pa.StringArray) -> pa.StringArray:
        """The distinct ones of these strings that are new."""
        met = strings.dictionary_encode()
        self.codes, self.met = met.indices.to_numpy(), met.dictionary
        place = pc.index_in(self.met, value_set=self.keys)
        new = place.is_null()
        self.place = np.where(new.to_numpy(zero_copy_only=False), -1, place.fill_null(0).to_numpy())
        self.new = self.met.filter(new)
        return self.new

    def ids(self, new_flat: np.ndarray, new_sizes: np.ndarray, counts: np.ndarray) -> tuple[bytes, list[int]]:
        """(ids, ends): the ids of all strings met last, ``counts`` strings for each text, and where a text's bytes end;
        the new ones' ids are given."""
        missing = self.place < 0
        self.place[missing] = len(self.keys) + np.arange(len(self.new))
        self.keys = pa.concat_arrays([self.keys, self.new])
        self.flat = np.concatenate([self.flat, new_flat])
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(new_sizes)])
        start, size = self.starts[:-1][self.place], np.diff(self.starts)[self.place]
        raw = b"".join(expand(self.codes[k:k + JOIN_STRINGS], start, size, self.flat).astype("<u4", copy=False).tobytes()
                       for k in range(0, len(self.codes), JOIN_STRINGS))
        ends = np.concatenate([[0], np.cumsum(size[self.codes])])[np.cumsum(counts)] * 4
        if len(self.keys) > CACHE_PIECES:  # only what was met last stays
            self.flat = expand(np.arange(len(size)), start, size, self.flat)
            self.keys, self.starts = self.met, np.concatenate([[0], np.cumsum(size)])
        self.codes = self.met = self.place = self.new = None
        return raw, ends.tolist()


class Encoder:
    """Exact ids of a byte-level BPE tokenizer, with the ids of pieces remembered.

    The tokenizer cuts a text before a single space or line break that stands between two
    other characters; what stands between such cuts is a piece.  Arrow cuts a batch of texts into
    pieces and finds the distinct ones; new ones are cut into the tokenizer's pre-tokens, and its
    model encodes those of the batch together, parted by two characters that it never merges.
    Texts with any other white space are cut into pre-tokens at once; those with the mark of a special
    token or with one of the parting characters, and all texts of tokenizers of other kinds, are encoded whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit
        try:
            self.pre = pre_tokenizer(path)
        except ValueError:
            self.pre = None
        self.tok = self.pre.tok if self.pre else Tokenizer.from_file(path)
        self.size = max(self.tok.get_vocab(with_added_tokens=True).values()) + 1
        bpe, vocab = self.tok.model, self.tok.get_vocab(with_added_tokens=False)
        merged = set("".join(piece for piece in vocab if len(piece) > 1))
        free = [b for b in _CONTROLS if _BYTE_LEVEL[b] in vocab and _BYTE_LEVEL[b] not in merged]
        if (len(free) < 3 or type(bpe).__name__ != "BPE" or bpe.dropout or bpe.ignore_merges or bpe.unk_token
                or bpe.continuing_subword_prefix or bpe.end_of_word_suffix):
            self.pre = None
        if self.pre:
            self.model = Tokenizer(bpe)  # for pre-tokens in byte-level characters, none of which is white space
            self.model.pre_tokenizer = WhitespaceSplit()
            self.inner, self.end, self.gap = map(chr, free[:3])
            self.inner_id, self.end_id = (vocab[_BYTE_LEVEL[b]] for b in free[:2])
            self.chars = np.asarray([ord(_BYTE_LEVEL[b]) for b in range(256)], "<u4")
            self.chars[free[2]] = ord(" ")
        self.pieces, self.parts = Known(), Known()

    def whole(self, text: str) -> bytes:
        return np.asarray(self.tok.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4").tobytes()

    def _special(self, t: str) -> bool:
        return (self.pre.marks is not None and self.pre.marks.search(t) is not None
                or self.inner in t or self.end in t or self.gap in t)

    def _cut(self, pieces: list[str]) -> str:
        """The pre-tokens of each of these pieces.  In the text of all of them each begins with a space; the
        space before a line feed is a pre-token of its own, and dropped."""
        cut = self.inner + self.inner.join(self.pre._plain(" " + " ".join(pieces)))
        return cut.replace(f"{self.inner} {self.inner}\n", self.end + "\n").replace(self.inner + " ", self.end + " ")[1:]

    def _learn(self, pieces: list[str], parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, sizes): ids of these pieces and pre-tokens one after the other, and how many each has."""
        found = [(np.zeros(0, np.uint32), np.zeros(0, np.int64))]
        for lo in range(0, len(pieces) + len(parts), CALL_PIECES):
            some, more = pieces[lo:lo + CALL_PIECES], parts[max(0, lo - len(pieces)):max(0, lo + CALL_PIECES - len(pieces))]
            text = self.end.join(([self._cut(some)] if some else []) + more) + self.end
            raw = np.frombuffer(text.encode(), np.uint8)
            ends = np.flatnonzero(raw == ord(self.end))
            raw = np.insert(raw, ends[CHUNK_PIECES - 1::CHUNK_PIECES] + 1, ord(self.gap))
            text = self.chars[raw].tobytes().decode("utf-32-le")
            ids = np.asarray(self.model.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
            kept = (ids != self.end_id) & (ids != self.inner_id)
            stops = np.cumsum(kept)[ids == self.end_id]
            if len(stops) == len(some) + len(more):
                found.append((ids[kept], np.diff(stops, prepend=0)))
            else:
                raw = [self.whole(t) for t in [p if p[0] == "\n" else " " + p for p in some] + more]
                found.append((np.frombuffer(b"".join(raw), "<u4"), np.asarray([len(r) // 4 for r in raw], np.int64)))
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])

    def encode(self, texts: list[str]) -> list[bytes]:
        rests, n_rest, parts, n_parts, whole = [], [], [], [], {}
        for k, t in enumerate(texts):
            rest, of = "", []
            if t:
                if self.pre is None or self._special(t):
                    whole[k] = self.whole(t)
                elif regular(t):
                    first, _, rest = t.replace("\n", " \n").partition(" ")
                    of = self.pre._plain(first)
                else:
                    of = self.pre._plain(t)
            if rest:
                rests.append(rest)
            n_rest.append(bool(rest))
            parts += of
            n_parts.append(len(of))
        cuts = pc.split_pattern(pa.array(rests, pa.string()), " ")
        n_pieces = np.zeros(len(texts), np.int64)
        n_pieces[np.asarray(n_rest, bool)] = cuts.value_lengths().to_numpy()
        pieces, parts = self.pieces.meet(cuts.flatten()), self.parts.meet(pa.array(parts, pa.string()))
        ids, sizes = self._learn(pieces.to_pylist(), parts.to_pylist())
        at, n = len(pieces), int(sizes[:len(pieces)].sum())
        of_parts, part_ends = self.parts.ids(ids[n:], sizes[at:], np.asarray(n_parts, np.int64))
        of_pieces, piece_ends = self.pieces.ids(ids[:n], sizes[:at], n_pieces)
        out = [of_parts[a:b] + of_pieces[c:d] for a, b, c, d in zip([0, *part_ends], part_ends, [0, *piece_ends], piece_ends)]
        for k, got in whole.items():
            out[k] = got
        return out


def _byte_level() -> dict[int, str]:
    """The characters by which byte-level tokenizers name bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


_BYTE_LEVEL = _byte_level()
#: Control characters that are not white space.
_CONTROLS = (*range(9), *range(0x0E, 0x1C), 0x7F)


#: White space other than the space and the line feed.
_ODD = tuple(chr(c) for c in (9, 11, 12, 13, 0x1C, 0x1D, 0x1E, 0x1F, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
                              0x2028, 0x2029, 0x202F, 0x205F, 0x3000))


def regular(t: str) -> bool:
    """Whether all white space of ``t`` is single spaces or line feeds between other characters."""
    return not (t[0] in " \n" or t[-1] in " \n" or "  " in t or " \n" in t or "\n " in t or "\n\n" in t
                or any(c in t for c in _ODD))


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str | None = None) -> Encoder:
    """The encoder of this worker process; ``path`` defaults to the public tokenizer file."""
    if path is None:
        import public_tokenizers
        path = public_tokenizers.path(TOKENIZER)
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


# ---------------------------------------------------------------- grammar
def compress(seq: np.ndarray, terminals: int, end_id: int = END_ID) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Re-Pair: (symbols, rules, rule_lengths).  Symbol ``terminals + r`` stands for
    ``rules[r]``.  Each round replaces the most frequent pairs, up to ``PAIRS_PER_ROUND``, at once,
    from left to right, without overlaps, until no pair occurs ``MIN_PAIR_COUNT`` times.  The end id is never part of a rule, so no rule spans documents."""
    seq = seq.astype(np.uint32)
    rules: list[np.ndarray] = []
    n_rules, lengths, at = 0, np.ones(terminals, np.uint32), None
    while len(seq) >= 2:
        if at is None:
            bucket = seq[:-1] * np.uint32(0x9E3779B1)
            bucket += seq[1:] * np.uint32(0x85EBCA77)
            bucket >>= np.uint32(32 - _BUCKET_BITS)
            ends = np.flatnonzero(seq == end_id)
            bucket[ends[ends < len(bucket)]] = bucket[ends[ends > 0] - 1] = 1 << _BUCKET_BITS
            # a pair cannot be more frequent than its bucket: pairs of emptier buckets need no count of their own
            counts = np.bincount(bucket, minlength=(1 << _BUCKET_BITS) + 1)
            counts[-1] = 0
            floor = max(MIN_PAIR_COUNT, int(np.partition(counts, -2 * PAIRS_PER_ROUND)[-2 * PAIRS_PER_ROUND]))
        while True:
            if at is None:
                at = np.flatnonzero(np.take(counts >= floor, bucket))
            pairs = seq[at].astype(np.uint64)
            pairs <<= np.uint64(32)
            pairs |= seq[at + 1]
            found = pa.array(pairs).dictionary_encode()
            codes, each, pairs = found.indices.to_numpy(), found.dictionary.to_numpy(), None
            n = np.bincount(codes, minlength=len(each))
            order = np.argsort(-n, kind="stable")[:PAIRS_PER_ROUND]
            order = order[n[order] >= MIN_PAIR_COUNT]
            least = int(n[order[-1]]) if len(order) == PAIRS_PER_ROUND else MIN_PAIR_COUNT
            if least >= floor:  # pairs of the buckets left out are less frequent than all of these
                break
            floor, at = least, None
        if not len(order):
            break
        bucket = None
        rule_of = np.full(len(each), -1, np.int32)
        rule_of[order] = np.arange(len(order))
        rule = rule_of[codes]
        places = at[n[codes] >= MIN_PAIR_COUNT] if floor == MIN_PAIR_COUNT else None
        at, rule = at[rule >= 0], rule[rule >= 0]
        begins = np.concatenate([[True], np.diff(at) != 1])  # runs of overlapping places: take every other one
        index = np.arange(len(at))
        take = (index - np.maximum.accumulate(np.where(begins, index, 0))) % 2 == 0
        at, rule = at[take], rule[take]
        used = np.bincount(rule, minlength=len(order)) > 0  # others may have taken all places of a pair
        rule = (np.cumsum(used) - 1)[rule]
        pair, order = each[order][used], np.flatnonzero(used)
        left, right = (pair >> np.uint64(32)).astype(np.uint32), (pair & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        lengths = np.concatenate([lengths, lengths[left] + lengths[right]])
        seq[at] = terminals + n_rules + rule
        rules.append(np.stack([left, right], 1))
        n_rules += len(order)
        gone = np.ones(len(seq), bool)
        gone[at + 1] = False
        seq = seq[gone]
        if places is None:
            at = None
        else:  # a pair frequent from now on was so before or holds a new symbol: only these places are looked at
            made = at - np.arange(len(at))
            places = places[gone[places]]
            places = places - np.searchsorted(at + 1, places)
            at = np.union1d(places, np.concatenate([made - 1, made]))
            at = at[(at >= 0) & (at < len(seq) - 1)]
            at = at[(seq[at] != end_id) & (seq[at + 1] != end_id)]
    return seq, np.concatenate(rules) if rules else np.zeros((0, 2), np.uint32), lengths[terminals:]


def expansions(rules: np.ndarray, lengths: np.ndarray, terminals: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, flat): symbol s expands to ``flat[start[s]:start[s] + length[s]]``."""
    size = np.concatenate([np.ones(terminals, np.int64), lengths.astype(np.int64)])
    start = np.cumsum(size) - size
    flat = np.empty(int(size.sum()), np.uint32)
    flat[:terminals] = np.arange(terminals)
    for r, (a, b) in enumerate(rules.tolist()):
        s = start[terminals + r]
        flat[s:s + size[a]] = flat[start[a]:start[a] + size[a]]
        flat[s + size[a]:s + size[a] + size[b]] = flat[start[b]:start[b] + size[b]]
    return start, size, flat


def expand(symbols: np.ndarray, start: np.ndarray, size: np.ndarray, flat: np.ndarray) -> np.ndarray:
    n = size[symbols]
    stops = np.cumsum(n)
    shift = np.repeat(start[symbols] - (stops - n), n)
    return flat[shift + np.arange(stops[-1] if len(stops) else 0)]


class Shard:
    """One stored row, opened for reading."""

    def __init__(self, row):
        wide = row.terminals + len(row.rule_lengths) // 4 > 65536
        self.doc_ids = np.frombuffer(row.doc_ids, "<i8")
        self.starts = np.frombuffer(row.symbol_starts, "<i8")
        self.counts = np.frombuffer(row.token_counts, "<i8")
        self.symbols = np.frombuffer(row.symbols, "<u4" if wide else "<u2")
        rules = np.frombuffer(row.rules, "<u4").reshape(-1, 2)
        self.tables = expansions(rules, np.frombuffer(row.rule_lengths, "<u4"), row.terminals)

    def document(self, k: int) -> np.ndarray:
        return expand(self.symbols[self.starts[k]:self.starts[k + 1]], *self.tables)

    def tokens(self, k: int, begin: int, end: int) -> np.ndarray:
        """Tokens [begin, end) of document k: the expansion lengths tell which symbols hold them."""
        syms = self.symbols[self.starts[k]:self.starts[k + 1]]
        stops = np.cumsum(self.tables[1][syms])
        first, last = np.searchsorted(stops, begin, "right"), np.searchsorted(stops, end, "left")
        part = expand(syms[first:last + 1], *self.tables)
        base = int(stops[first - 1]) if first else 0
        return part[begin - base:end - base]


def _pack(part: int, seq: int, ids: list, chunks: list[bytes], terminals: int, end_id: int) -> dict:
    end = np.asarray([end_id], "<u4").tobytes()
    counts = np.asarray([len(c) // 4 + 1 for c in chunks], "<i8")
    symbols, rules, lengths = compress(np.frombuffer(end.join(chunks) + end, "<u4"), terminals, end_id)
    size = np.concatenate([np.ones(terminals, np.int64), lengths.astype(np.int64)])
    stops = np.cumsum(size[symbols])
    starts = np.concatenate([[0], np.searchsorted(stops, np.cumsum(counts)) + 1]).astype("<i8")
    wide = terminals + len(rules) > 65536
    return {"part": part, "seq": seq, "n_docs": len(ids), "n_tokens": int(counts.sum()), "terminals": terminals,
            "doc_ids": np.asarray(ids, "<i8").tobytes(), "symbol_starts": starts.tobytes(),
            "token_counts": counts.tobytes(), "rules": rules.astype("<u4").tobytes(),
            "rule_lengths": lengths.astype("<u4").tobytes(),
            "symbols": symbols.astype("<u4" if wide else "<u2").tobytes()}


_NULL_ID = -(1 << 63)


def _row(shard: dict) -> pa.RecordBatch:
    types = {"part": pa.int32(), "seq": pa.int32(), "terminals": pa.int32(), "n_docs": pa.int64(), "n_tokens": pa.int64()}
    return pa.RecordBatch.from_arrays([pa.array([v], types.get(k, pa.binary())) for k, v in shard.items()], names=list(shard))


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Rows that are encoded together."""
    ends, lo = np.cumsum(pc.binary_length(batch.column("text")).to_numpy()), 0
    while lo < len(ends):
        before = int(ends[lo - 1]) if lo else 0
        hi = int(np.searchsorted(ends, before + BATCH_CHARS, "right"))
        hi = max(lo + 1, min(hi, lo + BATCH_TEXTS))
        yield batch.slice(lo, hi - lo)
        lo = hi


def write_shards(docs: DataFrame, order: list[str] | None = None, tokenizer_path: str | None = None,
                 end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Encode ``docs(doc_id, text)`` in ``order`` (default: ascending ``doc_id``) and write
    the shards to the shared folder; returns the written table.  Shards follow each other
    by (part, seq)."""
    ship(docs.sparkSession)
    keys = order or ["doc_id"]
    rows = docs.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keys)], F.col("doc_id").cast("long").alias("doc_id"),
                       text_or_empty().alias("text"))
    names = [f"_k{i}" for i in range(len(keys))]
    rows = rows.repartitionByRange(*names).sortWithinPartitions(*names, "doc_id", "text").select("doc_id", "text")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, seq, ids, chunks, held = encoder(tokenizer_path), TaskContext.get().partitionId(), 0, [], [], 0
        terminals = max(enc.size, end_id + 1)
        for batch in batches:
            for some in _slices(batch):
                got = some.column("doc_id").fill_null(_NULL_ID).to_pylist()
                for i, c in zip(got, enc.encode(some.column("text").to_pylist())):
                    ids.append(i)
                    chunks.append(c)
                    held += len(c) // 4 + 1
                    if held >= shard_tokens:
                        yield _row(_pack(part, seq, ids, chunks, terminals, end_id))
                        seq, ids, chunks, held = seq + 1, [], [], 0
        if ids:
            yield _row(_pack(part, seq, ids, chunks, terminals, end_id))
        pa.default_memory_pool().release_unused()

    return saved(rows.mapInArrow(pack, SHARD_SCHEMA), "token-shards")


def read_documents(shards: DataFrame) -> DataFrame:
    """Decode every document of a written shard table: (doc_id, start, n_tokens, ids_crc32);
    ``start`` counts the ids of all documents before it."""
    ship(shards.sparkSession)
    # running sums in two steps: over the parts (as many as write tasks), then within each part
    meta = shards.select("part", "seq", "n_tokens")
    parts = meta.groupBy("part").agg(F.sum("n_tokens").alias("_n"))
    parts = parts.select("part", (F.sum("_n").over(Window.orderBy("part")) - F.col("_n")).alias("_base"))
    within = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("seq")) - F.col("n_tokens")
    bases = meta.select("part", "seq", within.alias("_in")).join(parts, "part").select(
        "part", "seq", (F.col("_in") + F.col("_base")).alias("_shard_start"))

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                shard = Shard(row)
                ids = expand(shard.symbols, *shard.tables).astype("<u4")
                stops = np.cumsum(shard.counts)
                begins = stops - shard.counts
                crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(begins.tolist(), stops.tolist())]
                yield pd.DataFrame({"part": row.part, "seq": row.seq, "doc_id": shard.doc_ids, "_at": begins,
                                    "n_tokens": shard.counts, "ids_crc32": np.asarray(crc, np.int64)})

    out = shards.drop("n_docs", "n_tokens").mapInPandas(
        decode, "part int, seq int, doc_id long, _at long, n_tokens long, ids_crc32 long")
    doc_id = F.when(F.col("doc_id") != F.lit(_NULL_ID), F.col("doc_id"))
    return out.join(bases, ["part", "seq"]).select(
        doc_id.alias("doc_id"), (F.col("_shard_start") + F.col("_at")).alias("start"), "n_tokens", "ids_crc32")


def op4_grammar_output(spark, sf_dir: str) -> DataFrame:
    """Write all documents as Re-Pair shards and read them back."""
    from tonality.llm.common import table
    return read_documents(write_shards(table(spark, sf_dir, "documents")))
