"""LM scoring with a probabilistic suffix tree over words.

The model's states are contexts of up to two words.  The root holds the smoothed word
frequencies.  A context becomes a state if it occurs ``LEAST_CONTEXT`` times, whatever the size of the text, and the
next-word distribution seen after it diverges from that of its suffix (the context without its first
word): the log-likelihood gained over the suffix must reach ``MIN_GAIN`` nats in all and
``MIN_DIVERGENCE`` nats an occurrence.  A state's distribution keeps the next words that are
frequent after it, less a discount, and gives the mass left to its suffix's
distribution, so every distribution sums to one over the training words, the end and one
unseen word.  Each word is scored in the longest suffix of the words before it that is a state.

Nothing of the model is gathered in one place.  Documents form blocks of bounded size.  A
block sends each distinct word and pair of words that it holds, once, to the bucket of its
hash; the bucket adds up the counts of all blocks and answers every block in the order it
asked, which the block can make again, so answers hold counts alone.  The tree then grows level by level: blocks add up, for each context, the gain over its
suffix, and buckets tell which contexts are states; only three-word sequences whose context is
frequent are counted at all.  Word counts are exact (64-bit hashes); sequences are told apart
by 32 bits within their bucket.

Defined results: a null or empty text is the end alone; a null ``doc_id`` counts as held out;
rows with the same ``doc_id`` are learned from and scored one by one; without training words
every word has the unseen word's probability; other columns are ignored.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonality.llm.common import saved, scalar, ship, table, text_or_empty

BLOCK_BYTES = 8 << 20
BUCKET_BYTES = 12 << 20
ALPHA = 0.1
DISCOUNT = 0.75
#: Least training places of a context, and of a next word after a context; they do not depend
#: on how many places there are.
LEAST_CONTEXT, LEAST_NEXT = 16, 3
MIN_GAIN, MIN_DIVERGENCE = 12.0, 0.02
FLAG_BITS = 24

_END = np.uint64(0x9B97F4A7C15F39CD)
_A, _B, _M = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB)
_MSG = "bucket long, block long, kind int, keys binary, counts binary, ones int, zeros int"
_ANSWER = "block long, bucket long, kind int, keys binary, values binary"
_WORD, _SEQUENCE, _CONTEXT, _TABLE = 1, 2, 3, 4


# ---------------------------------------------------------------- token arrays
class Tokens:
    """All tokens of some texts in one array: word hashes, each text closed by the end."""

    def __init__(self, texts):
        parts, sizes = [], []
        for t in texts:
            words = t.encode("utf-8", "surrogatepass").lower().split()
            parts.append(np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)))
            sizes.append(len(words) + 1)
            parts.append(np.asarray([_END]))
        self.size = np.asarray(sizes, np.int64)
        self.word = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        self.doc = np.repeat(np.arange(len(sizes), dtype=np.int32), self.size)
        start = np.cumsum(self.size) - self.size
        self.before = (np.arange(len(self.word)) - np.repeat(start, self.size)).astype(np.int32)  # words before it in its text

    def sequences(self) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the two and the three words that end at each place (where there are so many)."""
        two, three = np.zeros_like(self.word), np.zeros_like(self.word)
        w = self.word
        two[1:] = _mix(w[:-1] * _A + w[1:] * _B)
        three[2:] = _mix(w[:-2] * _M + w[1:-1] * _A + w[2:] * _B)
        return two, three


def _mix(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(32)
    h *= _M
    h ^= h >> np.uint64(29)
    return h


def _place(h: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket in the upper, 32 hash bits in the lower half."""
    return (((h >> np.uint64(32)) % np.uint64(buckets)) << np.uint64(32)) | (h & np.uint64(0xFFFFFFFF))


def _flag_at(word: np.ndarray) -> np.ndarray:
    return (word >> np.uint64(64 - FLAG_BITS)).astype(np.int64)


def _cut(bucket: np.ndarray) -> list[tuple[int, int]]:
    at = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])).tolist() if len(bucket) else []
    return list(zip(at, [*at[1:], len(bucket)]))


def distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values, and for each element the place of its value among them."""
    codes, values = pd.factorize(x)
    order = np.argsort(values)
    rank = np.empty(len(values), np.int64)
    rank[order] = np.arange(len(values))
    return np.asarray(values)[order], rank[codes]


def word_order(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The order in which a block sends its words, and their buckets in that order."""
    bucket = (keys >> np.uint64(32)) % np.uint64(buckets)
    order = np.argsort(bucket, kind="stable")
    return order, bucket[order]


def sequence_order(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same for sequences: by bucket, then those without, with one and with more training places."""
    bucket = keys >> np.uint64(32)
    order = np.lexsort((keys, np.minimum(counts, 2), bucket))
    return order, bucket[order]


def context_order(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The same for contexts."""
    bucket = ((keys * _A) >> np.uint64(32)) % np.uint64(buckets)
    order = np.argsort(bucket, kind="stable")
    return order, bucket[order]


class Limits:
    """What is fixed once the training words are counted; sent to all tasks."""

    def __init__(self, total: int, distinct_words: int, buckets: int, flags: np.ndarray | None = None):
        self.total, self.distinct, self.buckets, self.flags = total, distinct_words, buckets, flags
        self.context, self.next = LEAST_CONTEXT, LEAST_NEXT

    def pairs(self, t: Tokens) -> np.ndarray:
        """Places whose last two words could be a kept next word of a context."""
        next_ok, context_ok = (np.unpackbits(f).view(bool)[_flag_at(t.word)] for f in self.flags)
        return (t.before >= 1) & (next_ok | (t.word == _END)) & np.concatenate([[False], context_ok[:-1]])[:len(next_ok)]


class Lookup:
    """Values by 64-bit key; keys not held give 0."""

    def __init__(self, keys: list[np.ndarray], values: list[np.ndarray], dtype):
        k = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
        v = np.concatenate(values) if values else np.zeros(0, dtype)
        order = np.argsort(k, kind="stable")
        self.keys, self.values = k[order], v[order]
        self.filter = np.zeros(1 << 20, bool)
        self.filter[self._slot(k)] = True

    @staticmethod
    def _slot(k: np.ndarray) -> np.ndarray:
        return ((k * _A) >> np.uint64(44)).astype(np.int64)

    def get(self, wanted: np.ndarray) -> np.ndarray:
        out = np.zeros(len(wanted), self.values.dtype)
        if len(self.keys):
            at = np.flatnonzero(self.filter[self._slot(wanted)])
            found = np.minimum(np.searchsorted(self.keys, wanted[at]), len(self.keys) - 1)
            hit = self.keys[found] == wanted[at]
            out[at[hit]] = self.values[found[hit]]
        return out


# ---------------------------------------------------------------- what is sent
def _planes(x: np.ndarray, rising: bool = False) -> bytes:
    """Bytes of equal weight side by side, compressed: counts are mostly zeros there.  Of values that
    mostly rise the steps are taken, whose upper bytes are zeros."""
    if rising:
        x = np.diff(x, prepend=x[:1] * 0)
    return zstandard.ZstdCompressor(level=1).compress(x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes())


def _unplanes(b: bytes, dtype, rising: bool = False) -> np.ndarray:
    wide = np.dtype(dtype).itemsize
    x = np.ascontiguousarray(np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8).reshape(wide, -1).T).view(dtype).ravel()
    return np.cumsum(x, dtype=dtype) if rising else x


# ---------------------------------------------------------------- word counts of the training texts
def _word_counts(docs: DataFrame, buckets: int) -> DataFrame:
    """(bucket, keys, counts): the exact count of every training word, sorted by hash."""
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys, counts, held = [], [], 0

        def flush() -> Iterator[pd.DataFrame]:
            k, inverse = distinct(np.concatenate(keys))
            n = np.bincount(inverse, np.concatenate(counts)).astype(np.int64)
            bucket = (k >> np.uint64(32)) % np.uint64(buckets)
            order = np.argsort(bucket, kind="stable")
            k, n, bucket = k[order], n[order], bucket[order]
            for a, b in _cut(bucket):
                yield pd.DataFrame({"bucket": [int(bucket[a])], "keys": [_planes(k[a:b], True)], "counts": [_planes(n[a:b])]})

        for pdf in batches:
            k, codes = distinct(Tokens(pdf["text"]).word)
            n = np.bincount(codes, minlength=len(k))
            keys.append(k)
            counts.append(n)
            held += len(k)
            if held > 3_000_000:
                yield from flush()
                keys, counts, held = [], [], 0
        if held:
            yield from flush()

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        k, inverse = distinct(np.concatenate([_unplanes(x, np.uint64, True) for x in pdf["keys"]]))
        n = np.bincount(inverse, np.concatenate([_unplanes(x, np.int64) for x in pdf["counts"]])).astype(np.int64)
        return pd.DataFrame({"bucket": pdf["bucket"][:1], "keys": [_planes(k, True)], "counts": [_planes(n)],
                             "words": [len(k)], "tokens": [int(n.sum())]})

    return (docs.where("train").select("text").mapInPandas(count, "bucket long, keys binary, counts binary")
            .groupBy("bucket").applyInPandas(add, "bucket long, keys binary, counts binary, words long, tokens long"))


def _flags(words: DataFrame, limits: Limits) -> np.ndarray:
    """Two bits for each of 2**FLAG_BITS hash ranges: whether a word in it is frequent enough to be a
    state's next word, and to be a context.  A fixed size; it only saves requests that must fail."""
    def mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = np.zeros((2, 1 << FLAG_BITS), bool)
        for pdf in batches:
            for k, n in zip(pdf["keys"], pdf["counts"]):
                k, n = _unplanes(k, np.uint64, True), _unplanes(n, np.int64)
                out[0, _flag_at(k[n >= limits.next])] = True
                out[1, _flag_at(k[n >= limits.context])] = True
        bits = np.packbits(out, axis=1)
        for c in range(0, bits.shape[1], 1 << 16):
            if bits[:, c:c + (1 << 16)].any():
                yield pd.DataFrame({"chunk": [c], "bits": [bits[:, c:c + (1 << 16)].tobytes()]})

    def either(pdf: pd.DataFrame) -> pd.DataFrame:
        all_ = np.bitwise_or.reduce([np.frombuffer(b, np.uint8) for b in pdf["bits"]])
        return pd.DataFrame({"chunk": pdf["chunk"][:1], "bits": [all_.tobytes()]})

    out = np.zeros((2, (1 << FLAG_BITS) // 8), np.uint8)
    for r in words.select("keys", "counts").mapInPandas(mark, "chunk long, bits binary").groupBy("chunk").applyInPandas(
            either, "chunk long, bits binary").collect():
        part = np.frombuffer(r.bits, np.uint8).reshape(2, -1)
        out[:, r.chunk:r.chunk + part.shape[1]] = part
    return out


# ---------------------------------------------------------------- the exchanges
class Messages:
    """What one block sends to the buckets."""

    columns = ["bucket", "block", "kind", "keys", "counts", "ones", "zeros"]

    def __init__(self, block: int, buckets: int):
        self.block, self.buckets, self.rows = block, buckets, []

    def words(self, words: np.ndarray) -> None:
        keys = distinct(words)[0]
        order, bucket = word_order(keys, self.buckets)
        keys = keys[order]
        for a, b in _cut(bucket):
            self.rows.append((int(bucket[a]), self.block, _WORD, _planes(keys[a:b], True), b"", 0, 0))

    def sequences(self, places: np.ndarray, train: np.ndarray) -> None:
        keys, codes = distinct(places)
        counts = np.bincount(codes, train, len(keys)).astype(np.int64)
        order, bucket = sequence_order(keys, counts)
        keys, counts = keys[order], counts[order]
        for a, b in _cut(bucket):
            n = counts[a:b]
            self.rows.append((int(bucket[a]), self.block, _SEQUENCE, _planes(keys[a:b].astype(np.uint32), True),
                              _planes(n[n > 1].astype(np.uint32)), int((n == 1).sum()), int((n == 0).sum())))

    def contexts(self, on, context, n, share, count, below, train) -> None:
        """For each context: its count, the gain over its suffix and the mass of its kept next
        words, summed over the block's training places."""
        at = np.flatnonzero(on)
        keys, inverse = distinct(context[at])
        first = np.empty(len(keys), np.int64)
        first[inverse] = np.arange(len(at))
        use = train[at] & (share[at] > 0) & (below[at] > 0)
        weight = np.where(use, 1 - DISCOUNT / np.maximum(count[at], 1), 0.0)
        gain = np.where(use, weight * np.log(np.where(use, share[at], 1.0) / np.where(use, below[at], 1.0)), 0.0)
        sums = np.stack([n[at][first], np.bincount(inverse, gain, len(keys)), np.bincount(inverse, weight, len(keys))], 1)
        order, bucket = context_order(keys, self.buckets)
        keys, sums = keys[order], sums[order].astype(np.float32)
        for a, b in _cut(bucket):
            self.rows.append((int(bucket[a]), self.block, _CONTEXT, _planes(keys[a:b], True), _planes(sums[a:b].T.ravel()), 0, 0))

    def frame(self) -> pd.DataFrame:
        return pd.DataFrame(self.rows, columns=self.columns)


def _answers(messages: DataFrame, limits: Limits) -> DataFrame:
    """One row per block: what the buckets answer to its messages.  Words get their counts,
    sequences theirs if they are frequent enough (else 0), contexts that pass the divergence test
    the count left to the suffix (else 0), all in the order asked."""
    limits = Limits(limits.total, limits.distinct, limits.buckets)  # without the flags

    def answer(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, bucket = [], int(pdf["bucket"].iloc[0])
        kinds = {k: part for k, part in pdf.groupby("kind")}
        if _WORD in kinds:
            held = kinds.get(_TABLE, pdf.iloc[:0])
            known = Lookup([_unplanes(x, np.uint64, True) for x in held["keys"]], [_unplanes(x, np.int64) for x in held["counts"]], np.int64)
            for block, k in zip(kinds[_WORD]["block"], kinds[_WORD]["keys"]):
                rows.append((block, bucket, _WORD, b"", _planes(known.get(_unplanes(k, np.uint64, True)))))
        if _SEQUENCE in kinds:
            asked = kinds[_SEQUENCE]
            keys = [_unplanes(x, np.uint32, True) for x in asked["keys"]]
            counts = [np.concatenate([np.zeros(z, np.int64), np.ones(o, np.int64), _unplanes(c, np.uint32).astype(np.int64)])
                      for z, o, c in zip(asked["zeros"], asked["ones"], asked["counts"])]
            each, inverse = distinct(np.concatenate(keys))
            total = np.bincount(inverse, np.concatenate(counts), len(each)).astype(np.uint32)
            total = np.where(total >= limits.next, total, np.uint32(0))[inverse]
            at = 0
            for block, k in zip(asked["block"], keys):
                rows.append((block, bucket, _SEQUENCE, b"", _planes(total[at:at + len(k)])))
                at += len(k)
        if _CONTEXT in kinds:
            asked = kinds[_CONTEXT]
            keys = [_unplanes(x, np.uint64, True) for x in asked["keys"]]
            parts = np.concatenate([_unplanes(x, np.float32).reshape(3, -1).T for x in asked["counts"]]).astype(np.float64)
            each, inverse = distinct(np.concatenate(keys))
            n = np.zeros(len(each))
            n[inverse] = parts[:, 0]
            gain, mass = (np.bincount(inverse, parts[:, c], len(each)) for c in (1, 2))
            state = (gain >= MIN_GAIN) & (gain >= MIN_DIVERGENCE * n)
            # a kept next word leaves its discount, another one its count: quarters, if no hashes collide,
            # whose lower bytes are zeros once what the blocks' sums were rounded by is gone
            left = n - mass
            quarters = np.rint(4 * left) / 4
            left = np.where(np.abs(left - quarters) <= 2e-7 * n, quarters, left)
            left = np.where(state, np.clip(left, 1e-6 * n, n), 0.0)[inverse]
            at = 0
            for block, k in zip(asked["block"], keys):
                rows.append((block, bucket, _CONTEXT, b"", _planes(left[at:at + len(k)])))
                at += len(k)
        return pd.DataFrame(rows, columns=["block", "bucket", "kind", "keys", "values"])

    got = messages.groupBy("bucket").applyInPandas(answer, _ANSWER)
    # a row per block: the exchange by block is made once and serves all later levels
    return got.groupBy("block").agg(F.collect_list(F.struct("bucket", "kind", "keys", "values")).alias("got"))


class State:
    """Counts and probabilities at every place of a block, from the answers it has got: of
    each level a row (got, got2, got3)."""

    def __init__(self, pdf: pd.DataFrame, answers: pd.DataFrame, levels: list[str], limits: Limits):
        self.tokens = t = Tokens(pdf["text"])
        self.train = train = pdf["train"].to_numpy(bool)[t.doc]
        self.limits = limits
        got = {c: sorted(answers[c].iloc[0], key=lambda m: m["bucket"]) if len(answers) and answers[c].iloc[0] is not None else []
               for c in levels}

        def counted(level: str, kind: int, dtype, order: np.ndarray) -> np.ndarray:
            parts = [_unplanes(m["values"], dtype) for m in got[level] if m["kind"] == kind]
            out = np.zeros(len(order), dtype)
            out[order] = np.concatenate(parts) if parts else out[order]
            return out

        def sequences(level: str, places: np.ndarray, use: np.ndarray) -> np.ndarray:
            out = np.zeros(len(places), np.uint32)
            keys, codes = distinct(places[use])
            order, _ = sequence_order(keys, np.bincount(codes, train[use], len(keys)).astype(np.int64))
            out[use] = counted(level, _SEQUENCE, np.uint32, order)[codes]
            return out

        keys, codes = distinct(t.word)
        self.count = counted(levels[0], _WORD, np.int64, word_order(keys, limits.buckets)[0])[codes]
        self.root = (self.count + ALPHA) / (limits.total + ALPHA * (limits.distinct + 1))
        two, three = (_place(x, limits.buckets) for x in t.sequences())
        self.c2 = sequences(levels[0], two, limits.pairs(t))
        shift = lambda x: np.concatenate([x[:1] * 0, x[:-1]])
        self.ctx1, self.ctx2, self.three = shift(t.word), shift(two), three if len(levels) == 1 else None
        self.n1 = np.where(t.before >= 1, shift(self.count), 0).astype(np.float64)
        self.n2 = np.where(t.before >= 2, shift(self.c2), np.uint32(0))
        self.is1, self.is2 = self.n1 >= limits.context, self.n2 >= limits.context
        # a three-word sequence is no more frequent than its last two words
        self.ask3 = self.is2 & (self.c2 >= limits.next)
        self.c3 = sequences(levels[1], three, self.ask3) if len(levels) > 1 else np.zeros(len(three), np.uint32)
        if len(levels) > 2:
            self.left1, self.left2 = (self._left(counted, *x) for x in ((levels[1], self.is1, self.ctx1, self.n1), (levels[2], self.is2, self.ctx2, self.n2)))

    def _left(self, counted, level: str, on: np.ndarray, context: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Mass that the context before each place leaves to its suffix, 0 where it is no state."""
        at, out = np.flatnonzero(on), np.zeros(len(on))
        keys, codes = distinct(context[at])
        out[at] = counted(level, _CONTEXT, np.float64, context_order(keys, self.limits.buckets)[0])[codes] / n[at]
        return out

    def shares(self) -> tuple[np.ndarray, np.ndarray]:
        """Discounted frequencies of each word after its contexts."""
        with np.errstate(divide="ignore", invalid="ignore"):
            f1 = np.where(self.is1 & (self.c2 > 0), (self.c2 - DISCOUNT) / self.n1, 0.0)
            f2 = np.where(self.ask3 & (self.c3 > 0), (self.c3 - DISCOUNT) / self.n2, 0.0)
        return f1, f2


def score(docs: DataFrame, train=None) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_states): every
    row of ``docs`` scored by the tree learned from the rows where ``train`` is true."""
    spark = docs.sparkSession
    ship(spark)
    if train is None:
        train = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(10)) != 0
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), train.alias("train"), text_or_empty().alias("text"))
    size, n = scalar(rows, F.sum(F.length("text") + 1), F.count(F.lit(1)))
    n_blocks, buckets = max(1, -(-int(size or 0) // BLOCK_BYTES)), max(1, -(-int(size or 0) // BUCKET_BYTES))
    words = saved(_word_counts(rows, buckets), "word-counts")
    distinct_words, total = (int(x or 0) for x in scalar(words, F.sum("words"), F.sum("tokens")))
    limits = Limits(total, distinct_words, buckets)
    limits.flags = _flags(words, limits)
    held = spark.sparkContext.broadcast(limits)

    blocks = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_blocks)))
    counted = words.select("bucket", F.lit(-1).cast("long").alias("block"), F.lit(_TABLE).alias("kind"), "keys", "counts",
                           F.lit(0).alias("ones"), F.lit(0).alias("zeros"))

    def first(pdf: pd.DataFrame) -> pd.DataFrame:
        out, t = Messages(int(pdf["block"].iloc[0]), buckets), Tokens(pdf["text"])
        out.words(t.word)
        use = held.value.pairs(t)
        out.sequences(_place(t.sequences()[0], buckets)[use], pdf["train"].to_numpy(bool)[t.doc[use]])
        return out.frame()

    def second(key, pdf: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        out = Messages(int(key[0]), buckets)
        if len(pdf):
            s = State(pdf, answers, ["got"], held.value)
            out.sequences(s.three[s.ask3], s.train[s.ask3])
            out.contexts(s.is1, s.ctx1, s.n1, s.shares()[0], s.c2, s.root, s.train)
        return out.frame()

    def third(key, pdf: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        out = Messages(int(key[0]), buckets)
        if len(pdf):
            s = State(pdf, answers, ["got", "got2"], held.value)
            f1, f2 = s.shares()
            out.contexts(s.is2, s.ctx2, s.n2, f2, s.c3, f1, s.train)
        return out.frame()

    def finish(key, pdf: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf):
            return pd.DataFrame(columns=["doc_id", "train", "n_tokens", "n_known", "base_score", "score", "n_states"])
        s = State(pdf, answers, ["got", "got2", "got3"], held.value)
        f1, f2 = s.shares()
        left1, left2 = s.left1, s.left2
        on1 = left1 > 0
        on2 = on1 & (left2 > 0)
        p = np.where(on1, f1 + left1 * s.root, s.root)
        p = np.where(on2, f2 + left2 * p, p)
        doc, n = s.tokens.doc, len(pdf)
        return pd.DataFrame({
            "doc_id": pdf["doc_id"].astype("Int64").to_numpy(), "train": pdf["train"].to_numpy(), "n_tokens": s.tokens.size,
            "n_known": np.bincount(doc, s.count > 0, n).astype(np.int64), "base_score": np.bincount(doc, np.log10(s.root), n),
            "score": np.bincount(doc, np.log10(p), n), "n_states": np.bincount(doc, on1, n).astype(np.int64)})

    texts = blocks.groupBy("block")
    got1 = _answers(texts.applyInPandas(first, _MSG).unionByName(counted), limits)
    got2 = _answers(texts.cogroup(got1.groupBy("block")).applyInPandas(second, _MSG), limits).withColumnRenamed("got", "got2")
    both = got1.join(got2, "block", "left")
    got3 = _answers(texts.cogroup(both.groupBy("block")).applyInPandas(third, _MSG), limits).withColumnRenamed("got", "got3")
    out = texts.cogroup(both.join(got3, "block", "left").groupBy("block")).applyInPandas(
        finish, "doc_id long, train boolean, n_tokens long, n_known long, base_score double, score double, n_states long")
    return out.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known",
                      F.lit(total).cast("long").alias("train_tokens"), "base_score", "score", "n_states")


def op1_suffix_tree(spark, sf_dir: str) -> DataFrame:
    """All documents scored by the tree learned from nine tenths of them."""
    return score(table(spark, sf_dir, "documents"))
