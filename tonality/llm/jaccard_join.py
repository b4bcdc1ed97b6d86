"""Exact Jaccard join of documents on word shingles, by signature trees.

A document's set holds its distinct five-word shingles as 64-bit hashes.  Documents with one
and the same set form a class; only classes are compared.

1. Prefix keys.  Two sets that are similar enough share one of the first
   ``n - ceil(t * n) + 1`` shingles in any common order, so classes meet only where such a key
   is equal.  The order puts frequent shingles last; they are told by a sketch of fixed size
   over all documents.  Keys travel as packed arrays, one message per task and bucket.
2. Hubs.  Every class is verified against the class that it shares most groups with, which
   joins most large groups of copies along stars, without pairs inside them.
3. Signature trees.  In each key group whose classes are not all joined yet, a tree over the
   classes holds in its nodes the OR of their bitmaps and their size ranges.  The tree is
   traversed against itself; pairs of nodes are cut where the largest possible overlap is too
   small, or where all classes below are already joined.  Of the pairs that are left a task
   gives a spanning forest, fewer than the classes it holds, whatever the number of pairs.
   Large groups are cut into blocks, and only pairs of blocks with more than one component meet.
4. Clusters.  The forests' connected classes form a cluster, so both classes of every pair that
   the signatures allow are in one.  The full sets of a cluster meet in a task (of a large one
   those of two blocks): a tree over them gives the pairs again, each is verified where its
   classes are not joined yet, and links that join something are given.

So the components are exact, but links inside a component are not all looked for; ``join``
verifies those too and gives every link.

Candidates are verified on the full sets, so the links are exact: a key, bitmap or group
collision can only add a candidate.

Defined results: texts without words (null, empty) have an empty set and link with nothing;
a text of fewer words than a shingle has one shingle, its whole word sequence; rows with the
same ``doc_id`` are documents of their own; a null ``doc_id`` takes part but never names a
component if the component has another; other columns are ignored.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonality.llm.common import saved, scalar, ship, table, text_or_empty
from tonality.llm.graph import components

SHINGLE = 5
#: Similarity bound as a fraction.
T_NUM, T_DEN = 4, 5
#: Bits of a signature; larger sets get the power of two from twice their size on.
BITS = 2048
SKETCH_BITS = 20
SKETCH_CHUNK = 1 << 16
KEYS_PER_BUCKET = 400_000
KEYS_PER_MESSAGE = 1_000_000
ROWS_PER_BIN = 60_000
#: Classes of a block; where full sets meet, a class counts once for every SET_UNIT shingles begun.
BLOCK = 4096
SET_UNIT = 512
MARKS = 1 << 23
FANOUT = 16

_C = np.random.default_rng(5).integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)  # odd factors, fixed by the seed


# ---------------------------------------------------------------- sets and signatures
def shingles(text: str, width: int = SHINGLE) -> np.ndarray:
    """Sorted distinct shingle hashes of a text."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    if len(h) < width:
        out = np.add.reduce(h * _C[:len(h)], keepdims=True) + _C[63:] * np.asarray([len(h)], np.uint64)
    else:
        out = np.zeros(len(h) - width + 1, np.uint64)
        for k in range(width):
            out += h[k:len(h) - width + 1 + k] * _C[k]
    out ^= out >> np.uint64(32)
    out *= _C[62]
    out ^= out >> np.uint64(29)
    return np.unique(out)


def class_id(s: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes())).view(np.int64))


def bitmap(s: np.ndarray) -> np.ndarray:
    """Signature of a set; a wider one folds to a narrower by the OR of its parts."""
    wide = max(BITS, 1 << int(2 * len(s) - 1).bit_length() if len(s) else 0)
    flags = np.zeros(wide, np.uint8)
    flags[(((s * _C[61]) >> np.uint64(32)) & np.uint64(wide - 1)).astype(np.int64)] = 1
    return np.packbits(flags, bitorder="little").view(np.uint64)


def folded(b: bytes, size: int) -> np.ndarray:
    a = np.frombuffer(b, np.uint64)
    return a if len(b) == size else np.bitwise_or.reduce(a.reshape(-1, size // 8), axis=0)


def matrix(bits: list[bytes]) -> np.ndarray:
    """Signatures as rows, folded to the narrowest."""
    size = min(map(len, bits), default=BITS // 8)
    return np.frombuffer(b"".join([b if len(b) == size else folded(b, size).tobytes() for b in bits]), np.uint64).reshape(-1, size // 8)


def apart(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """At least so many elements are in one set of a pair only, for pairs of signatures."""
    out = np.zeros(len(a), np.int64)
    size = np.minimum([len(x) for x in a], [len(x) for x in b]) if len(a) else np.zeros(0, int)
    for n in np.unique(size):
        for at in np.array_split(np.flatnonzero(size == n), 1 + int((size == n).sum() * n) // (1 << 24)):
            x, y = (np.stack([folded(v[i], int(n)) for i in at]) for v in (a, b))
            out[at] = np.bitwise_count(x ^ y).sum(1, dtype=np.int64)
    return out


#: Ratio of neighbouring size classes, and the classes within which similar sets lie.
SIZE_STEP = 1.05
SIZE_REACH = int(np.ceil(np.log(T_DEN / T_NUM) / np.log(SIZE_STEP)))


def size_class(n: int) -> int:
    return min(255, int(np.log(n) / np.log(SIZE_STEP)))


def prefix_length(n: int) -> int:
    return n - -(-T_NUM * n // T_DEN) + 1


def _signatures(docs: DataFrame) -> DataFrame:
    """One row per document (doc_id, _row, n, node, bits), and per task the chunks of its
    sketch (chunk, counts) of in how many documents hashed shingles occur."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sketch = np.zeros(1 << SKETCH_BITS, np.int32)
        for pdf in batches:
            sets = [shingles(t) for t in pdf["text"]]
            for s in sets:
                np.add.at(sketch, (s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), 1)
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "_row": pdf["_row"], "n": [len(s) for s in sets],
                                "node": [class_id(s) for s in sets], "bits": [bitmap(s).tobytes() for s in sets],
                                "chunk": np.int32(-1), "counts": None, "way": np.int32(0)})
        way = TaskContext.get().partitionId() % 1024
        for c in range(0, len(sketch), SKETCH_CHUNK):
            yield pd.DataFrame({"doc_id": pd.array([None], "Int64"), "_row": [0], "n": [0], "node": [0], "bits": [None],
                                "chunk": np.int32(c // SKETCH_CHUNK), "counts": [sketch[c:c + SKETCH_CHUNK].tobytes()],
                                "way": np.int32(way)})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_or_empty()).alias("_row"),
                       text_or_empty().alias("text"))
    return rows.mapInPandas(run, "doc_id long, _row long, n int, node long, bits binary, chunk int, counts binary, way int")


def _frequent(signatures: DataFrame) -> np.ndarray:
    """One flag for each counter of the sketch: whether it is far above the mean."""
    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(SKETCH_CHUNK, np.int64)
        for c in pdf["counts"]:
            part = np.frombuffer(c, np.int32 if len(c) == 4 * SKETCH_CHUNK else np.int64)
            total += part
        return pd.DataFrame({"chunk": pdf["chunk"][:1], "way": np.int32(0), "counts": [total.tobytes()]})

    parts = signatures.where("chunk >= 0").select("chunk", "way", "counts")
    for keys in (["chunk", "way"], ["chunk"]):
        parts = parts.groupBy(*keys).applyInPandas(add, "chunk int, way int, counts binary")
    out = np.zeros(1 << SKETCH_BITS, np.int64)  # a fixed size, whatever the input
    for r in parts.collect():
        out[r.chunk * SKETCH_CHUNK:(r.chunk + 1) * SKETCH_CHUNK] = np.frombuffer(r.counts, np.int64)
    mean = out.mean()
    return out > mean + max(6 * mean ** 0.5, 64)


# ---------------------------------------------------------------- groups of classes that share a key
def _groups(docs: DataFrame, frequent: np.ndarray, buckets: int) -> DataFrame:
    """(gid, node): the classes that share a prefix key and are near enough in size to another
    of them; equal groups have one gid."""
    held = docs.sparkSession.sparkContext.broadcast(np.packbits(frequent))

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        flags = np.unpackbits(held.value).view(bool)
        found, nodes, sizes, size = [], [], [], 0

        def flush() -> Iterator[pd.DataFrame]:
            k, n, c = (np.concatenate(x) for x in (found, nodes, sizes))
            bucket = ((k >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
            order = np.lexsort((n, k, bucket))
            k, n, c, bucket = k[order], n[order], c[order], bucket[order]
            new = np.concatenate([[True], (k[1:] != k[:-1]) | (n[1:] != n[:-1])])
            k, n, c, bucket = k[new].astype(np.uint32), n[new], c[new], bucket[new]
            at = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
            for a, b in zip(at.tolist(), [*at[1:].tolist(), len(k)]):
                yield pd.DataFrame({"bucket": [int(bucket[a])], "keys": [k[a:b].tobytes()], "nodes": [n[a:b].tobytes()],
                                    "sizes": [c[a:b].tobytes()]})

        for pdf in batches:
            for t in pdf["text"]:
                s = shingles(t)
                if len(s):
                    late = flags[(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
                    order = np.concatenate([s[~late], s[late]])  # sorted by hash in each part
                    p = order[:prefix_length(len(s))]
                    found.append(p)
                    nodes.append(np.full(len(p), class_id(s), np.int64))
                    sizes.append(np.full(len(p), size_class(len(s)), np.uint8))
                    size += len(p)
            if size >= KEYS_PER_MESSAGE:
                yield from flush()
                found, nodes, sizes, size = [], [], [], 0
        if size:
            yield from flush()

    def group(pdf: pd.DataFrame) -> pd.DataFrame:
        k = np.concatenate([np.frombuffer(x, np.uint32) for x in pdf["keys"]])
        n = np.concatenate([np.frombuffer(x, np.int64) for x in pdf["nodes"]])
        c = np.concatenate([np.frombuffer(x, np.uint8) for x in pdf["sizes"]]).astype(np.int16)
        order = np.lexsort((n, c, k))
        k, n, c = k[order], n[order], c[order]
        new = np.concatenate([[True], (k[1:] != k[:-1]) | (n[1:] != n[:-1])])
        k, n, c = k[new], n[new], c[new]
        # classes of one key in the order of their size; a gap too wide for any link ends a group
        start = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (c[1:] - c[:-1] > SIZE_REACH)]))
        size = np.diff(np.concatenate([start, [len(k)]]))
        mixed = n.view(np.uint64) * _C[60]
        mixed = (mixed ^ (mixed >> np.uint64(31))) * _C[59]
        gid = np.add.reduceat(mixed, start).view(np.int64)  # the same for the same classes
        many = np.repeat(size > 1, size)
        return pd.DataFrame({"gid": np.repeat(gid, size)[many], "node": n[many]})

    texts = docs.select(text_or_empty().alias("text"))
    return (texts.mapInPandas(keys, "bucket long, keys binary, nodes binary, sizes binary")
            .groupBy("bucket").applyInPandas(group, "gid long, node long").distinct())


# ---------------------------------------------------------------- signature trees
def _possible(n_a, n_b, common) -> np.ndarray:
    """Whether an overlap of ``common`` at most allows the similarity bound."""
    return (T_NUM + T_DEN) * common >= T_NUM * (n_a + n_b)


def tree_walk(n: np.ndarray, bits: np.ndarray, comp: np.ndarray, split: int | None = None,
              label: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j) of classes of different components that the signatures allow, some at a time.
    With ``split`` only pairs with i < split <= j are asked for (two blocks).  Classes of one
    ``label`` are left out; the caller may change the labels while it takes the pairs."""
    side = np.zeros(len(n), np.int8) if split is None else (np.arange(len(n)) >= split).astype(np.int8)
    order = np.lexsort((bits[:, 0], n, comp, side))
    n, bits, comp, side = n[order].astype(np.int64), bits[order], comp[order], side[order]
    ones = np.bitwise_count(bits).sum(1, dtype=np.int64)
    levels = [(n, n, ones, bits, comp, comp, side, side)]
    while len(levels[-1][0]) > FANOUT:
        lo, hi, pc, b, c0, c1, s0, s1 = levels[-1]
        at = np.arange(0, len(lo), FANOUT)
        levels.append((np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at), np.minimum.reduceat(pc, at),
                       np.bitwise_or.reduceat(b, at, axis=0), np.minimum.reduceat(c0, at), np.maximum.reduceat(c1, at),
                       np.minimum.reduceat(s0, at), np.maximum.reduceat(s1, at)))
    step = max(FANOUT ** 2, (1 << 21) // bits.shape[1])  # pairs looked at together

    def allowed(depth: int, i: np.ndarray, j: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        lo, hi, pc, b, c0, c1, s0, s1 = levels[depth]
        for at in range(0, len(i), step):
            a, z = i[at:at + step], j[at:at + step]
            ok = ~((c0[a] == c1[a]) & (c0[z] == c1[z]) & (c0[a] == c0[z]))  # not all joined yet
            if split is not None:
                ok &= (s0[a] == 0) & (s1[z] == 1)
            if depth == 0:
                ok &= a != z
                if label is not None:
                    ok &= label[order[a]] != label[order[z]]
            ok &= (T_DEN * hi[a] >= T_NUM * lo[z]) & (T_DEN * hi[z] >= T_NUM * lo[a])
            a, z = a[ok], z[ok]
            # a set's bits outside the other side's bitmap are elements that the other side lacks
            both = np.bitwise_count(b[a] & b[z]).sum(1, dtype=np.int64)
            most = np.minimum(hi[a] - np.maximum(pc[a] - both, 0), hi[z] - np.maximum(pc[z] - both, 0))
            ok = _possible(lo[a], lo[z], most)
            yield a[ok], z[ok]

    def below(depth: int, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = len(levels[depth - 1][0])
        down = np.arange(FANOUT)
        ci = (i[:, None, None] * FANOUT + down[None, :, None]).astype(np.int64)
        cj = (j[:, None, None] * FANOUT + down[None, None, :]).astype(np.int64)
        ci, cj = (x.ravel() for x in np.broadcast_arrays(ci, cj))
        ok = (ci < size) & (cj < size) & (ci <= cj)
        return ci[ok], cj[ok]

    i, j = np.triu_indices(len(levels[-1][0]))
    for depth in range(len(levels) - 1, 0, -1):
        kept = list(allowed(depth, i, j))
        i, j = (np.concatenate(x) for x in zip(*kept)) if kept else (np.zeros(0, np.int64),) * 2
        if depth > 1:
            i, j = below(depth, i, j)
    if len(levels) == 1:
        parts = [(i, j)]
    else:
        parts = (below(1, i[at:at + 256], j[at:at + 256]) for at in range(0, len(i), 256))
    for part in parts:
        for a, z in allowed(0, *part):
            if len(a):
                yield order[a], order[z]


def tree_pairs(n: np.ndarray, bits: np.ndarray, comp: np.ndarray, split: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of ``tree_walk``."""
    found = list(tree_walk(n, bits, comp, split))
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 2


class Joined:
    """Labels of classes; joined classes have one label."""

    def __init__(self, label: np.ndarray):
        self.label = np.unique(label, return_inverse=True)[1].astype(np.int64)

    def join(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Join the classes of every pair; the places of the pairs that joined something."""
        x, y = self.label[i], self.label[j]
        at = np.unique(np.minimum(x, y) * len(self.label) + np.maximum(x, y), return_index=True)[1]
        up: dict[int, int] = {}

        def top(v: int) -> int:
            while v in up:
                if up[v] in up:
                    up[v] = up[up[v]]
                v = up[v]
            return v

        used = []
        for p, a, b in zip(at.tolist(), x[at].tolist(), y[at].tolist()):
            a, b = top(a), top(b)
            if a != b:
                up[max(a, b)] = min(a, b)
                used.append(p)
        if up:
            new = np.arange(len(self.label))
            new[list(up)] = [top(v) for v in list(up)]
            self.label[:] = new[self.label]
        return np.asarray(used, np.int64)


_PAIR = "a long, b long"


def _cuts(pdf: pd.DataFrame) -> Iterator[tuple[np.ndarray, int | None]]:
    """Of the group rows in a task: the places of each group or pair of blocks, and where its
    second block begins."""
    gid, x, y, part = (pdf[c].to_numpy(np.int64) for c in ("gid", "block_a", "block_b", "part"))
    order = np.lexsort((part, y, x, gid))
    at = np.flatnonzero(np.concatenate([[True], np.any([v[order][1:] != v[order][:-1] for v in (gid, x, y)], axis=0)]))
    for a, b in zip(at.tolist(), [*at[1:].tolist(), len(order)]):
        own = order[a:b]
        split = int((part[own] == 0).sum()) if x[own[0]] != y[own[0]] else None
        if split is None or split not in (0, len(own)):
            yield own, split


def _ordered(node: np.ndarray, left: list[np.ndarray], right: list[np.ndarray]) -> pd.DataFrame:
    i, j = (node[np.concatenate(v)] if v else np.zeros(0, np.int64) for v in (left, right))
    return pd.DataFrame({"a": np.minimum(i, j), "b": np.maximum(i, j)}).drop_duplicates()


def _candidates(rows: DataFrame, bins: int, every: bool = False) -> DataFrame:
    """(a, b): pairs of classes that the trees allow, from group rows (gid, block_a, block_b,
    part, node, comp, n, bits): a spanning forest of each group or pair of blocks, or with
    ``every`` all pairs."""
    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        bits = pdf["bits"].tolist()
        node, comp, n = (pdf[c].to_numpy(np.int64) for c in ("node", "comp", "n"))
        left, right = [], []
        for own, split in _cuts(pdf):
            raw = [bits[r] for r in own]
            narrow = matrix(raw)
            wide = any(len(x) != 8 * narrow.shape[1] for x in raw)
            forest = None if every else Joined(np.arange(len(own)))
            for i, j in tree_walk(n[own], narrow, comp[own], split, forest and forest.label):
                if wide:  # the tree has folded signatures to the narrowest
                    differ, total = apart([raw[x] for x in i], [raw[x] for x in j]), n[own[i]] + n[own[j]]
                    ok = _possible(total, 0, (total - differ) // 2)
                    i, j = i[ok], j[ok]
                if forest:
                    at = forest.join(i, j)
                    i, j = i[at], j[at]
                left.append(own[i])
                right.append(own[j])
        return _ordered(node, left, right)

    return _binned(rows, bins).applyInPandas(join, _PAIR)


def _binned(rows: DataFrame, bins: int):
    return rows.withColumn("_bin", F.pmod(F.xxhash64("gid", "block_a", "block_b"), F.lit(bins))).groupBy("_bin")


def _bins(rows: DataFrame, size: int) -> int:
    return max(1, -(-int(scalar(rows, F.sum("w"))[0] or 0) // size))


class Sets:
    """The sets of some classes with small numbers for their elements."""

    def __init__(self, sets: list[np.ndarray]):
        self.n = np.asarray([len(s) for s in sets], np.int64)
        values, code = np.unique(np.concatenate(sets), return_inverse=True)
        self.parts = np.split(code.astype(np.int32), np.cumsum(self.n)[:-1])
        self.flags = np.zeros(len(values), bool)

    def similar(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether the sets of each pair reach the similarity bound."""
        common = np.zeros(len(i), np.int64)
        order = np.argsort(i, kind="stable")
        step = max(1, (1 << 22) // int(self.n.max()))
        for own in np.split(order, np.flatnonzero(np.diff(i[order])) + 1) if len(i) else []:
            mine = self.parts[i[own[0]]]
            self.flags[mine] = True
            for at in range(0, len(own), step):
                some = own[at:at + step]
                size = self.n[j[some]]
                hit = self.flags[np.concatenate([self.parts[x] for x in j[some].tolist()])]
                common[some] = np.add.reduceat(hit, np.cumsum(size) - size, dtype=np.int64)
            self.flags[mine] = False
        return _possible(self.n[i], self.n[j], common)


def _cluster_links(rows: DataFrame, bins: int) -> DataFrame:
    """(a, b): links between components, from group rows (gid, block_a, block_b, part, node,
    comp, set): as many of each group or pair of blocks as join all that its links join."""
    def verify(pdf: pd.DataFrame) -> pd.DataFrame:
        sets = [np.asarray(x, np.int64).view(np.uint64) for x in pdf["set"]]
        node, comp = (pdf[c].to_numpy(np.int64) for c in ("node", "comp"))
        left, right = [], []
        for own, split in _cuts(pdf):
            some = [sets[r] for r in own]
            held, joined = Sets(some), Joined(comp[own])
            for i, j in tree_walk(held.n, matrix([bitmap(x).tobytes() for x in some]), comp[own], split, joined.label):
                ok = held.similar(i, j)
                i, j = i[ok], j[ok]
                at = joined.join(i, j)
                left.append(own[i[at]])
                right.append(own[j[at]])
        return _ordered(node, left, right)

    return _binned(rows, bins).applyInPandas(verify, _PAIR)


def _unjoined(groups: DataFrame, comps: DataFrame | None) -> DataFrame:
    """(gid, block_a, block_b, part, node, comp, w): the rows of the groups(gid, node, w) with more
    than one component, dealt to blocks by their weight w."""
    rows = groups
    if comps is None:
        rows = rows.withColumn("comp", F.col("node"))
    else:
        rows = rows.join(comps, "node", "left").select("gid", "node", "w", F.coalesce("component", "node").alias("comp"))
    open_groups = rows.groupBy("gid").agg(F.min("comp").alias("_lo"), F.max("comp").alias("_hi"), F.sum("w").alias("_g"))
    open_groups = open_groups.where(F.col("_lo") != F.col("_hi")).select(
        "gid", F.ceil(F.col("_g") / BLOCK).cast("long").alias("_blocks"))
    rows = rows.join(open_groups, "gid")
    # in a large group a large component has blocks of its own, the others share blocks
    own = rows.where("_blocks > 1").groupBy("gid", "comp").agg(F.sum("w").alias("_c")).where(F.col("_c") > BLOCK // 2)
    rows = rows.join(own, ["gid", "comp"], "left")
    cut = F.pmod(F.xxhash64("node"), F.ceil(F.col("_c") / BLOCK).cast("long"))
    block = F.when(F.col("_blocks") == 1, F.lit(0)).when(F.col("_c").isNull(), F.pmod(F.xxhash64("comp"), F.col("_blocks")))
    rows = rows.withColumn("block", block.otherwise(F.xxhash64("comp", cut)).cast("long"))
    rows = saved(rows.select("gid", "node", "w", "comp", "block", "_blocks"), "open-groups")
    one = rows.where("_blocks = 1").select("gid", F.lit(0).cast("long").alias("block_a"), F.lit(0).cast("long").alias("block_b"),
                                           F.lit(0).alias("part"), "node", "comp", "w")
    big = rows.where("_blocks > 1")
    blocks = big.groupBy("gid", "block").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    x, y = (blocks.select("gid", *[F.col(c).alias(f"{c}_{s}") for c in ("block", "lo", "hi")]) for s in "ab")
    met = x.join(y, "gid").where((F.col("block_a") <= F.col("block_b")) & ~(
        (F.col("lo_a") == F.col("hi_a")) & (F.col("lo_b") == F.col("hi_b")) & (F.col("lo_a") == F.col("lo_b")))).select(
        "gid", "block_a", "block_b")
    first = big.join(met.withColumn("block", F.col("block_a")), ["gid", "block"]).select(
        "gid", "block_a", "block_b", F.lit(0).alias("part"), "node", "comp", "w")
    second = big.join(met.where("block_a < block_b").withColumn("block", F.col("block_b")), ["gid", "block"]).select(
        "gid", "block_a", "block_b", F.lit(1).alias("part"), "node", "comp", "w")
    return saved(one.unionByName(first).unionByName(second), "group-rows")


# ---------------------------------------------------------------- verification
def _marks(nodes: DataFrame, wanted: DataFrame) -> np.ndarray:
    """A bitmap of fixed size over the documents that stand for the classes ``wanted(node)``."""
    at = F.pmod(F.xxhash64("first.doc_id", "first._row"), F.lit(MARKS)) + 1
    got = nodes.join(wanted, "node", "left_semi").select(
        F.bitmap_bucket_number(at).alias("k"), F.bitmap_bit_position(at).alias("p")).groupBy("k").agg(
        F.bitmap_construct_agg("p").alias("m")).collect()  # MARKS bits at most
    flags = np.zeros(MARKS // 8, np.uint8)
    for r in got:
        flags[(r.k - 1) * 4096:r.k * 4096] = np.frombuffer(r.m, np.uint8)
    return flags


def _sets(docs: DataFrame, nodes: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """(node, set, in_a, in_b): the sets of the classes ``a(node)`` and ``b(node)``, made again from
    the text of one document of each class (and of rows that repeat it); the bitmaps keep other
    texts out, but for chance hits, and tell on which side a set is wanted."""
    held = docs.sparkSession.sparkContext.broadcast([_marks(nodes, x) for x in (a, b)])

    def pick(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            at = pdf["at"].to_numpy(np.int64)
            side = np.stack([(f[at >> 3] >> (at & 7)) & 1 == 1 for f in held.value])
            use = np.flatnonzero(side.any(0))
            if len(use):
                sets = [shingles(t) for t in pdf["text"].iloc[use]]
                yield pd.DataFrame({"node": [class_id(x) for x in sets], "set": [x.view(np.int64).tolist() for x in sets],
                                    "in_a": side[0, use], "in_b": side[1, use]})

    rows = docs.select(F.pmod(F.xxhash64(F.col("doc_id").cast("long"), F.xxhash64(text_or_empty())), F.lit(MARKS)).alias("at"),
                       text_or_empty().alias("text"))
    return saved(rows.mapInPandas(pick, "node long, set array<long>, in_a boolean, in_b boolean"), "sets")


def _verify(docs: DataFrame, nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """The links among ``pairs(a, b)``: those whose sets are similar enough."""
    sets = _sets(docs, nodes, *(pairs.select(F.col(c).alias("node")).distinct() for c in "ab"))
    x, y = (sets.where(f"in_{c}").select(F.col("node").alias(c), F.col("set").alias(f"set_{c}")) for c in "ab")
    both = pairs.select("a", "b").join(x, "a").join(y, "b")
    common = F.size(F.array_intersect("set_a", "set_b"))
    similar = (T_NUM + T_DEN) * common >= T_NUM * (F.size("set_a") + F.size("set_b"))
    return saved(both.where(similar).select("a", "b").distinct(), "links")


def _hub_pairs(groups: DataFrame, nodes: DataFrame) -> DataFrame:
    """Each class with the hub (smallest class) that it shares most groups with, where the
    signatures allow a link."""
    hubs = groups.groupBy("gid").agg(F.min("node").alias("hub"))
    shared = groups.join(hubs, "gid").where(F.col("node") != F.col("hub")).groupBy("node", "hub").agg(F.count(F.lit(1)).alias("c"))
    top = shared.groupBy("node").agg(F.max(F.struct("c", "hub")).alias("t")).select("node", F.col("t.hub").alias("hub"))
    of_hub = nodes.select(F.col("node").alias("hub"), F.col("n").alias("n_hub"), F.col("bits").alias("bits_hub"))
    rows = top.join(nodes.select("node", "n", "bits"), "node").join(of_hub, "hub")

    def allow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                total = pdf["n"].to_numpy(np.int64) + pdf["n_hub"].to_numpy(np.int64)
                ok = _possible(total, 0, (total - apart(pdf["bits"].tolist(), pdf["bits_hub"].tolist())) // 2)
                yield pdf.loc[ok, ["hub", "node"]].rename(columns={"hub": "a", "node": "b"})

    return rows.mapInPandas(allow, "a long, b long")


def _all_links(docs: DataFrame, groups: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, component) of the classes that have a link."""
    links = _verify(docs, nodes, saved(_hub_pairs(groups, nodes), "hub-pairs"))
    comps = components(links)
    rows = _unjoined(groups.withColumn("w", F.lit(1)), comps)
    rows, bins = rows.join(nodes.select("node", "n", "bits"), "node"), _bins(rows, ROWS_PER_BIN)
    near = saved(_candidates(rows, bins).distinct(), "near")
    if near.isEmpty():
        return comps
    clusters = components(near).withColumnRenamed("component", "gid").join(nodes.select("node", "n"), "node")
    clusters = saved(clusters.select("gid", "node", F.ceil(F.col("n") / SET_UNIT).alias("w")), "clusters")
    wanted = clusters.select("node")
    sets = _sets(docs, nodes, wanted, wanted.limit(0)).groupBy("node").agg(F.first("set").alias("set"))
    rows = _unjoined(clusters, comps)
    rows, bins = rows.join(sets, "node"), _bins(rows, 2 * BLOCK)
    return components(saved(links.unionByName(_cluster_links(rows, bins)), "links"))


def _prepared(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, classes, groups of classes that share a prefix key)."""
    ship(docs.sparkSession)
    signatures = saved(_signatures(docs), "signatures")
    each = signatures.where("chunk < 0").select("doc_id", "_row", "n", "node")
    nodes = signatures.where("chunk < 0 AND n > 0").groupBy("node").agg(
        F.max("n").cast("long").alias("n"), F.min(F.struct("doc_id", "_row")).alias("first"), F.min("doc_id").alias("first_id"),
        F.first("bits").alias("bits"))
    nodes = saved(nodes, "classes")
    frequent = _frequent(signatures)
    keys = scalar(nodes, F.sum(F.col("n") / T_DEN + 1))[0] or 0
    groups = saved(_groups(docs, frequent, max(1, -(-int(keys) // KEYS_PER_BUCKET))), "groups")
    return each, nodes, groups


def join(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The whole join: (links, members).  links(a, b), a < b, holds every pair of different
    classes that are similar enough, inside a component too.  members(doc_id, _row, n_shingles,
    class_id, n_links) has every row of ``docs`` with its class (null without words) and the
    number of other documents it is linked to; documents of one class are linked with each other.

    ``near_duplicates`` needs only links that join components and gives the same components;
    this function verifies all pairs, whose number grows with the square of a group."""
    each, nodes, groups = _prepared(docs)
    rows = _unjoined(groups.withColumn("w", F.lit(1)), None)
    rows, bins = rows.join(nodes.select("node", "n", "bits"), "node"), _bins(rows, ROWS_PER_BIN)
    links = _verify(docs, nodes, saved(_candidates(rows, bins, every=True).distinct(), "all-pairs"))
    size = saved(each.where("n > 0").groupBy("node").agg(F.count(F.lit(1)).alias("_size")), "class-sizes")
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    met = both.join(size, both["b"] == size["node"]).groupBy("a").agg(F.sum("_size").alias("_met"))
    size = size.join(met, size["node"] == met["a"], "left").select("node", (F.col("_size") - 1 + F.coalesce("_met", F.lit(0))).alias("n_links"))
    members = each.where("n > 0").join(size, "node").unionByName(
        each.where("n = 0").withColumn("node", F.lit(None).cast("long")).withColumn("n_links", F.lit(0).cast("long")))
    return links, members.select("doc_id", "_row", F.col("n").cast("long").alias("n_shingles"),
                                 F.col("node").alias("class_id"), "n_links")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, _row, n_shingles, component_id) for every row of ``docs``: the set's size and
    the smallest ``doc_id`` that links lead to; ``_row`` is xxhash64 of the text."""
    each, nodes, groups = _prepared(docs)
    comps = _all_links(docs, groups, nodes)
    ids = nodes.select("node", "first_id").join(comps, "node", "left").withColumn("component", F.coalesce("component", "node"))
    first = ids.groupBy("component").agg(F.min("first_id").alias("component_id"))
    ids = saved(ids.join(first, "component").select("node", "component_id"), "component-ids")
    out = each.where("n > 0").join(ids, "node").unionByName(
        each.where("n = 0").withColumn("component_id", F.col("doc_id")))
    return out.select("doc_id", "_row", F.col("n").cast("long").alias("n_shingles"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each component: the one whose ``doc_id`` names it (of rows
    that repeat this id, the one with the smallest text hash); documents without words stay."""
    found = near_duplicates(docs)
    first = found.where("n_shingles > 0").groupBy("component_id").agg(
        F.min(F.struct(F.coalesce(F.col("doc_id") != F.col("component_id"), F.col("component_id").isNotNull()).alias("other"),
                       "doc_id", "_row")).alias("f"))
    kept = first.select(F.col("f.doc_id").alias("_d"), F.col("f._row").alias("_r")).unionByName(
        found.where("n_shingles = 0").select(F.col("doc_id").alias("_d"), F.col("_row").alias("_r"))).distinct()
    text = F.xxhash64(text_or_empty())
    return docs.join(kept, docs["doc_id"].cast("long").eqNullSafe(kept["_d"]) & (text == kept["_r"]), "left_semi")


def op9_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """Components of the Jaccard join of all documents with themselves."""
    return near_duplicates(table(spark, sf_dir, "documents")).drop("_row")
