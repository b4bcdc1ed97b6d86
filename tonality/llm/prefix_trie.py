"""Prefix trie over conversations as balanced parentheses, in shards.

A conversation is the sequence of its turns, each a 128-bit digest of role and text, so that its
path is a byte string whose order is the trie's preorder.  Conversations are range partitioned and
sorted by (path, conv_id); every task writes shards of bounded size.  A shard holds the trie of its
conversations as balanced parentheses with the minimum excess of each block, and for each node the
words of its last text, the conversations that end there and the smallest conversation.

Reading a shard, ``find_close`` over the tree of block minima delimits subtrees, the rank of "()"
pairs counts leaves, and cumulative arrays give members and saved tokens.  Two shards that follow
each other share the nodes on the common prefix of one's last and the other's first path, and
nothing else: such spine nodes are summed over their shards.  To count each once, a node's words
and its place among its parent's children go to the first shard that holds it, a leaf to the last.

A group of equal conversations is cut into shards like any other rows.  The digest over the ids
that end at a shared node is, as SHA-256 demands, taken in one sequence: shard by shard, streamed,
a shard's ids as one string.

Defined results: turns are ordered by turn (null first), equal turns by their digest; null role or
text counts as empty; rows without ``conv_id`` take no part; other columns are ignored; no rows
give no nodes.  The digests of one conversation's turns have to fit a task.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tonality.llm.common import saved, ship, table

GROUP = 20
SHARED_TURNS = 4
#: A shard ends when it holds so many nodes or conversations.
SHARD_NODES, SHARD_CONVS = 500_000, 100_000
_TURN = 16
_BLOCK = 64
_FAR = 1 << 30

SHARD_SCHEMA = ("part int, seq int, n_convs long, n_nodes long, left int, right int, first binary, last binary, parens binary, "
                "excess_min binary, words binary, smallest binary, ended binary, digests binary, "
                "spine array<struct<node:int,ids:string>>")
NODE_SCHEMA = ("conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, "
               "ends_sha256 string")
SPINE_SCHEMA = ("node_id string, parent_id string, depth long, part int, seq int, at int, conv_id long, n_convs long, "
                "n_children long, n_leaves long, saved_tokens long, ids string")
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


# ---------------------------------------------------------------- conversations
def rebuilt(turns: DataFrame) -> DataFrame:
    """(conv_id, path binary, words array): each conversation after its first turns were taken
    from the first conversation of its group."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    turn = F.struct(F.col("turn"), F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)).alias("digest"),
                    F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).alias("words"))
    own = turns.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("_t"))
    own = saved(own.groupBy("conv_id").agg(F.sort_array(F.collect_list("_t")).alias("_own")), "conversations")
    heads = own.where(F.col("conv_id") % GROUP == 0).select(F.col("conv_id").alias("_base"),
                                                            F.slice("_own", 1, SHARED_TURNS - 1).alias("_head"))
    j = own.withColumn("_base", F.col("conv_id") - F.col("conv_id") % GROUP).join(heads, "_base", "left")
    h = (F.crc32(F.col("conv_id").cast("string")) % SHARED_TURNS).cast("int")
    tail = F.slice("_own", h + 1, F.greatest(F.size("_own") - h, F.lit(0)))
    head = F.when(F.col("_head").isNull(), F.slice("_own", 1, 0)).otherwise(F.slice("_head", 1, h))
    j = j.select("conv_id", F.concat(head, tail).alias("_turns"))
    return j.select("conv_id", F.unhex(F.array_join(F.col("_turns.digest"), "")).alias("path"), F.col("_turns.words").alias("words"))


def common_turns(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n // _TURN
    return int((np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n)).argmax()) // _TURN


# ---------------------------------------------------------------- writing
class Builder:
    """The trie of conversations that come in path order."""

    def __init__(self, left: int | None):
        self.left, self.n_convs = left, 0
        self.parens, self.words, self.smallest, self.ended = bytearray(), [], [], []
        self.stack: list[int] = []
        self.ids: dict[int, list[str]] = {}
        self.digests: dict[int, bytes] = {}
        self.first = self.last = None
        self._open(0)

    def _open(self, words: int) -> None:
        self.stack.append(len(self.words))
        self.parens.append(1)
        self.words.append(words)
        self.smallest.append(np.iinfo(np.int64).max)
        self.ended.append(0)

    def _close(self) -> None:
        node = self.stack.pop()
        self.parens.append(0)
        if self.stack:
            up = self.stack[-1]
            self.smallest[up] = min(self.smallest[up], self.smallest[node])

    def _seal(self, node: int) -> None:
        """No more ids end at ``node``; those of the first path are kept for the next shards."""
        if node in self.ids:
            self.digests[node] = hashlib.sha256(",".join(self.ids[node]).encode()).digest()
            if node > len(self.first) // _TURN:
                del self.ids[node]

    def add(self, conv_id: int, path: bytes, words) -> None:
        keep = 0 if self.last is None else common_turns(self.last, path)
        if self.last is None:
            self.first = path
        while len(self.stack) > keep + 1:
            self._seal(self.stack[-1])
            self._close()
        for w in words[keep:]:
            self._open(int(w))
        node = self.stack[-1]
        self.smallest[node] = min(self.smallest[node], conv_id)
        self.ended[node] += 1
        self.ids.setdefault(node, []).append(str(conv_id))
        self.last = path
        self.n_convs += 1

    def full(self, nodes: int, convs: int) -> bool:
        return len(self.words) >= nodes or self.n_convs >= convs

    def row(self, part: int, seq: int, right: int | None) -> pd.DataFrame:
        spine = sorted(set(self.stack) | set(range(len(self.first) // _TURN + 1)))
        kept = [{"node": n, "ids": ",".join(self.ids[n])} for n in spine if n in self.ids]
        for node in self.stack:
            self._seal(node)
        while self.stack:
            self._close()
        bits = np.frombuffer(bytes(self.parens), np.uint8)
        return pd.DataFrame([{
            "part": part, "seq": seq, "n_convs": self.n_convs, "n_nodes": len(self.words), "left": self.left, "right": right,
            "first": self.first, "last": self.last, "parens": np.packbits(bits).tobytes(),
            "excess_min": block_minima(excess(bits)).astype("<i4").tobytes(), "words": np.asarray(self.words, "<i4").tobytes(),
            "smallest": np.asarray(self.smallest, "<i8").tobytes(), "ended": np.asarray(self.ended, "<i4").tobytes(),
            "digests": b"".join(self.digests[n] for n in sorted(self.digests)), "spine": kept}])


def write_shards(convs: DataFrame, shard_nodes: int = SHARD_NODES, shard_convs: int = SHARD_CONVS) -> DataFrame:
    """The shards of ``convs(conv_id, path, words)``, written to the shared folder.  ``left`` and
    ``right`` tell how many turns a shard's first and last path share with its neighbours of the
    same task; they are null at the task's ends."""
    ship(convs.sparkSession)
    rows = convs.repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id")

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, seq, shard = TaskContext.get().partitionId(), 0, None
        for pdf in batches:
            for conv_id, path, words in zip(pdf["conv_id"].tolist(), pdf["path"], pdf["words"]):
                path = bytes(path)
                if shard is not None and shard.full(shard_nodes, shard_convs):
                    shared = common_turns(shard.last, path)
                    yield shard.row(part, seq, shared)
                    shard, seq = Builder(shared), seq + 1
                if shard is None:
                    shard = Builder(None)
                shard.add(conv_id, path, words)
        if shard is not None:
            yield shard.row(part, seq, None)

    shards = rows.select("conv_id", "path", "words").mapInPandas(build, SHARD_SCHEMA)
    return saved(shards, "trie-shards")


# ---------------------------------------------------------------- reading
def excess(bits: np.ndarray) -> np.ndarray:
    return np.cumsum(bits.astype(np.int32) * 2 - 1)


def _blocks(ex: np.ndarray) -> np.ndarray:
    return np.pad(ex, (0, -len(ex) % _BLOCK), constant_values=_FAR).reshape(-1, _BLOCK)


def block_minima(ex: np.ndarray) -> np.ndarray:
    return _blocks(ex).min(axis=1)


class Parens:
    """Balanced parentheses with a tree over the minimum excess of their blocks."""

    def __init__(self, bits: np.ndarray, minima: np.ndarray):
        self.bits, self.excess = bits, excess(bits)
        self.blocks = _blocks(self.excess)
        self.leaves = 1
        while self.leaves < len(minima):
            self.leaves *= 2
        self.tree = np.full(2 * self.leaves, _FAR, np.int64)
        self.tree[self.leaves:self.leaves + len(minima)] = minima
        for k in range(self.leaves - 1, 0, -1):
            self.tree[k] = min(self.tree[2 * k], self.tree[2 * k + 1])
        self.opens = np.flatnonzero(bits)
        pair = np.zeros(len(bits), np.int64)
        pair[:-1] = (bits[:-1] == 1) & (bits[1:] == 0)
        self._pairs = np.concatenate([[0], np.cumsum(pair)])

    def find_close(self, at: np.ndarray) -> np.ndarray:
        """For each opening place the place that closes it: the first after it with less excess."""
        goal = self.excess[at] - 1
        out = np.full(len(at), -1, np.int64)
        block = at // _BLOCK
        for lo in range(0, len(at), 1 << 14):
            part = slice(lo, lo + (1 << 14))
            hit = (self.blocks[block[part]] <= goal[part, None]) & (np.arange(_BLOCK) > (at[part] % _BLOCK)[:, None])
            out[part] = np.where(hit.any(axis=1), block[part] * _BLOCK + hit.argmax(axis=1), -1)
        rest = np.flatnonzero(out < 0)
        if len(rest):
            g, node = goal[rest], block[rest] + self.leaves
            climbing = np.ones(len(rest), bool)
            while climbing.any():  # up to the first right sibling with an excess so low
                right = (node % 2 == 0) & (self.tree[np.minimum(node + 1, len(self.tree) - 1)] <= g)
                node = np.where(climbing, np.where(right, node + 1, node // 2), node)
                climbing &= ~right
            while (node < self.leaves).any():  # down to its first block
                inner = node < self.leaves
                left = np.where(inner, 2 * node, node)
                node = np.where(inner, np.where(self.tree[left] <= g, left, left + 1), node)
            found = node - self.leaves
            for lo in range(0, len(rest), 1 << 14):
                part = slice(lo, lo + (1 << 14))
                out[rest[part]] = found[part] * _BLOCK + (self.blocks[found[part]] <= g[part, None]).argmax(axis=1)
        return out

    def leaf_pairs(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Leaves among the nodes that open at places ``begin`` to ``end``."""
        return self._pairs[end] - self._pairs[begin]


class Shard:
    """A stored shard, opened: arrays over its nodes in preorder.  ``shared`` are the nodes that
    other shards hold too; their numbers are this shard's share."""

    def __init__(self, row):
        n = int(row.n_nodes)
        first, last = bytes(row.first), bytes(row.last)
        left, right = _neighbour(row.left, row.prev_last, first), _neighbour(row.right, row.next_first, last)
        p = Parens(np.unpackbits(np.frombuffer(row.parens, np.uint8), count=2 * n), np.frombuffer(row.excess_min, "<i4"))
        close = p.find_close(p.opens)
        stop = np.arange(n) + (close - p.opens + 1) // 2
        self.depth = p.excess[p.opens] - 1
        words = np.frombuffer(row.words, "<i4").astype(np.int64)
        self.smallest = np.frombuffer(row.smallest, "<i8")
        self.ended = np.frombuffer(row.ended, "<i4").astype(np.int64)
        self.digests = bytes(row.digests)
        upto = lambda x: np.concatenate([[0], np.cumsum(x)])
        ends = upto(self.ended)
        self.n_convs = ends[stop] - ends[:-1]
        lefts = list(range(left + 1))
        rightmost = np.zeros(len(last) // _TURN + 1, np.int64)
        on_path = self.depth < len(rightmost)
        np.maximum.at(rightmost, self.depth[on_path], np.flatnonzero(on_path))
        rights = rightmost[:right + 1].tolist()
        self.shared = sorted(set(lefts) | set(rights))
        new = np.ones(n, bool)
        new[lefts] = False
        gains = upto(self.n_convs * words - np.where(new, words, 0))
        self.saved = gains[stop] - gains[:-1]
        self.n_leaves = p.leaf_pairs(p.opens, close + 1)
        if right >= len(last) // _TURN:  # the last path goes on in the next shard
            self.n_leaves[rightmost] -= 1
        self.parent = self._parents()
        self.n_children = np.bincount(self.parent[1:][new[1:]], minlength=n)
        self.path_of = {}
        for path, nodes in ((first, lefts), (last, rights)):
            chain = [hashlib.md5(b"").hexdigest()]
            for d in range(1, len(nodes)):
                chain.append(hashlib.md5(chain[-1].encode() + path[(d - 1) * _TURN:d * _TURN]).hexdigest())
            self.path_of.update({node: (chain[d], chain[d - 1] if d else None) for d, node in enumerate(nodes)})
        self.ids = {s["node"]: s["ids"] for s in row.spine}

    def _parents(self) -> np.ndarray:
        out, at = [], {-1: -1}
        for node, d in enumerate(self.depth.tolist()):
            out.append(at[d - 1])
            at[d] = node
        return np.asarray(out, np.int64)

    def spine(self, row) -> pd.DataFrame:
        s = self.shared
        ids = [self.path_of[k] for k in s]
        return pd.DataFrame({
            "node_id": _strings(i for i, _ in ids), "parent_id": _strings(i for _, i in ids), "depth": self.depth[s].astype(np.int64),
            "part": np.int32(row.part), "seq": np.int32(row.seq), "at": np.asarray(s, np.int32), "conv_id": self.smallest[s],
            "n_convs": self.n_convs[s], "n_children": self.n_children[s], "n_leaves": self.n_leaves[s],
            "saved_tokens": self.saved[s], "ids": _strings(self.ids.get(k) for k in s)})

    def nodes(self, smallest_shared: dict[int, int]) -> pd.DataFrame:
        """All nodes but the shared ones; ``smallest_shared`` gives those their smallest conversation."""
        smallest = self.smallest.copy()
        for k, v in smallest_shared.items():
            smallest[k] = v
        own = np.ones(len(smallest), bool)
        own[self.shared] = False
        sha = np.full(len(smallest), EMPTY_SHA, object)
        for k, node in enumerate(np.flatnonzero(self.ended).tolist()):
            sha[node] = self.digests[32 * k:32 * k + 32].hex()
        up = pd.Series(smallest[np.maximum(self.parent, 0)]).astype("Int64").where(self.parent >= 0)
        return pd.DataFrame({
            "conv_id": smallest, "depth": self.depth.astype(np.int64), "parent_conv_id": up, "n_convs": self.n_convs,
            "n_children": self.n_children, "n_leaves": self.n_leaves, "saved_tokens": self.saved, "ends_sha256": pd.Series(sha, dtype=object)})[own]


def _strings(values) -> pd.Series:
    return pd.Series(list(values), dtype=object)


def _neighbour(inside, path, own: bytes) -> int:
    """Turns shared with the neighbour; -1 without one."""
    if not pd.isna(inside):
        return int(inside)
    return -1 if path is None else common_turns(bytes(path), own)


def _digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """SHA-256 over the id strings of each node, which come in order."""
    node, state = None, None
    for pdf in batches:
        done = []
        for node_id, ids in zip(pdf["node_id"], pdf["ids"]):
            if node_id != node:
                if node is not None:
                    done.append((node, state.hexdigest()))
                node, state = node_id, hashlib.sha256()
            else:
                state.update(b",")
            state.update(ids.encode())
        yield pd.DataFrame(done, columns=["node_id", "ends_sha256"], dtype=object)
    if node is not None:
        yield pd.DataFrame([(node, state.hexdigest())], columns=["node_id", "ends_sha256"], dtype=object)


def read_nodes(shards: DataFrame) -> DataFrame:
    """Every node of the trie that the written ``shards`` make up."""
    ship(shards.sparkSession)
    tasks = shards.groupBy("part").agg(F.min_by("first", "seq").alias("first"), F.max_by("last", "seq").alias("last"))
    order = Window.orderBy("part")  # a row for each task that wrote shards
    tasks = tasks.select("part", F.lag("last").over(order).alias("prev_last"), F.lead("first").over(order).alias("next_first"))
    shards = shards.join(tasks, "part")

    def spines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                yield Shard(row).spine(row)

    spine = saved(shards.mapInPandas(spines, SPINE_SCHEMA), "trie-spines")
    merged = spine.groupBy("node_id").agg(
        F.first("parent_id").alias("parent_id"), F.first("depth").alias("depth"), F.min("conv_id").alias("conv_id"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")])
    merged = saved(merged, "trie-merged")
    own = spine.select("part", "seq", "at", "node_id").join(merged.select("node_id", "conv_id"), "node_id")
    own = own.groupBy("part", "seq").agg(F.collect_list(F.struct("at", "conv_id")).alias("merged"))  # two paths at most

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                found = row.merged if row.merged is not None else []
                nodes = Shard(row).nodes({x["at"]: x["conv_id"] for x in found})
                for lo in range(0, len(nodes), 50_000):
                    yield nodes.iloc[lo:lo + 50_000]

    inner = shards.join(own, ["part", "seq"], "left").mapInPandas(read, NODE_SCHEMA)
    ends = spine.where(F.col("ids").isNotNull()).select("node_id", "part", "seq", "ids")
    ends = ends.repartition("node_id").sortWithinPartitions("node_id", "part", "seq").select("node_id", "ids")
    ends = ends.mapInPandas(_digests, "node_id string, ends_sha256 string")
    up = merged.select(F.col("node_id").alias("parent_id"), F.col("conv_id").alias("parent_conv_id"))
    shared = merged.join(up, "parent_id", "left").join(ends, "node_id", "left")
    columns = [x.split()[0] for x in NODE_SCHEMA.split(", ")]
    shared = shared.withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(EMPTY_SHA))).select(*columns)
    return inner.unionByName(shared)


def prefix_trie(turns: DataFrame) -> DataFrame:
    """The nodes of the trie of ``turns(conv_id, turn, role, text)``, after rebuilding."""
    return read_nodes(write_shards(rebuilt(turns)))


def op11_prefix_trie(spark, sf_dir: str) -> DataFrame:
    """Every node of the trie over all conversations."""
    return prefix_trie(table(spark, sf_dir, "conversations"))


SQL = r"""
WITH t AS (
  SELECT conv_id, turn, struct_pack(role := coalesce(role, ''), text := coalesce(text, '')) AS x
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (
  SELECT conv_id, list(x ORDER BY turn NULLS FIRST, md5(length(x.role) || ':' || x.role || x.text)) AS ts,
         CAST(xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda s: ascii(s)::BIGINT)),
           lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), range(8)),
             lambda v, i: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384::BIGINT) ELSE v // 2 END)), 4294967295::BIGINT) % 4 AS INTEGER) AS h
  FROM t GROUP BY conv_id),
r AS (
  SELECT c.conv_id, list_concat(coalesce(list_slice(b.ts, 1, c.h), []), list_slice(c.ts, c.h + 1, len(c.ts))) AS ts
  FROM c LEFT JOIN c b ON b.conv_id = c.conv_id - c.conv_id % 20),
m AS (SELECT conv_id, d, len(ts) = d AS ended, list_slice(ts, 1, d) AS path FROM (SELECT *, unnest(range(0, len(ts) + 1)) AS d FROM r)),
g AS (
  SELECT path, d, min(conv_id) AS conv_id, count(*) AS n, sha256(coalesce(string_agg(CASE WHEN ended THEN conv_id::VARCHAR END, ',' ORDER BY conv_id), '')) AS sha
  FROM m GROUP BY path, d),
k AS (SELECT list_slice(path, 1, d - 1) AS path, count(*) AS n FROM g WHERE d > 0 GROUP BY 1),
v AS (
  SELECT g.*, coalesce(k.n, 0) AS kids,
         CASE WHEN d > 0 THEN (g.n - 1) * len(regexp_extract_all(g.path[d].text, '[^\x20\x09-\x0D]+')) ELSE 0 END AS gain
  FROM g LEFT JOIN k ON g.path = k.path),
s AS (
  SELECT list_slice(path, 1, a) AS path, sum((kids = 0)::BIGINT) AS leaves, sum(gain) AS gain
  FROM (SELECT *, unnest(range(0, d + 1)) AS a FROM v) GROUP BY 1)
SELECT v.conv_id, v.d AS depth, u.conv_id AS parent_conv_id, v.n AS n_convs, v.kids AS n_children, CAST(s.leaves AS BIGINT) AS n_leaves,
       CAST(s.gain AS BIGINT) AS saved_tokens, v.sha AS ends_sha256
FROM v JOIN s ON v.path = s.path LEFT JOIN g u ON v.d > 0 AND u.path = list_slice(v.path, 1, v.d - 1)
"""
