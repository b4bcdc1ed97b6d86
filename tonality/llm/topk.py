"""Exact top-k search: tiled matrix products, selection per tile, tree merging.

Queries are taken in panels of bounded size.  For each panel, every task reads its share of
the candidates tile by tile, multiplies the tile with the panel, keeps the best k of each
query and merges them into its running lists, so that a task returns k rows per query
whatever it has read.  The lists of the tasks are then merged in two levels.

Vectors become integers ``floor(256 * x)``; scores are exact: in double precision where all
sums stay below 2**53, else with Python's integers (scores beyond a long are cut to its range).

Defined results: vectors that are null or hold a null or non-finite component take no part;
a shorter vector counts as padded with zeros; equal scores go to the smaller ``vec_id``;
every stored row is a candidate of its own, except rows with the query's ``vec_id``; a
repeated query ``vec_id`` is asked once, with its smallest vector; no rows give no result.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tonality.llm.common import ship, table

SCALE = 256.0
#: Queries sent to the executors at once.
PANEL = 16_384
TILE_QUERIES, TILE_ROWS = 1024, 2048
MERGE_WAYS = 64
_EXACT = float(1 << 53)
_LONG = (1 << 63) - 1
OUT = "query_id long, vec_id long, score long, way int"


def whole_numbers(vectors: list) -> np.ndarray:
    """Rows of floor(256 * x), padded with zeros to one width; exact in double precision."""
    width = max((len(v) for v in vectors), default=0)
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, :len(v)] = v
    return np.floor(SCALE * out)


def products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    width = max(q.shape[1], c.shape[1], 1)
    q, c = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (q, c))
    if np.abs(q).max(initial=0) * np.abs(c).max(initial=0) * width < _EXACT:
        return (q @ c.T).astype(np.int64)
    as_int = np.frompyfunc(int, 1, 1)
    exact = as_int(q).dot(as_int(c).T)
    return np.clip(exact, -_LONG - 1, _LONG).astype(np.int64)


def best(scores: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best columns of each row by (score, smaller id): (scores, ids, valid), k wide.
    ``ids`` must ascend; ``own`` are the rows' own ids, which are left out."""
    n = scores.shape[1]
    valid = ids[None, :] != own[:, None]
    floor = np.iinfo(np.int64).min
    ranked = np.where(valid, scores, floor)
    if n > k:
        kth = np.partition(ranked, n - k, axis=1)[:, n - k][:, None]
        above, level = ranked > kth, ranked == kth
        take = above | (level & (np.cumsum(level, axis=1) <= k - above.sum(1)[:, None]))
        cols = np.nonzero(take)[1].reshape(len(scores), k)
    else:
        cols = np.broadcast_to(np.arange(n), scores.shape)
    return (np.take_along_axis(scores, cols, 1), ids[cols], np.take_along_axis(valid, cols, 1))


def merged(a: tuple, b: tuple, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    s, i, v = (np.concatenate(x, axis=1) for x in zip(a, b))
    order = np.lexsort((i, ~s, ~v), axis=1)  # ~s = -s - 1: descending, without overflow
    return tuple(np.take_along_axis(x, order, 1)[:, :k] for x in (s, i, v))


def search(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of ``queries`` the k best of ``vectors``;
    both have (vec_id long, embedding array)."""
    spark = vectors.sparkSession
    ship(spark)
    usable = F.col("embedding").isNotNull() & F.forall(
        "embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    clean = lambda df: df.select(F.col("vec_id").cast("long").alias("vec_id"),
                                 F.col("embedding").cast("array<double>").alias("embedding")).where(
        F.col("vec_id").isNotNull() & usable)
    vectors = clean(vectors)
    queries = clean(queries).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    panels = max(1, -(-queries.count() // PANEL))
    lists = None
    for p in range(panels):
        rows = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(panels)) == p).collect()
        q_ids = np.asarray([r.vec_id for r in rows], np.int64)
        held = spark.sparkContext.broadcast((q_ids, whole_numbers([r.embedding for r in rows])))

        def scan(batches: Iterator[pd.DataFrame], held=held) -> Iterator[pd.DataFrame]:
            q_ids, q = held.value
            found: dict[int, tuple] = {}
            for pdf in batches if len(q_ids) else ():
                ids = pdf["vec_id"].to_numpy(np.int64)
                order = np.argsort(ids, kind="stable")
                rows = pdf["embedding"].to_numpy()
                for lo in range(0, len(ids), TILE_ROWS):
                    at = order[lo:lo + TILE_ROWS]
                    tile, tile_ids = whole_numbers(rows[at]), ids[at]
                    for b in range(0, len(q_ids), TILE_QUERIES):
                        new = best(products(q[b:b + TILE_QUERIES], tile), tile_ids, q_ids[b:b + TILE_QUERIES], k)
                        found[b] = merged(found[b], new, k) if b in found else new
            way = TaskContext.get().partitionId() % MERGE_WAYS
            for b, (s, i, v) in found.items():
                owner = np.broadcast_to(q_ids[b:b + TILE_QUERIES][:, None], s.shape)
                yield pd.DataFrame({"query_id": owner[v], "vec_id": i[v], "score": s[v], "way": np.int32(way)})

        part = vectors.mapInPandas(scan, OUT)
        lists = part if lists is None else lists.unionByName(part)
    for keys in (["query_id", "way"], ["query_id"]):
        w = Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id")
        lists = lists.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return lists.select("query_id", "rank", "vec_id", "score")


def op7_topk_search(spark, sf_dir: str) -> DataFrame:
    """Every vector whose id is divisible by 50 against all vectors, five best each."""
    vectors = table(spark, sf_dir, "embeddings")
    return search(vectors, vectors.where(F.col("vec_id") % 50 == 0), 5)


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
