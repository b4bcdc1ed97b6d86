"""Dataset assembly: set operations, seeded exact-size splits, quotas, balancing.

Randomness is ``md5(seed:key)`` so a split does not depend on partitioning; exact
sizes come from a distributed dense rank (``ordering.hash_index``) compared with
cut-offs computed from a global count, never from a single-partition window."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tonality.functions.hashing import sort_key
from tonality.operators.ordering import hash_index


def union_datasets(dfs: list[DataFrame]) -> DataFrame:
    """stack datasets by column name; missing columns become null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def dedup_text(df: DataFrame, key: str = "text", order: str = "sample_id") -> DataFrame:
    """drop exact duplicate texts, keeping the first row in ``order``.

    Only a 256-bit hash, the length and the smallest ``order`` value of each text are
    shuffled (with a map-side partial aggregate, so a text repeated in a third of the
    rows is reduced first); the kept rows are then picked by their ``order`` value,
    which must be unique."""
    first = df.groupBy(F.sha2(F.col(key), 256).alias("_h"), F.length(key).alias("_len")).agg(F.min(order).alias(order))
    return df.join(first.select(order), order, "left_semi")


def _ranked(df: DataFrame, seed: int, id_col: str, partition_cols: list | None = None) -> DataFrame:
    return hash_index(df.withColumn("_shuffle", sort_key(seed, F.col(id_col))), "_shuffle", [id_col], "_rank",
                      partition_cols).drop("_shuffle")


def random_split(df: DataFrame, test_fraction: float, seed: int = 42, id_col: str = "sample_id",
                 names=("train", "test")) -> DataFrame:
    """seeded split with exact sizes (test = ceil(n * fraction)); adds ``split``."""
    total = df.agg(F.count(F.lit(1)).alias("_n"))
    r = _ranked(df, seed, id_col).join(F.broadcast(total), how="cross")
    n_train = F.col("_n") - F.ceil(F.col("_n") * F.lit(test_fraction))
    return r.withColumn("split", F.when(F.col("_rank") < n_train, names[0]).otherwise(names[1])).drop("_rank", "_n")


def three_way_split(df: DataFrame, seed: int = 42, id_col: str = "sample_id",
                    test_fraction: float = 0.2, valid_fraction: float = 0.25) -> DataFrame:
    """train / valid / test by two nested splits (0.2 test, then 0.25 of the
    rest as valid: 60 / 20 / 20)."""
    total = df.agg(F.count(F.lit(1)).alias("_n"))
    r = _ranked(df, seed, id_col).join(F.broadcast(total), how="cross")
    rest = F.col("_n") - F.ceil(F.col("_n") * F.lit(test_fraction))
    n_train = rest - F.ceil(rest * F.lit(valid_fraction))
    split = F.when(F.col("_rank") < n_train, "train").when(F.col("_rank") < rest, "valid").otherwise("test")
    return r.withColumn("split", split).drop("_rank", "_n")


def stratified_split(df: DataFrame, label: str = "label", test_fraction: float = 0.4, seed: int = 1694,
                     id_col: str = "sample_id", names=("train", "test")) -> DataFrame:
    """per-class split keeping class proportions: each class puts
    ceil(n_class * fraction) rows into the test part."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    r = _ranked(df, seed, id_col, [label]).join(counts, label)
    n_train = F.col("_n") - F.ceil(F.col("_n") * F.lit(test_fraction))
    return r.withColumn("split", F.when(F.col("_rank") < n_train, names[0]).otherwise(names[1])).drop("_rank", "_n")


def shuffle_take(df: DataFrame, n: int, seed: int = 42, id_col: str = "sample_id") -> DataFrame:
    """seeded shuffle, first ``n`` rows (a top-n: each task keeps n rows)."""
    return df.orderBy(sort_key(seed, F.col(id_col)), F.col(id_col)).limit(n)


def class_quota(df: DataFrame, quotas: dict[int, int], label: str = "label", order: str = "sample_id") -> DataFrame:
    """the first ``quotas[c]`` rows (in ``order``) of each listed class.

    The window carries a literal limit (the largest quota), so Spark plans a
    map-side group limit before the shuffle; the per-class quota is a filter."""
    q = F.try_element_at(F.create_map(*[x for k, v in quotas.items() for x in (F.lit(k), F.lit(v))]), F.col(label))
    w = Window.partitionBy(label).orderBy(order)
    ranked = df.where(F.col(label).isin(list(quotas))).withColumn("_rn", F.row_number().over(w))
    return ranked.where(F.col("_rn") <= max(quotas.values())).where(F.col("_rn") <= q).drop("_rn")


def class_skip(df: DataFrame, cls, n: int, label: str = "label", order: str = "sample_id") -> DataFrame:
    """F8: drop the first ``n`` rows (in ``order``) of class ``cls``, keep the rest.

    The rows to drop are a top-n of one class (bounded by ``n``), removed with an
    anti join; no window over the whole class."""
    first = df.where(F.col(label) == cls).orderBy(order).limit(n).select(order)
    return df.join(first, order, "left_anti")


def class_augment_pull(df: DataFrame, pull_label, take_label, n: int, label: str = "label",
                       order: str = "sample_id") -> DataFrame:
    """every row of ``pull_label`` (from all splits) plus the first ``n`` rows
    of ``take_label``."""
    pulled = df.where(F.col(label) == pull_label)
    taken = df.where(F.col(label) == take_label).orderBy(order).limit(n)
    return pulled.unionByName(taken)


def class_distribution(df: DataFrame, by=("split",), label: str = "label") -> DataFrame:
    """rows per label (per split)."""
    return df.groupBy(*by, label).agg(F.count(F.lit(1)).alias("n"))


def balance_plan(df: DataFrame, label: str = "label", keys=()) -> DataFrame:
    """rows per class and how many to add (to reach the largest class) or drop
    (to reach the smallest); the window runs over the per-class counts only."""
    keys = list(keys)
    c = df.groupBy(*keys, label).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    return (c.withColumn("max_n", F.max("n").over(w)).withColumn("min_n", F.min("n").over(w))
            .withColumn("to_add", F.col("max_n") - F.col("n")).withColumn("to_drop", F.col("n") - F.col("min_n")))


def set_difference(a: DataFrame, b: DataFrame, col: str = "line", sep: str = "=") -> DataFrame:
    """names (text before ``sep``) present in ``a`` and absent from ``b``;
    only lines containing ``sep`` count."""
    def names(df):
        return df.where(F.col(col).contains(sep)).select(F.trim(F.split_part(F.col(col), F.lit(sep), F.lit(1)))
                                                         .alias("name")).distinct()
    return names(a).join(names(b), "name", "left_anti")


def param_grid(params: dict[str, list], spark) -> DataFrame:
    """Cartesian product of parameter lists, one row per combination, in
    grid order (``grid_idx``); built by successive explodes of literal arrays."""
    df = spark.range(1).select(F.lit(0).alias("grid_idx"))
    for k, vals in params.items():
        df = df.select("*", F.posexplode(F.array(*[F.lit(v) for v in vals])).alias(f"_{k}_pos", k))
        df = df.withColumn("grid_idx", F.col("grid_idx") * len(vals) + F.col(f"_{k}_pos")).drop(f"_{k}_pos")
    return df


def product(dims: list[DataFrame]) -> DataFrame:
    """F13 over tables: Cartesian product of dimension tables (each one
    distinct-value column).  Broadcast when a dimension's size is known small."""
    out = dims[0]
    for d in dims[1:]:
        out = out.crossJoin(d)
    return out


def best_run(runs: DataFrame, metric: str = "accuracy", order=("grid_idx",)) -> DataFrame:
    """the run with the best metric; ties go to the first in grid order
    (the reference keeps a strictly better score only)."""
    return runs.orderBy(F.desc(metric), *[F.asc(c) for c in order]).limit(1)
