"""Grouped statistics shared by several operators."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonality.session import scratch_dir


def written(df: DataFrame, name: str, options: dict | None = None) -> DataFrame:
    """``df`` written to the shared folder and read back.  The planner then knows its size,
    so a join with it is broadcast if it is small and shuffled if it is not."""
    path = scratch_dir(df.sparkSession, name)
    df.write.options(**(options or {})).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def histogram_percentiles(hist: DataFrame, keys: list[str], value: str, count: str, probs: dict[str, float]) -> DataFrame:
    """Exact percentiles per group from a histogram ``(keys, value, count)``; a group's
    state is its distinct values, so ``value`` must be a small domain (word counts)."""
    return hist.groupBy(*keys).agg(*[F.percentile(F.col(value), F.lit(p), F.col(count)).alias(n) for n, p in probs.items()])


def group_percentiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float],
                      accuracy: int = 10000, most: int = 4096) -> DataFrame:
    """Exact per-group percentiles with linear interpolation (numpy / pandas semantics)
    for values of any kind, one row per group with one column per name in ``probs``.

    Selection by range counting, the same way at every size.  A ``percentile_approx`` sketch
    (rank error <= n / accuracy) brackets each target rank; one pass counts the rows below and
    above each bracket and the rows of every distinct value inside.  As long as a bracket holds
    more than ``most`` distinct values it is cut again by a sketch of those values, and the sums
    between the cuts tell which part holds the rank.  So a group is never gathered, and the last
    running sum is taken over at most ``most`` values.  A rank outside its bracket raises."""
    keys, name, most = list(keys), [*keys, "_name"], max(most, 2 * CUTS)
    base = df.select(*keys, F.col(value).cast("double").alias("_v")).where(F.col("_v").isNotNull())
    eps = 1.0 / accuracy
    aggs = [F.count(F.lit(1)).alias("_n")]
    for k, p in probs.items():
        edges = F.array(F.lit(max(p - 3 * eps, 0.0)), F.lit(min(p + 3 * eps, 1.0)))
        aggs.append(F.percentile_approx("_v", edges, F.lit(accuracy)).alias(f"_e_{k}"))
    bands = [F.struct(F.lit(k).alias("_name"), F.lit(p).alias("_p"), F.col(f"_e_{k}")[0].alias("_lo"), F.col(f"_e_{k}")[1].alias("_hi"))
             for k, p in probs.items()]
    bounds = written(base.groupBy(*keys).agg(*aggs).select(*keys, "_n", F.inline(F.array(*bands))), "brackets")
    h = (F.col("_n") - 1) * F.col("_p")
    # classes of rows: -1 below the bracket, 0 inside (by value), 1 above
    side = F.when(F.col("_v") < F.col("_lo"), -1).when(F.col("_v") > F.col("_hi"), 1).otherwise(0)
    j = base.join(bounds, keys).select(*name, side.alias("_side"), "_v")
    counts = written(j.groupBy(*name, "_side", F.when(F.col("_side") == 0, F.col("_v")).alias("_x")).agg(
        F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_min"), F.max("_v").alias("_max")), "bracket-counts")
    outer = counts.groupBy(*name).agg(
        F.coalesce(F.sum(F.when(F.col("_side") == -1, F.col("_c"))), F.lit(0)).alias("_below"),
        # a rank may lie one row beside its bracket: the neighbours outside
        F.max(F.when(F.col("_side") == -1, F.col("_max"))).alias("_prev"), F.min(F.when(F.col("_side") == 1, F.col("_min"))).alias("_next"),
        F.coalesce(F.sum(F.when(F.col("_side") == 1, F.col("_c"))), F.lit(0)).alias("_above"))
    state = written(outer.join(bounds, name).select(*name, "_n", "_p", "_below", "_above", "_prev", "_next", F.floor(h).alias("_k0"),
                                                    F.ceil(h).alias("_k1")), "bracket-state")
    inside = counts.where("_side = 0").select(*name, F.col("_x").alias("_v"), "_c")
    while True:
        sizes = inside.groupBy(*name).agg(F.count(F.lit(1)).alias("_d")).where(F.col("_d") > most)
        if sizes.isEmpty():
            break
        inside, state = _cut(inside, state, name, most)
    upto = F.sum("_c").over(Window.partitionBy(*name).orderBy("_v"))
    sums = inside.withColumn("_upto", upto).join(state, name).withColumn("_upto", F.col("_upto") + F.col("_below"))

    def at(rank: str, before: bool):
        hit = F.min(F.when((F.col("_upto") > F.col(rank)) & (F.col("_upto") - F.col("_c") <= F.col(rank)), F.col("_v")))
        beside = F.when(F.col(rank) == F.first("_below") - 1, F.first("_prev")) if before else F.when(
            F.col(rank) == F.col("_n") - F.first("_above"), F.first("_next"))
        return F.coalesce(hit, beside)

    pick = sums.groupBy(*name, "_n", "_p", "_k0", "_k1").agg(
        F.coalesce(at("_k0", True), at("_k0", False)).alias("_v0"), F.coalesce(at("_k1", False), at("_k1", True)).alias("_v1"))
    missed = F.raise_error(F.lit("a percentile lies outside its bracket")).cast("double")
    value_ = F.when(F.col("_v0").isNull() | F.col("_v1").isNull(), missed).when(
        F.col("_k0") == F.col("_k1"), F.col("_v0")).otherwise((F.col("_k1") - h) * F.col("_v0") + (h - F.col("_k0")) * F.col("_v1"))
    res = pick.select(*name, value_.alias("_val"))
    return res.groupBy(*keys).pivot("_name", list(probs)).agg(F.first("_val"))


#: Parts into which a bracket is cut at once.
CUTS = 64


def _cut(inside: DataFrame, state: DataFrame, name: list[str], most: int) -> tuple[DataFrame, DataFrame]:
    """One refinement: brackets of more than ``most`` values are cut in ``CUTS`` parts of about as
    many distinct values; the parts that hold the target ranks stay.  Others stay as they are."""
    points = F.array(*[F.lit(i / CUTS) for i in range(1, CUTS)])
    cuts = inside.groupBy(*name).agg(F.count(F.lit(1)).alias("_d"), F.percentile_approx("_v", points, F.lit(100 * CUTS)).alias("_cuts"))
    cuts = written(cuts.select(*name, F.when(F.col("_d") > most, F.col("_cuts")).otherwise(F.array().cast("array<double>")).alias("_cuts")), "cuts")
    part = F.size(F.filter("_cuts", lambda c: c < F.col("_v")))
    parted = inside.join(cuts, name).select(*name, part.alias("_part"), "_v", "_c")
    sums = parted.groupBy(*name, "_part").agg(F.sum("_c").alias("_s"), F.min("_v").alias("_min"), F.max("_v").alias("_max"))
    w = Window.partitionBy(*name).orderBy("_part")  # CUTS rows at most
    sums = sums.withColumn("_upto", F.sum("_s").over(w)).join(state, name).withColumn("_upto", F.col("_upto") + F.col("_below"))
    sums = sums.withColumn("_from", F.col("_upto") - F.col("_s"))
    keep = (F.col("_upto") > F.col("_k0")) & (F.col("_from") <= F.col("_k1"))
    lower, upper = F.col("_upto") <= F.col("_k0"), F.col("_from") > F.col("_k1")
    new = sums.groupBy(*name).agg(
        F.first("_n").alias("_n"), F.first("_p").alias("_p"), F.first("_k0").alias("_k0"), F.first("_k1").alias("_k1"),
        (F.first("_below") + F.coalesce(F.sum(F.when(lower, F.col("_s"))), F.lit(0))).alias("_below"),
        (F.first("_above") + F.coalesce(F.sum(F.when(upper, F.col("_s"))), F.lit(0))).alias("_above"),
        F.coalesce(F.max(F.when(lower, F.col("_max"))), F.first("_prev")).alias("_prev"),
        F.coalesce(F.min(F.when(upper, F.col("_min"))), F.first("_next")).alias("_next"))
    kept = parted.join(sums.where(keep).select(*name, "_part"), [*name, "_part"]).select(*name, "_v", "_c")
    return written(kept, "bracket-counts"), written(new, "bracket-state")


def safe_ratio(num: Column, den: Column) -> Column:
    """num / den as double; 0 when the denominator is 0 or null."""
    return F.coalesce(F.try_divide(num.cast("double"), den.cast("double")), F.lit(0.0))
