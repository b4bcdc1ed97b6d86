"""Mixing sources to target weights by Pfair scheduling.

The documents of each source, in the order of their hashed ids, form blocks of ``BLOCK``
documents.  A source with weight w gets release times floor(i / w) and deadlines
ceil((i + 1) / w) for its blocks i = 0, 1, ...; at each time slot the released block with the
earliest deadline goes next.  Up to any slot t, each source has then had less than one block
more or less than w * t, as long as it lasts.  When a source has run out its slots stay empty,
and the others keep their proportions; every document gets a place.

Weights are taken as exact fractions, never rounded, and deadlines as decimals of 38 digits.  Which
block goes next depends on all before it, so one row folds over the blocks; it keeps only the
sources' state before every ``CHUNK``-th block, and the chunks' turns are then made in parallel.
Sources without a block left ask for no slot.

``op6_pfair_mix`` alone follows its SQL: there weights are rounded to shares n / Q of a cycle of
Q = ``SLOTS`` * (number of sources) slots with a slot for every source at least, and the cycle
is repeated.  The bound of one block then holds for the shares and not for the weights.

Defined results: a null source is a source of its own, named ''; rows with the same ``doc_id``
follow each other by their text's hash; weights default to the square root of the sources'
document counts; a source whose weight is missing or null gets one of ``SLOTS`` * (number of
sources) slots; a source of weight 0 (or below 2**-32 of the sum) comes after all others have
ended; other columns are ignored; no rows give none.
"""
from __future__ import annotations

import math
from decimal import Decimal
from fractions import Fraction

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tonality.llm.common import saved, table, text_or_empty

BLOCK = 16
SLOTS = 50


def _ranked(docs: DataFrame, source: str) -> DataFrame:
    """(doc_id, source, _row, idx): each row's place in its source.  A source is cut into 4096
    ranges of the hashed id; ranks count inside a range and start from the sum of those before,
    so no task holds a whole source and the rank depends on the row alone."""
    key = F.md5(F.col("doc_id").cast("string"))
    rows = docs.select("doc_id", F.coalesce(F.col(source), F.lit("")).alias("source"), F.xxhash64(text_or_empty()).alias("_row"),
                       F.coalesce(key, F.lit("")).alias("_key")).withColumn("_range", F.substring("_key", 1, 3))
    sums = rows.groupBy("source", "_range").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("source").orderBy("_range")) - F.col("_n")
    sums = sums.select("source", "_range", before.alias("_before"))
    inside = F.row_number().over(Window.partitionBy("source", "_range").orderBy("_key", "doc_id", "_row"))
    return rows.withColumn("_inside", inside).join(sums, ["source", "_range"]).select(
        "doc_id", "source", "_row", (F.col("_before") + F.col("_inside") - 1).alias("idx"))


def targets(counts: DataFrame, weights: DataFrame | None = None) -> dict[str, tuple[int, Fraction]]:
    """By source its number of rows and its exact share; the shares add up to 1, or all are 0.
    ``counts`` has (source, c)."""
    c = {r.source: r.c for r in counts.collect()}  # a row for each source
    if weights is None:
        w = {s: Fraction(math.sqrt(n)) for s, n in c.items()}
    else:
        given = weights.where("weight IS NOT NULL").groupBy("source").agg(F.sum(F.col("weight").cast("double")).alias("w"))
        w = {r.source: max(Fraction(r.w), Fraction(0)) for r in given.join(counts.select("source"), "source").collect()}
        least = sum(w.values()) / (1 << 32)
        w = {s: x if x >= least else Fraction(0) for s, x in w.items()}
        missing = [s for s in c if s not in w]
        one = sum(w.values()) / (SLOTS * len(c) - len(missing)) if any(w.values()) else Fraction(1)
        w |= dict.fromkeys(missing, one)
    total = sum(w.values()) or Fraction(1)
    return {s: (c[s], w[s] / total) for s in sorted(c)}


def shares(counts: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """(source, n, q): the share n / q of each source, q = 1."""
    rows = [(s, float(w), 1.0) for s, (_, w) in targets(counts, weights).items()]
    return counts.sparkSession.createDataFrame(rows, "source string, n double, q double")


#: Blocks scheduled by one row; the states between such rows come from one pass.
CHUNK = 1024
#: Products of block numbers and share denominators are decimals of 38 digits.
_WIDE = 10 ** 38


def _window(x, done, base):
    """(release, deadline) of block ``done`` of a source with share m / q, from slot ``base`` on."""
    at = lambda i: i.cast("decimal(38,0)") * x["q"]
    div = lambda n: F.call_function("div", n, x["m"]).cast("long")
    return base + div(at(done)), base + div(at(done + 1) + x["m"] - 1)


def _bound(value, use):
    """``use(value)`` with ``value`` evaluated once."""
    return F.transform(F.array(value), use)[0]


def _step(state, base, use):
    """``use`` of the turn that comes next (null when all blocks are placed) and the state after it:
    earliest deadline first among the released blocks, ties to the smaller source; empty slots are
    passed over."""
    left = lambda x: x["done"] < x["blocks"]
    first = F.array_min(F.transform(F.filter(state["s"], left), lambda x: x["release"]))

    def place(slot):
        due = F.filter(state["s"], lambda x: left(x) & (x["release"] <= slot))
        turn = F.array_min(F.transform(due, lambda x: F.struct(x["deadline"].alias("deadline"), x["k"].alias("k"),
                                                               x["done"].alias("block"), x["release"].alias("release"), slot.alias("slot"))))

        def after(t):
            def move(x):
                release, deadline = _window(x, x["done"] + 1, base)
                return F.when(x["k"] == t["k"], F.struct(
                    x["k"].alias("k"), x["m"].alias("m"), x["q"].alias("q"), x["blocks"].alias("blocks"), (x["done"] + 1).alias("done"),
                    release.alias("release"), deadline.alias("deadline"))).otherwise(x)

            moved = F.struct((slot + 1).alias("slot"), F.transform(state["s"], move).alias("s"))
            return use(t, F.when(t.isNull(), state).otherwise(moved))

        return _bound(turn, after)

    return _bound(F.greatest(state["slot"], first), place)


def _phase(sources: DataFrame, base: str, n_blocks: int) -> tuple[DataFrame, DataFrame]:
    """(turns, end): the turns of ``sources``, one row with ``s`` and the slot ``base`` to begin with,
    and that row with the slot after the last turn.  One fold gives the state before every
    ``CHUNK``-th turn; each state is a row, whose turns are made on their own."""
    at = F.col(base)
    begin = F.transform("s", lambda x: F.struct(
        x["k"].alias("k"), x["m"].alias("m"), x["q"].alias("q"), x["blocks"].alias("blocks"), F.lit(0).cast("long").alias("done"),
        _window(x, F.lit(0).cast("long"), at)[0].alias("release"), _window(x, F.lit(0).cast("long"), at)[1].alias("deadline")))
    start = F.struct(at.alias("slot"), begin.alias("s"))
    step = lambda state, _: _step(state, at, lambda turn, after: after)
    steps = F.sequence(F.lit(1), F.lit(CHUNK))
    chunks = -(-n_blocks // CHUNK)
    run = F.aggregate(F.sequence(F.lit(1), F.lit(chunks)), F.struct(start.alias("now"), F.array(start).alias("all")), lambda acc, _: _bound(
        F.aggregate(steps, acc["now"], step), lambda now: F.struct(now.alias("now"), F.concat(acc["all"], F.array(now)).alias("all"))))
    states = saved(sources.select(base, F.posexplode(run["all"]).alias("chunk", "state")), "mix-states")
    none = F.array().cast("array<struct<deadline:bigint,k:int,block:bigint,release:bigint,slot:bigint>>")
    made = F.aggregate(steps, F.struct(F.col("state").alias("now"), none.alias("out")), lambda acc, _: _step(
        acc["now"], at, lambda turn, after: F.struct(after.alias("now"), F.when(turn.isNull(), acc["out"]).otherwise(
            F.concat(acc["out"], F.array(turn))).alias("out"))), lambda acc: acc["out"])
    turns = states.where(F.col("chunk") < chunks).repartition("chunk").select(F.inline(made))
    return turns, states.where(F.col("chunk") == chunks).select(F.col("state.slot").alias("end"))


def _turns(counts: DataFrame, weights: DataFrame | None, block: int) -> DataFrame:
    """(source, block, slot, release, deadline) of every block.  Sources without a share follow
    at the end with equal ones."""
    spark = counts.sparkSession
    held = [(s, -(-c // block), w) for s, (c, w) in targets(counts, weights).items()]
    q = math.lcm(*(w.denominator for _, _, w in held))
    if held and q * (max(b for _, b, _ in held) + 2) >= _WIDE:
        raise ValueError("the weights' common denominator leaves no exact deadlines in 38 digits")
    main = [(k, Decimal(int(w * q)), Decimal(q), b) for k, (_, b, w) in enumerate(held) if w]
    last = [(k, Decimal(1), Decimal(0), b) for k, (_, b, w) in enumerate(held) if not w]
    last = [(k, m, Decimal(len(last)), b) for k, m, _, b in last]
    schema = "k int, m decimal(38,0), q decimal(38,0), blocks long"
    turns, base = None, spark.range(1).select(F.lit(0).cast("long").alias("end"))
    for rows in (main, last):
        if rows:
            one = spark.createDataFrame(rows, schema).agg(F.sort_array(F.collect_list(F.struct("k", "m", "q", "blocks"))).alias("s"))
            made, base = _phase(one.crossJoin(F.broadcast(base)), "end", sum(b for *_, b in rows))  # one row
            turns = made if turns is None else turns.unionByName(made)
    names = spark.createDataFrame([(k, s) for k, (s, _, _) in enumerate(held)], "k int, source string")
    if turns is None:
        turns = spark.createDataFrame([], "deadline long, k int, block long, release long, slot long")
    return saved(turns.join(F.broadcast(names), "k").select("source", "block", "slot", "release", "deadline"), "turns")  # a row for each source


def cycle_shares(counts: DataFrame, weights: DataFrame | None = None, slots: int = SLOTS) -> DataFrame:
    """(source, n, q): the slots n of each source in a cycle of q.  Every source gets one, the
    rest follows the weights, rounded by the largest remainder.  ``counts`` has (source, c)."""
    if weights is None:
        w = counts.select("source", F.sqrt("c").alias("w"))
    else:
        w = counts.join(weights.select(F.col("source"), F.col("weight").cast("double").alias("w")), "source", "left").select(
            "source", F.greatest(F.coalesce("w", F.lit(0.0)), F.lit(0.0)).alias("w"))
    total = w.agg(F.sum("w").alias("_sum"), F.count(F.lit(1)).alias("_sources"))
    w = w.crossJoin(F.broadcast(total))  # one row
    ideal = F.col("w") / F.when(F.col("_sum") > 0, F.col("_sum")).otherwise(1.0) * (F.col("_sources") * (slots - 1))
    w = w.select("source", ideal.alias("_ideal"), (F.col("_sources") * slots).alias("q")).withColumn(
        "_floor", F.floor("_ideal")).withColumn("_order", F.row_number().over(
            Window.orderBy(F.desc(F.col("_ideal") - F.col("_floor")), "source")))  # a row for each source
    left = w.agg((F.max("q") - F.count(F.lit(1)) - F.sum("_floor")).alias("_left"))
    w = w.crossJoin(F.broadcast(left))  # one row
    # without any weight the slots left over go round the sources
    rounds = F.floor((F.col("_left") - F.col("_order")) / (F.col("q") / slots)) + 1
    return w.select("source", (1 + F.col("_floor") + F.greatest(rounds, F.lit(0))).cast("long").alias("n"), "q")


def _floor(a, b):
    return ((a - F.pmod(a, b)) / b).cast("long")


def _ceil(a, b):
    return _floor(a + b - 1, b)


def cycle(share: DataFrame) -> DataFrame:
    """(source, j, slot): the slot of each source's block j in one cycle, earliest deadline
    first among the released blocks, ties to the smaller source."""
    one = share.agg(F.sort_array(F.collect_list(F.struct("source", "n"))).alias("s"), F.max("q").alias("q"))

    def step(state, t):
        q, s = F.col("q"), F.col("s")
        due = F.transform(s, lambda x, i: F.struct(_ceil((F.get(state["done"], i) + 1) * q, x["n"]).alias("d"),
                                                   i.alias("i"), x["n"].alias("n")))
        ready = F.filter(due, lambda x: (F.get(state["done"], x["i"]) < x["n"]) & (F.get(state["done"], x["i"]) * q < (t + 1) * x["n"]))
        pick = F.array_min(ready)["i"]
        return F.struct(F.transform(state["done"], lambda x, i: x + F.when(i == pick, 1).otherwise(0)).alias("done"),
                        F.concat(state["out"], F.array(pick)).alias("out"))

    start = F.struct(F.transform("s", lambda x: F.lit(0).cast("long")).alias("done"), F.array().cast("array<int>").alias("out"))
    run = F.aggregate(F.sequence(F.lit(0).cast("long"), F.col("q") - 1), start, step, lambda state: state["out"])
    slots = one.where(F.size("s") > 0).select("s", F.posexplode(run).alias("slot", "_pick")).select(
        F.get(F.col("s"), F.col("_pick"))["source"].alias("source"), F.col("slot").cast("long").alias("slot"))
    j = F.row_number().over(Window.partitionBy("source").orderBy("slot")) - 1
    return slots.select("source", j.cast("long").alias("j"), "slot")


def schedule(docs: DataFrame, weights: DataFrame | None = None, source: str = "source", block: int = BLOCK,
             slots: int | None = None) -> DataFrame:
    """(doc_id, source, _row, block, idx, slot, release, deadline) for every row of ``docs``;
    the mixed order is (slot, idx).  ``weights`` has (source, weight).  With ``slots`` the
    weights are rounded to a repeated cycle of so many slots a source."""
    counts = docs.groupBy(F.coalesce(F.col(source), F.lit("")).alias("source")).agg(F.count(F.lit(1)).alias("c"))
    if slots is None:
        ranked = _ranked(docs, source).withColumn("block", F.floor(F.col("idx") / block))
        return ranked.join(_turns(counts, weights, block), ["source", "block"]).select(
            "doc_id", "source", "_row", "block", "idx", "slot", "release", "deadline")
    # a few rows for each source, written so that the planner knows their size
    share = saved(cycle_shares(counts, weights, slots), "mix-shares")
    ranked = _ranked(docs, source).withColumn("block", F.floor(F.col("idx") / block))
    out = ranked.join(share, "source")
    out = out.withColumn("_turn", F.floor(F.col("block") / F.col("n"))).withColumn("j", F.col("block") - F.col("_turn") * F.col("n"))
    out = out.join(saved(cycle(share), "mix-cycle"), ["source", "j"])
    base, q, n = F.col("_turn") * F.col("q"), F.col("q"), F.col("n")
    return out.select("doc_id", "source", "_row", "block", "idx", (base + F.col("slot")).alias("slot"),
                      (base + _floor(F.col("j") * q, n)).alias("release"),
                      (base + _ceil((F.col("j") + 1) * q, n)).alias("deadline"))


def mix(docs: DataFrame, **kw) -> DataFrame:
    """``docs`` in the mixed order, as range partitions: the rows of the written files, taken
    file by file, follow the schedule."""
    place = schedule(docs, **kw).groupBy(F.col("doc_id").alias("_d"), F.col("_row").alias("_r")).agg(
        F.min(F.struct("slot", "idx")).alias("_place"))
    text = F.xxhash64(text_or_empty())
    out = docs.join(place, docs["doc_id"].eqNullSafe(place["_d"]) & (text == place["_r"]), "left")
    return out.orderBy(place["_place"]["slot"], place["_place"]["idx"], docs["doc_id"]).select(*[docs[c] for c in docs.columns])


def op6_pfair_mix(spark, sf_dir: str) -> DataFrame:
    """The place of every document in the mix, by its source's target weight rounded to the cycle
    that the query's SQL states."""
    return schedule(table(spark, sf_dir, "documents"), slots=SLOTS).drop("_row")


SQL = f"""
WITH RECURSIVE base AS (SELECT doc_id, coalesce(source, '') AS source FROM documents),
c AS (SELECT source, sqrt(count(*)) AS w FROM base GROUP BY source),
i AS (SELECT source, w / sum(w) OVER () * (count(*) OVER () * {SLOTS - 1}) AS ideal, count(*) OVER () * {SLOTS} AS q FROM c),
f AS (
  SELECT source, q, floor(ideal) AS fl, row_number() OVER (ORDER BY ideal - floor(ideal) DESC, source) AS o,
         q - count(*) OVER () - sum(floor(ideal)) OVER () AS left_over, count(*) OVER () AS sources FROM i),
sh AS (
  SELECT source, q, CAST(1 + fl + greatest(floor((left_over - o) / sources) + 1, 0) AS BIGINT) AS n,
         row_number() OVER (ORDER BY source) AS k FROM f),
run AS (
  SELECT CAST(-1 AS BIGINT) AS t, 0 AS pick, list_transform(list(n ORDER BY k), lambda x: CAST(0 AS BIGINT)) AS done,
         list(n ORDER BY k) AS ns, max(q) AS q FROM sh
  UNION ALL
  SELECT t + 1, p, list_transform(done, lambda x, j: x + CASE WHEN j = p THEN 1 ELSE 0 END), ns, q FROM (
    SELECT t, done, ns, q, list_min(list_transform(list_filter(range(1, len(ns) + 1),
        lambda j: done[j] < ns[j] AND done[j] * q < (t + 2) * ns[j]),
        lambda j: (((done[j] + 1) * q + ns[j] - 1) // ns[j]) * 100000 + j)) % 100000 AS p
    FROM run WHERE t + 1 < q)),
cyc AS (
  SELECT s.source, s.n, s.q, r.t AS slot, row_number() OVER (PARTITION BY s.source ORDER BY r.t) - 1 AS j
  FROM run r JOIN sh s ON s.k = r.pick WHERE r.t >= 0),
ranked AS (
  SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) - 1 AS idx FROM base),
b AS (SELECT doc_id, source, idx, idx // {BLOCK} AS block FROM ranked)
SELECT b.doc_id, b.source, b.block, b.idx, (b.block // s.n) * s.q + cyc.slot AS slot,
       (b.block // s.n) * s.q + (cyc.j * s.q) // s.n AS release,
       (b.block // s.n) * s.q + ((cyc.j + 1) * s.q + s.n - 1) // s.n AS deadline
FROM b JOIN sh s ON s.source = b.source JOIN cyc ON cyc.source = b.source AND cyc.j = b.block % s.n
"""
