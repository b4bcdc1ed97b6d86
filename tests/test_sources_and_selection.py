"""Large quoted CSV in parts, run folders, unreadable sheets, early stop, checks inside the action,
model selection and the counts kept inside rows."""
import os
import random
from collections import Counter

import pytest
from pyspark.sql import DataFrameReader
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tonality.operators import evaluate as ev
from tonality.operators.classifier import text_classifier
from tonality.operators.model_selection import select_model
from tonality.sources import files as IO
from tonality.sources.quoted_csv import raw_records, read_quoted_csv
from tonality.sources.sheets import read_sheets
from tonality.streaming.extract import stream_take_class

CSV = T.StructType([T.StructField("sample_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("label", T.StringType())])


def _texts(n, seed=1):
    rng = random.Random(seed)
    parts = ["plain", "a,b", 'say "hi"', "two\nlines", "\n\n", "end\r\nmore", '"', '""', "é 你好", " lead", '",\n"', ""]
    return [(i, " ".join(rng.choice(parts) for _ in range(rng.randrange(0, 9))), rng.choice(["0", "1", None])) for i in range(n)]


def test_one_quoted_file_is_read_by_many_tasks(spark, tmp_path):
    df = spark.createDataFrame(_texts(6000), CSV)
    path = str(tmp_path / "csv")
    df.coalesce(1).write.option("header", True).option("escape", '"').csv(path)
    want = Counter(map(tuple, IO.read_labeled_csv(spark, path).collect()))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        assert spark.read.text(path).rdd.getNumPartitions() > 20
        assert Counter(map(tuple, read_quoted_csv(spark, path, CSV).collect())) == want and len(want) > 5000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_a_record_longer_than_several_splits_and_odd_ends(spark, tmp_path):
    long = "x\n" * 4000
    (tmp_path / "a.csv").write_text(f'sample_id,text,label\n1,"{long}",0\r\n\n2,b,1', newline="")
    (tmp_path / "b.csv").write_text('sample_id,text,label\n3,"q""q",\n')
    (tmp_path / "c.csv").write_text("sample_id,text,label\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        got = {r.sample_id: (r.text, r.label) for r in read_quoted_csv(spark, str(tmp_path), CSV).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == {1: (long, "0"), 2: ("b", "1"), 3: ('q"q', None)}
    (tmp_path / "d.csv").write_text('sample_id,text,label\n4,"open,\n')
    with pytest.raises(Exception, match="quotes do not pair up"):
        raw_records(spark, str(tmp_path)).collect()


def test_a_run_is_replaced_alone_and_files_follow_its_rows(spark, tmp_path):
    root = str(tmp_path / "runs")

    def run(model, n, mark):
        return spark.range(n).select(F.lit(model).alias("model"), F.lit("ft").alias("model_type"), F.lit("d").alias("dataset"),
                                     F.col("id").alias("sample_id"), F.lit(mark).alias("mark"))

    def state():
        return {(r.model, r.mark): r["count"] for r in spark.read.parquet(root).groupBy("model", "mark").count().collect()}

    def files(model):
        return len([f for f in os.listdir(f"{root}/model={model}/model_type=ft/dataset=d") if f.endswith(".parquet")])

    IO.write_partitioned(run("A", 1000, 1).unionByName(run("C", 5, 1)), root, rows_per_file=50)
    assert 20 <= files("A") <= 40 and files("C") == 1
    IO.write_partitioned(run("B", 10, 1), root, rows_per_file=50)
    assert state() == {("A", 1): 1000, ("B", 1): 10, ("C", 1): 5}
    IO.write_partitioned(run("A", 300, 2), root, rows_per_file=50)
    assert state() == {("A", 2): 300, ("B", 1): 10, ("C", 1): 5} and 6 <= files("A") <= 12


def test_sheets_that_cannot_be_read_are_reported(spark, tmp_path):
    def sheet(name, rows, tail=""):
        (tmp_path / name).write_text("".join(f'{{"row_idx":{i},"cells":{cells}}}\n' for i, cells in rows) + tail)

    ok = [(0, '["t1","t2"]'), *[(k, '["POSITIVE",null]') for k in range(1, 5)]]
    sheet("good.json", ok)
    sheet("two words.json", ok)
    sheet("cut.json", ok[:4], '{"row_idx":4,"cells":["POSI')
    sheet("narrow.json", [*ok[:4], (4, '["x"]')])
    sheet("empty.json", [], "\n\n")
    (tmp_path / "binary.json").write_bytes(bytes(range(256)) * 40)
    out, rejected = read_sheets(spark, str(tmp_path))
    assert {(r.sheet, r.text, r.labeler_4) for r in out.collect()} == {
        (n, t, v) for n in ("good.json", "two words.json") for t, v in (("t1", "POSITIVE"), ("t2", None))}
    reasons = {r.sheet: r.reason for r in rejected.collect()}
    assert set(reasons) == {"cut.json", "narrow.json", "empty.json", "binary.json"}
    assert reasons["cut.json"] == "unreadable rows: 1" and reasons["empty.json"] == "no rows"
    assert reasons["narrow.json"] == "unexpected sheet shape" and reasons["binary.json"].startswith("unreadable rows")


def test_stream_stops_after_n_rows_and_restarts_alike(spark, tmp_path):
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("q", T.IntegerType())])
    src = str(tmp_path / "src")
    os.makedirs(src)
    for k in range(6):
        spark.range(k * 10, k * 10 + 10).select("id", (F.col("id") % 2).cast("int").alias("q")).coalesce(1).write.parquet(f"{src}/p{k}")
        os.utime(f"{src}/p{k}")
    files = f"{src}/*"
    bad = f"{src}/p5"
    for f in os.listdir(bad):
        if f.endswith(".parquet"):  # must not be read: it comes after the n-th row
            with open(f"{bad}/{f}", "r+b") as h:
                h.truncate(10)
    out, ckpt = str(tmp_path / "out"), str(tmp_path / "ckpt")
    args = (spark, files, schema, out, "q", 1, 12)
    stream_take_class(*args, cols=["id"], checkpoint=ckpt, max_files_per_trigger=1)
    first = sorted(r.id for r in spark.read.parquet(out).collect())
    assert len(first) == 12 and all(i % 2 == 1 for i in first)
    stream_take_class(*args, cols=["id"], checkpoint=ckpt, max_files_per_trigger=1)
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == first


def test_alignment_is_checked_by_the_action(spark):
    s = spark.range(5).select(F.lit("d").alias("dataset"), F.col("id").alias("sample_id"))
    p = spark.createDataFrame([("d", i, "m") for i in range(5)], "dataset string, sample_id long, model string")
    status = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("h2", "h2")
    good = ev.attach_predictions(s, p)
    bad = [ev.attach_predictions(s, p.where("sample_id < 4")), ev.attach_predictions(s.where("sample_id < 3"), p),
           ev.attach_predictions(s, p.withColumn("sample_id", F.col("sample_id") + 100)), ev.attach_predictions(s.where("sample_id > 100"), p)]
    assert not status.getJobIdsForGroup("h2")
    assert good.count() == 5
    for b in bad:
        with pytest.raises(Exception, match="not aligned"):
            b.collect()
    assert ev.attach_predictions(s, p.where("sample_id < 4"), validate=False).count() == 4


def test_terms_are_counted_inside_the_row(spark):
    df = spark.createDataFrame([(1, "Up up the UP down's down's x"), (2, ""), (3, None), (4, "the the"), (5, "a's aa aa")], "id long, text string")
    got = {r.id: [tuple(x) for x in r.t] if r.t is not None else None for r in df.select("id", ev.term_counts("text", ["the"]).alias("t")).collect()}
    assert got[1] == [("down's", 2), ("up", 3)] and not got[2] and not got[3] and not got[4] and got[5] == [("a's", 1), ("aa", 2)]


def test_attention_is_exchanged_once(spark):
    att = spark.createDataFrame([(0, 0, 0, 0, 0.5, True)], "sample_id int, layer int, query_pos int, key_pos int, weight double, is_target boolean")
    plan = ev.layer_attention_stats(att)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(sample_id") == 1 and "Join" not in plan


def test_grid_search_keeps_the_first_best_row(spark):
    words = [["rise", "gain", "up"], ["flat", "hold", "same"], ["fall", "loss", "down"]]
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(words[i % 3]) if rng.random() < 0.9 else "noise" for _ in range(6)), i % 3) for i in range(300)]
    df = spark.createDataFrame(rows + [(900, None, 1), (901, "x", None)], "sample_id long, text string, label int")
    got = select_model(df, {"num_features": [64, 1024], "reg": [0.01, 0.01, 1e6], "max_iter": [8]})
    runs = {r.grid_idx: r for r in got.runs.collect()}
    assert sorted(runs) == list(range(6)) and {r.n for r in runs.values()} == {60}
    top = max(r.accuracy for r in runs.values())
    assert got.best["grid_idx"] == min(i for i, r in runs.items() if r.accuracy == top) and got.best["accuracy"] == top > 0.8
    assert runs[0].accuracy == runs[1].accuracy  # equal rows: the first may win, the second not
    test = got.test.first()
    assert test.n == 61 and test.accuracy > 0.8 and got.scored.count() == 61
    with pytest.raises(ValueError):
        select_model(df, {"learning_rate": [1]})


def test_sheet_files_are_listed_and_read_once(spark, tmp_path, monkeypatch):
    rows = [f'{{"row_idx":{k},"cells":["a{k}",null]}}' for k in range(5)]
    (tmp_path / "s.json").write_text("\n \t\n".join(rows) + "\n\n")
    (tmp_path / "blank.json").write_text(" \n\n")
    (tmp_path / "cut.json").write_text("\r\n".join(rows[:4]) + '\r\n{"row_idx":4,"ce\r\n')
    reads = []
    for how in ("json", "load", "text"):
        plain = getattr(DataFrameReader, how)
        monkeypatch.setattr(DataFrameReader, how, lambda self, path, *a, _plain=plain, **k: reads.append(path) or _plain(self, path, *a, **k))
    out, rejected = read_sheets(spark, str(tmp_path))
    assert reads == [str(tmp_path)]
    assert {tuple(r) for r in out.collect()} == {("s.json", 0, "a0", "a1", "a2", "a3", "a4"), ("s.json", 1, *[None] * 5)}
    assert {tuple(r) for r in rejected.collect()} == {("blank.json", "no rows"), ("cut.json", "unreadable rows: 1")}


def test_a_classifier_makes_its_training_rows_once(spark):
    made = spark.sparkContext.accumulator(0)

    def text(i):
        made.add(1)
        return ("good news", "bad news", "no news")[i % 3]

    ids = spark.range(0, 300, 1, 40).withColumn("label", (F.col("id") % 3).cast("int"))
    scored = text_classifier(ids.withColumn("text", F.udf(text)("id")), ids.select("id", "label", F.when(
        F.col("label") == 0, "good news").when(F.col("label") == 1, "bad news").otherwise("no news").alias("text")), 1 << 8, 20)
    assert made.value == 300
    assert scored.where("label = predicted_label").count() == 300


def test_a_fit_has_as_many_partitions_as_the_cores_need(spark):
    from tonality.operators.classifier import for_fit
    most = 2 * spark.sparkContext.defaultParallelism
    assert for_fit(spark.range(0, 1000, 1, 200)).rdd.getNumPartitions() == most
    assert for_fit(spark.range(0, 1000, 1, 3)).rdd.getNumPartitions() == 3
