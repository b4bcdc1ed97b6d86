"""Small frames for the tests of the training-data operators."""
import duckdb
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                     T.StructField("n_chars", T.LongType())])
#: Extra columns whose names the operators use inside.
CLASH = ["node", "block", "slot", "_row", "_r", "_d", "idx", "part", "seq", "rank", "train", "score", "pos", "h1", "_lines",
         "_key", "_place", "_leaked", "toxic", "n", "digest", "query_id", "component_id", "_file", "_at"]
LONG = " ".join(f"word{i % 997} the of" for i in range(20_000))


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows], DOCS)


def edge_rows():
    """Nulls, empty, blank and very long texts, ties, repeated rows."""
    return [(1, "a b c d e f g", "x"), (2, None, "x"), (3, "", None), (4, " \t\n ", "y"), (5, "one", "y"), (6, LONG, "x"),
            (7, "a b c d e f g", "y"), (7, "a b c d e f g", "y"), (8, "l1\nl2\nl3\nl4", "x"), (9, "l1\nl2\nl3\nl5", "x"),
            (None, "no id at all here", "z"), (11, "é ü 你好 \U0001F600 x\x00y", "z"), (12, "one", "z")]


def edge_docs(spark):
    df = docs(spark, edge_rows())
    for c in CLASH:
        df = df.selectExpr("*", f"'clash' AS {c}")
    return df


def empty_docs(spark):
    return docs(spark, [])


def read(sf_dir, table, columns="*"):
    return duckdb.sql(f"SELECT {columns} FROM '{sf_dir}/{table}.parquet'").fetchall()
