"""Corpus pipeline: five stages over ``documents``, each written as Parquet and read again.

The mixed order of the fourth stage is the row order of its written files; the last stage
follows it by the files' hidden metadata (file name, row index).  ``sf_dir`` gives the
stages the tables beside the documents (labels, benchmark).  Null texts count as empty
throughout; rows with the same ``doc_id`` are handled as the operators define.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonality.llm import decontaminate, grammar_output, jaccard_join, pfair, toxicity
from tonality.llm.common import saved, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored toxic go; the lexicon is learned from the labelled documents."""
    labels = table(spark, sf_dir, "labels").where(toxicity.remainder(5) != 0)
    return toxicity.keep_clean(docs, toxicity.learn(docs, labels))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of the Jaccard join stays."""
    return jaccard_join.keep_one(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.remove_leaks(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the Pfair schedule of their sources."""
    return pfair.mix(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token shards in the mixed order; (doc_id, start, n_tokens, ids_crc32) read from them.
    Frames that are not read from files are taken in ascending doc_id order."""
    if docs.inputFiles():
        name = F.col("_metadata.file_name")
        part = F.regexp_extract(name, "part-([0-9]+)", 1).try_cast("long")  # part-100000 comes after part-99999
        rows = docs.select("doc_id", "text", part.alias("_part"), name.alias("_file"), F.col("_metadata.row_index").alias("_at"))
        return grammar_output.read_documents(grammar_output.write_shards(rows, order=["_part", "_file", "_at"]))
    return grammar_output.read_documents(grammar_output.write_shards(docs))


STAGES = [
    ("toxicity", drop_toxic),
    ("jaccard_join", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("mixing", mix_sources),
    ("token_output", write_tokens),
]

#: The stages use learned weights, edit distances and a tokenizer: SQL cannot express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
