"""Corpus pipeline: quality, near copies, benchmark leaks, source mix, tokens. Each stage reads what the one before kept.

Stages take (spark, docs, sf_dir) and return a DataFrame; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodewright.llm import golay, mixing, ranking, spaced_seeds, wavelet
from lodewright.llm._store import written
from lodewright.llm.queries import tokenizer_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the Bradley-Terry ranker does not reject, as learnt from the labelled rows that are not held out. Null texts score as empty
    ones; repeated rows share their verdict; without labels all stay; an empty table stays empty."""
    every = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = ranking.train(every, spark.read.parquet(f"{sf_dir}/labels.parquet"), where=~ranking.held_out())
    return ranking.keep_good(docs, model)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each SimHash group, the one with the smallest id (null after all ids), of several of that id the one with the smallest hash of
    all columns. Null and empty texts are one group; repeated ids with other texts are rows of their own groups."""
    return golay.one_per_group(docs)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. Null texts hold none, null items are not sought, and rows with a null id stay; all rows of an id
    go if one text of it holds an item; with an empty benchmark all stay."""
    return spaced_seeds.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources at their target weights, in whole documents, in the order of the schedule. Documents without words do not come; a null source is one of its own; rows
    that share id, text and source come equally often."""
    return mixing.remixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Wavelet-matrix shards, read back: (doc_id, start, n_tokens, ids_crc32). Null ids come first, null texts are their end id alone, and
    every copy of a row is written; an empty table gives no rows."""
    return wavelet.digest(spark, wavelet.write_shards(docs, tokenizer_path()), docs.schema["doc_id"].dataType)


STAGES = [("quality", quality), ("near_copies", near_copies), ("leaks", leaks), ("mix", mix), ("tokens", tokens)]

#: SQL cannot express the learnt ranking or the tokenizer; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
