"""Queries and SQL of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chains, golay, ledger, licenses, maxent, mixing, passages, pii, prefix_tree, ranking, spaced_seeds, tries, wavelet
from ._store import written


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_wavelet_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return wavelet.digest(spark, wavelet.write_shards(docs, tokenizer_path()), docs.schema["doc_id"].dataType)


def op2_rule_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = written(ledger.ledger(_table(spark, sf_dir, "documents")), "ledger")
    return rows.select("doc_id", *ledger.MEASURES[:5], (~ledger.passes("base/1")).alias("base_failed"), ledger.passes("web/2").alias("kept"), "fail_bits", *ledger.MEASURES[5:])


def rule_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of the latest web policy removes alone, from the stored ledger."""
    return ledger.ablations(written(ledger.ledger(_table(spark, sf_dir, "documents")), "ledger"), "web/2")


def op3_bradley_terry(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = ranking.train(docs, _table(spark, sf_dir, "labels"), where=~ranking.held_out())
    return ranking.score(docs, model).select("doc_id", ranking.held_out().alias("held_out"), "score", "predicted")


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.licenses(_table(spark, sf_dir, "documents"))


def op5_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "first_slot", "last_slot", "n_pieces")


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(_table(spark, sf_dir, "documents"))


def op7_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spaced_seeds.overlaps(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op8_maxent(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model, counts = maxent.train(docs, where=maxent.is_training())
    out = maxent.score(docs, model, counts)
    return out.select("doc_id", (~maxent.is_training()).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op9_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chains.toxic(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_golay_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return golay.near_duplicates(_table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id", "links")


def op11_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.without_repeats(_table(spark, sf_dir, "documents")).drop("kept")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tries.collocations(_table(spark, sf_dir, "documents"))


def op13_prefix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_tree.prefix_tree(_table(spark, sf_dir, "conversations"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        op1_wavelet_tokens, op2_rule_ledger, op3_bradley_terry, op4_licenses, op5_mix, op6_personal_data, op7_spaced_seeds, op8_maxent,
        op9_toxicity_chain, op10_golay_simhash, op11_repeated_passages, op12_collocations, op13_prefix_tree, rule_ablations,
    )
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    return {"op2_rule_ledger": ledger.SQL, "rule_ablations": ledger.ablation_sql("web/2"), "op11_repeated_passages": passages.SQL, "op12_collocations": tries.SQL, "op13_prefix_tree": prefix_tree.SQL}
