"""Dataset profile (one aggregate), shape, trainability and strategy decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import is_missing, redacted


def _own(name: str):
    """A column by its name as it is, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def _fingerprint(df: DataFrame):
    """A hash wide enough to stand for the whole row; null, type and field order count."""
    row = F.to_json(F.struct(*map(_own, df.columns)), {"ignoreNullFields": "false"})
    return F.struct(F.xxhash64(row).alias("a"), F.xxhash64(F.lit(1), row).alias("b"))


def profile(df: DataFrame, of: int | None = None) -> DataFrame:
    """One row: row_count, column_count, missing_summary, missing_fraction, duplicate_count, duplicate_fraction, profiled_row_count and
    statistics_basis: full_dataset, or sample_rows if the dataset has another number of rows, ``of``. Missing is null or blank; a null number counts too. The table is scanned once; copies meet under a 128-bit hash of the row, so no row is shuffled."""
    missing = [F.count_if(is_missing(_own(c)) if isinstance(df.schema[c].dataType, T.StringType) else _own(c).isNull()).alias(f"m{i}") for i, c in enumerate(df.columns)]
    one = df.agg(F.count("*").alias("n"), F.count_distinct(_fingerprint(df)).alias("d"), *missing)
    total = sum((F.col(f"m{i}") for i in range(len(missing))), F.lit(0))
    share = lambda a, b: F.when(b == 0, F.lit(0.0)).otherwise(F.round(a / b, 6))
    names = [x for i, c in enumerate(df.columns) for x in (F.lit(c), F.col(f"m{i}"))]
    return one.select(
        F.col("n").alias("profiled_row_count"), F.when(F.lit(of).isNull() | (F.col("n") == F.lit(of)), "full_dataset").otherwise("sample_rows").alias("statistics_basis"),
        F.coalesce(F.lit(of).cast("long"), F.col("n")).alias("row_count"), F.lit(len(df.columns)).alias("column_count"), F.create_map(*names).alias("missing_summary"),
        share(total, F.col("n") * len(df.columns)).alias("missing_fraction"), (F.col("n") - F.col("d")).alias("duplicate_count"), share(F.col("n") - F.col("d"), F.col("n")).alias("duplicate_fraction"),
    )


def cut_values(c: Column, kind: T.DataType, limit: int = 150) -> Column:
    """A value with every text in it, however deep, cut at ``limit`` characters and marked; keys of maps stay."""
    if isinstance(kind, T.StringType):
        return F.when(F.length(c) > limit, F.concat(F.left(c, F.lit(limit)), F.lit("..."))).otherwise(c)
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: cut_values(x, kind.elementType, limit))
    if isinstance(kind, T.MapType):
        return F.transform_values(c, lambda k, v: cut_values(v, kind.valueType, limit))
    if isinstance(kind, T.StructType) and kind.fields:
        return F.when(c.isNotNull(), F.struct(*(cut_values(c[f.name], f.dataType, limit).alias(f.name) for f in kind.fields)))
    return c


def sample(df: DataFrame, order: str, n: int = 3) -> DataFrame:
    """First rows by the order column, ten at most, texts in them cut at 150 characters."""
    return df.orderBy(order).limit(min(n, 10)).select(*(cut_values(_own(f.name), f.dataType).alias(f.name) for f in df.schema))


#: Columns that mark a reference table.
REFERENCE_HINTS = {
    "form no", "purpose", "section", "applicable sections", "description", "limit", "applicability", "rule", "rate", "category", "deduction", "due dates",
    "filing frequency", "user categories", "old/new regime applicability",
}
#: Columns of instruction data, and file formats by what they are good for.
INSTRUCTION_COLUMNS = (("messages",), ("prompt", "completion"), ("instruction", "output"), ("instruction", "response"), ("input", "output"), ("prompt", "chosen", "rejected"))
TABULAR, DOCUMENTS, TRAINABLE = {"csv", "xlsx", "xls"}, {"pdf", "docx"}, {"jsonl", "json", "parquet"}
#: Shapes by columns that some row must fill, in the order they are tried; a shape whose columns are there but empty is passed over.
SHAPES = (("dpo", ("prompt", "chosen", "rejected")), ("prompt_completion", ("prompt", "completion")), ("prompt_completion", ("instruction", "output")), ("prompt_completion", ("instruction", "response")))


def decide(df: DataFrame, order: str, kind: str = "parquet") -> DataFrame:
    """The profile row with shape, score, recommendation, risk, reasons, strategy and method, in one plan: the table's aggregate and its first
    three rows by the order column go through the rule tables of ``decisions``."""
    from .decisions import assessed, inferred, strategies

    rows = sample(df, order).select(F.to_json(F.struct(*map(_own, df.columns)), {"ignoreNullFields": "false"}).alias("r")).agg(F.concat(F.lit("["), F.concat_ws(",", F.collect_list("r")), F.lit("]")).alias("r"))
    one = profile(df).select("row_count", "duplicate_count", "missing_fraction", "duplicate_fraction", F.array(*(F.lit(c) for c in df.columns)).alias("columns"), F.lit(kind).alias("format"), rows.scalar().alias("sample_rows"))
    done = strategies(assessed(inferred(one)))
    t, s = F.col("trainability"), F.col("strategy")
    return done.select(
        "row_count", "duplicate_count", "missing_fraction", "shape", t["score"].alias("score"), t["recommendation"].alias("recommendation"), t["risk_level"].alias("risk"), t["reasons"].alias("reasons"),
        s["strategy"].alias("strategy"), s["method"].alias("method"), s["confidence"].alias("confidence"),
    )


def provenance(decided: DataFrame, *, base_model: str | None = None, dataset: dict | None = None, method: str | None = None, hardware: str | None = None, timeout: str | None = None, cost: float | None = None, golden_cases: int | None = None, limitations: tuple[str, ...] = ()) -> DataFrame:
    """(provenance): the row of ``decide`` and facts of a training run as redacted JSON; what is null is left out."""
    lit = lambda v, kind, name: F.lit(v).cast(kind).alias(name)
    facts = [lit(v, "string", k) for k, v in (dataset or {}).items() if v is not None]
    payload = F.struct(
        lit(base_model, "string", "base_model"), F.struct(*facts, "row_count", F.col("row_count").alias("examples_count"), F.col("shape").alias("inferred_shape")).alias("dataset"),
        "row_count", F.col("row_count").alias("examples_count"), F.struct("score", "recommendation", "risk", "reasons").alias("trainability"),
        F.struct("strategy", "method", "confidence").alias("strategy"), lit(golden_cases, "long", "golden_eval_cases"),
        F.when(F.lit(len(limitations) > 0), F.array(*(F.lit(x) for x in limitations)).cast("array<string>")).alias("limitations"),
        F.struct(lit(method, "string", "method"), lit(cost, "double", "cost_usd"), lit(hardware, "string", "hardware"), lit(timeout, "string", "timeout")).alias("training"),
    )
    return decided.select(redacted(F.to_json(payload)).alias("provenance"))
