"""Typed telemetry records from event payloads of unknown make: seven record types out of one VARIANT, bad payloads kept apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scrub import scrubbed_json

#: The record types, their fields and what each must have.
RECORDS = {
    "llm_call": {"model": "string", "latency_ms": "long", "finish_reason": "string", "cost_usd": "double", "kind": "string", "prompt_tokens": "long", "completion_tokens": "long", "total_tokens": "long", "cache_read_tokens": "long", "cache_creation_tokens": "long"},
    "hf_job_submit": {"job_id": "string", "job_url": "string", "flavor": "string", "timeout": "string", "job_type": "string", "image": "string", "namespace": "string", "push_to_hub": "boolean"},
    "hf_job_complete": {"job_id": "string", "flavor": "string", "final_status": "string", "wall_time_s": "long"},
    "feedback": {"rating": "string", "turn_index": "long", "message_id": "string", "comment": "string"},
    "dataset_upload": {"repo_id": "string", "filename": "string", "size_bytes": "long", "status": "string"},
    "model_chat": {"model_id": "string", "message_count": "long", "status": "string"},
    "provider_error": {"provider": "string", "operation": "string", "error": "string"},
}
NEEDED = {"llm_call": ("model", "latency_ms"), "hf_job_submit": ("job_type",), "hf_job_complete": ("final_status",), "feedback": ("rating",), "dataset_upload": ("repo_id", "filename"), "model_chat": ("model_id",), "provider_error": ("provider", "operation")}
#: What a field is where the payload has none, and the greatest length of the longest ones.
DEFAULTS = {("hf_job_submit", "flavor"): "cpu-basic", ("hf_job_submit", "timeout"): "30m", ("llm_call", "kind"): "main", ("llm_call", "cost_usd"): 0.0, ("hf_job_submit", "push_to_hub"): False, ("feedback", "comment"): ""}
CUT = {("feedback", "comment"): 500, ("provider_error", "error"): 500}


def _field(v: Column, kind: str, name: str, type_: str) -> Column:
    got = F.try_variant_get(v, f"$.{name}", type_)
    if most := CUT.get((kind, name)):
        got = F.left(got, F.lit(most))
    if (kind, name) in DEFAULTS:
        got = F.coalesce(got, F.lit(DEFAULTS[kind, name]))
    if name == "wall_time_s":
        got = F.greatest(got, F.lit(0).cast("long"))
    return got


def routed(events: DataFrame, kind: str = "event_type", data: str = "data") -> DataFrame:
    """All columns but the payload, ``problem``, and for each record type a struct of its name, null but in the rows of that type that have no problem;
    ``payload`` holds the scrubbed text of rows with one.

    Problems: unknown type, not an object (also null and broken JSON), missing F, bad F (a value that is no such type), the first in the
    order of fields. Payloads are scrubbed whole, before anything is read or cut. A type's rows are ``records(routed, type)``."""
    rest = [F.col(f"`{c}`") for c in events.columns if c != data]
    rows = events.select(*rest, scrubbed_json(F.col(data)).alias("_data")).withColumn("_v", F.try_parse_json("_data"))
    whole = F.coalesce(F.startswith(F.schema_of_variant("_v"), F.lit("OBJECT")), F.lit(False))
    value = lambda f: F.try_variant_get("_v", f"$.{f}", "variant")
    there = lambda f: value(f).isNotNull() & ~F.is_variant_null(value(f))
    known, problem = F.lit(None).cast("string"), F.when(~F.coalesce(F.col(kind).isin(*RECORDS), F.lit(False)), "unknown type").when(~whole, "not an object")
    for name, fields in RECORDS.items():
        own = F.coalesce(
            *(F.when(~there(f), F.lit(f"missing {f}")) for f in NEEDED[name]),
            *(F.when(there(f) & F.try_variant_get("_v", f"$.{f}", t).isNull(), F.lit(f"bad {f}")) for f, t in fields.items()),
        )
        known = F.when(F.col(kind) == name, own).otherwise(known)
    rows = rows.withColumn("problem", F.coalesce(problem, known))
    structs = [F.when((F.col(kind) == name) & F.col("problem").isNull(), F.struct(*(_field(F.col("_v"), name, f, t).alias(f) for f, t in fields.items()))).alias(name) for name, fields in RECORDS.items()]
    return rows.select(*rest, "problem", F.when(F.col("problem").isNotNull(), F.col("_data")).alias("payload"), *structs)


def records(routed_rows: DataFrame, kind: str, *keys: str) -> DataFrame:
    """The good rows of one type: ``keys`` and the type's own fields."""
    return routed_rows.where(F.col(kind).isNotNull()).select(*keys, f"{kind}.*")
