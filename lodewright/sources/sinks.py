"""Writers: JSON lines, dated partitions, one-file summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import redacted


def write_jsonl(df: DataFrame, path: str) -> None:
    """One object a line with nulls kept; Spark's committer makes it all or nothing."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_trajectories(sessions: DataFrame, path: str, ts: str = "created_at") -> None:
    """JSON lines by date, nested columns as JSON text so that files agree on a schema."""
    nested = [F.to_json(c).alias(c) if t.startswith(("array", "map", "struct")) else F.col(c) for c, t in sessions.dtypes]
    sessions.select(*nested).withColumn("date", F.to_date(ts)).write.mode("append").partitionBy("date").json(path)


def pending_uploads(sessions: DataFrame) -> DataFrame:
    return sessions.where(F.col("upload_status").isin("pending", "failed"))


def sse(events: DataFrame) -> DataFrame:
    """Server-sent-event frames of (session_id, seq, event_type, data)."""
    body = F.to_json(F.struct("event_type", "data", "seq"))
    return events.select("session_id", "seq", F.format_string("id: %d\ndata: %s\n\n", F.col("seq"), body).alias("frame"))


#: The parts of a card, and of each its lines with the fields they show, first of some.
CARD = {
    "Source": {"Base model": ("base_model",), "Dataset": ("dataset.repo_id", "dataset.path"), "Row count": ("dataset.row_count", "row_count")},
    "Training": {"Method": ("training.method",), "Hardware": ("training.hardware",), "Timeout": ("training.timeout",)},
    "Quality Intelligence": {"Trainability Risk": ("trainability.risk_level", "trainability.risk"), "Strategy Recommendation": ("strategy.strategy",), "Golden Eval": ("golden_eval.case_count",), "Post-Training Eval": ("post_training_eval.status",)},
}
UNKNOWN = "Not specified"


def card(provenance: Column, kind: str = "model") -> Column:
    """The Markdown card of a provenance in JSON: source, training, quality and limitations; what is missing or blank is said to be so."""
    shown = lambda paths: F.coalesce(*(F.nullif(F.trim(F.get_json_object(provenance, f"$.{p}")), F.lit("")) for p in paths), F.lit(UNKNOWN))
    parts = [F.lit(f"# {'Model' if kind == 'model' else 'Dataset'} Provenance")]
    for head, lines in CARD.items():
        parts += [F.lit(f"\n## {head}"), *(F.concat(F.lit(f"- {name}: "), shown(paths), F.lit(" cases") if name == "Golden Eval" else F.lit("")) for name, paths in lines.items())]
    limits = F.filter(F.from_json(F.get_json_object(provenance, "$.limitations"), "array<string>"), lambda x: F.trim(x) != "")
    listed = F.array_join(F.transform(F.when(F.size(limits) > 0, limits).otherwise(F.array(F.lit(UNKNOWN + "."))), lambda x: F.concat(F.lit("- "), x)), "\n")
    return redacted(F.concat_ws("\n", *parts, F.lit("\n## Limitations"), listed))


#: A session is tried so often, and the k-th try (from 0) waits 2 ** k seconds before the next.
TRIES = 3


def due_uploads(sessions: DataFrame, attempts: DataFrame, now: Column, tries: int = TRIES) -> DataFrame:
    """Sessions (session_id, upload_status, ...) to be uploaded at ``now``, with ``attempt`` from 0: pending or failed ones, and those without a status,
    that no attempt (session_id, attempt, status, at) has brought through, that have tries left and whose wait after the last one is over."""
    last = attempts.groupBy("session_id").agg(F.max("attempt").alias("_a"), F.max("at").alias("_at"), F.max(F.when(F.col("status") == "success", 1)).alias("_ok"))
    rows = sessions.where(F.coalesce("upload_status", F.lit("pending")).isin("pending", "failed") & F.col("session_id").isNotNull()).join(last, "session_id", "left")
    wait = F.make_dt_interval(secs=F.pow(F.lit(2.0), F.col("_a")).cast("decimal(18,6)"))
    ready = F.col("_a").isNull() | ((F.col("_a") + 1 < tries) & (F.col("_at") + wait <= now))
    return rows.where(F.col("_ok").isNull() & ready).withColumn("attempt", F.coalesce(F.col("_a") + 1, F.lit(0)).cast("int")).drop("_a", "_at", "_ok")


def upload_sessions(due: DataFrame, path: str, attempts_path: str, now: Column, start: str = "session_start_time") -> None:
    """Write sessions as JSON lines in one folder a day and session, ``date=.../session_id=...``, and one attempt each.

    A folder is replaced whole, so uploading twice leaves one row a session. Texts are redacted, nested columns written as JSON text. A session whose
    start is no time fails alone; if the write fails, the attempts of all its sessions say so and the error goes on to the caller. Attempts are
    files of their own, appended once a call."""
    spark = due.sparkSession
    day = F.to_date(F.col(start).try_cast("timestamp"))
    rows = due.withColumn("date", day)
    ok = F.col("date").isNotNull()
    plain = [redacted(F.to_json(c) if t.startswith(("array", "map", "struct", "variant")) else F.col(c).cast("string")).alias(c) if t.startswith(("array", "map", "struct", "variant")) or t == "string" else F.col(c) for c, t in due.dtypes if c not in ("session_id", "attempt", "upload_status")]
    log = lambda status, error: rows.select("session_id", "attempt", status.alias("status"), now.cast("timestamp").alias("at"), error.cast("string").alias("error")).write.mode("append").parquet(attempts_path)
    try:
        rows.where(ok).select("session_id", "date", *plain).repartition("date", "session_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date", "session_id").json(path)
    except Exception as e:
        log(F.lit("failed"), F.lit(str(e)[:500]))
        raise
    log(F.when(ok, "success").otherwise("failed"), F.when(~ok, F.lit("no start time")))


def read_attempts(spark, attempts_path: str) -> DataFrame:
    """(session_id, attempt, status, at, error) of all attempts so far; none where nothing was tried yet."""
    from pyspark.errors import AnalysisException

    kind = "session_id string, attempt int, status string, at timestamp, error string"
    try:
        return spark.read.schema(kind).parquet(attempts_path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], kind)


def scratch(spark, name: str) -> str:
    """A new folder for tables that a job writes for itself, under the folder the cluster names in ``spark.checkpoint.dir``; a temporary one on a
    local master without that setting."""
    import tempfile
    import uuid

    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not known:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a shared folder")
        known = "file://" + tempfile.mkdtemp(prefix="lodewright-")
    return f"{known.rstrip('/')}/{name}-{uuid.uuid4().hex}"
