"""Rules over training scripts, jobs and their logs: intents, known failures and repairs, script checks, dependencies, call costs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What a request for fine-tuning says, operations that start a job, and what a training job's text holds.
FINE_TUNE = r"(?i)\b(?:fine[-\s]?tune|finetune|sft)\b"
STARTS = ("run", "uv", "scheduled run", "scheduled uv", "submit")
TRAINS = ("accelerate launch", "sfttrainer", "trainer.train", "trainingarguments", "unsloth")
TRAIN_WORDS = r"\b(?:trl|sft|dpo|grpo)\b"
TRAIN_FILES = r"(^|[\\/\s_.-])(?:train|trainer|finetune|fine[-_]?tune)(?:\.py|[\\/\s_.-]|$)"


def wants_finetune(text: Column) -> Column:
    """Whether a text asks for fine-tuning; null does not."""
    return F.coalesce(text.rlike(FINE_TUNE), F.lit(False))


def starts_training(operation: Column, parts: Column) -> Column:
    """Whether a call of ``operation`` with ``parts``, its script, command, image and dependencies, starts a training job. Null parts are skipped."""
    said = F.lower(F.array_join(parts, " "))
    marked = said.rlike("|".join(rf"\Q{m}\E" for m in TRAINS)) | said.rlike(TRAIN_WORDS) | said.rlike(TRAIN_FILES)
    return F.coalesce(F.lower(F.trim(operation)).isin(*STARTS) & marked, F.lit(False))


# A tracker that fails to sync, the lines and arguments that use it, and arguments that newer libraries call otherwise.
SYNC_FAILURE = "trackio_sync_failure"
SYNC_SIGNS = ("rank_pattern", "cannot write struct type")
SYNC_PLACES = ("trackio", "integration_utils.py", "on_push_begin")
TRACKER_LISTED = ('"trackio", ', ', "trackio"')
TRACKER_LINES = (
    r"(?md)^\s*import trackio\s*\n",
    r"(?md)^\s*from trackio\b.*\n",
    r"(?md)^\s*trackio\.(?:init|init_from_env)\(.*\)\s*\n?",
)
TRACKER_ARGUMENT = r"""report_to\s*=\s*(?:\[\s*['"]trackio['"]\s*\]|['"]trackio['"])"""
RENAMED = (
    (("max_seq_length",), (("max_seq_length=", "max_length="),)),
    (("evaluation_strategy",), (("evaluation_strategy=", "eval_strategy="),)),
    (("sfttrainer", "tokenizer"), (("tokenizer=tokenizer", "processing_class=tokenizer"),)),
)
RENAMED_RUN = (("project_name", "run_name"), (("project_name=", "project="), ("run_name=", "name=")))


def _holds(text: Column, marks: tuple[str, ...], every: bool) -> Column:
    found = F.array(*(F.contains(text, F.lit(m)) for m in marks))
    return F.forall(found, lambda x: x) if every else F.exists(found, lambda x: x)


def _replaced(text: Column, pairs: tuple[tuple[str, str], ...]) -> Column:
    for old, new in pairs:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def known_error(log: Column) -> Column:
    """The class of a known training failure, else null."""
    low = F.lower(log)
    return F.when(_holds(low, SYNC_SIGNS, True) & _holds(low, SYNC_PLACES, False), F.lit(SYNC_FAILURE))


def repaired_script(script: Column, log: Column) -> Column:
    """The script with the repairs that its failure's log calls for; null where they change nothing."""
    low = F.lower(log)
    silent = _replaced(script, tuple((old, "") for old in TRACKER_LISTED))
    for line in TRACKER_LINES:
        silent = F.regexp_replace(silent, line, "")
    silent = F.regexp_replace(silent, TRACKER_ARGUMENT, "report_to=[]")
    out = F.when(known_error(log).isNotNull(), silent).otherwise(script)
    for marks, pairs in RENAMED:
        out = F.when(_holds(low, marks, True), _replaced(out, pairs)).otherwise(out)
    out = F.when(_holds(low, RENAMED_RUN[0], False), _replaced(out, RENAMED_RUN[1])).otherwise(out)
    return F.when(out != script, out)


def kept_dependencies(dependencies: Column, log: Column, package: str = "trackio") -> Column:
    """The dependencies, without ``package`` if its sync is what failed."""
    rest = F.filter(dependencies, lambda d: F.lower(F.trim(d)) != package)
    return F.when(known_error(log).isNotNull(), rest).otherwise(dependencies)


def depends_on(dependencies: Column, package: str = "trackio") -> Column:
    """Whether any requirement names the package, with or without extras and versions."""
    wanted = rf"(?i)^\s*\Q{package}\E\s*(?:\[[^\]]+\])?\s*(?:$|[<>=!~;])"
    return F.coalesce(F.exists(dependencies, lambda d: d.rlike(wanted)), F.lit(False))


def checked_script(result: Column) -> Column:
    """(status, is_training_script, issues) of a stored script check in JSON. Issues that are no errors or warnings go, parts that miss have a
    default, and the status is the claimed one or, if the issues say so, a worse one; an unknown claim counts as none. Null for null."""
    get = lambda c, k: F.get_json_object(c, f"$.{k}")
    or_else = lambda c, k, empty: F.coalesce(F.nullif(get(c, k), F.lit("")), F.lit(empty))
    given = F.coalesce(F.from_json(result, "issues array<string>")["issues"], F.array().cast("array<string>"))
    issue = lambda x: F.struct(
        F.lower(F.coalesce(get(x, "severity"), F.lit(""))).alias("severity"), or_else(x, "code", "script_smoke_issue").alias("code"),
        or_else(x, "message", "Script smoke issue.").alias("message"), F.from_json(x, "line int")["line"].alias("line"),
    )
    issues = F.filter(F.transform(F.filter(given, lambda x: F.startswith(x, F.lit("{"))), issue), lambda x: x["severity"].isin("error", "warning"))
    claim = F.lower(F.coalesce(get(result, "status"), F.lit("")))
    found = F.when(F.exists(issues, lambda x: x["severity"] == "error"), "fail").when(F.size(issues) > 0, "warn").otherwise("pass")
    status = F.when(found == "fail", "fail").when((found == "warn") & (claim == "pass"), "warn").when(claim.isin("pass", "warn", "fail"), claim).otherwise(found)
    trains = ~F.coalesce(get(result, "is_training_script"), F.lit("false")).isin("", "false", "0", "[]", "{}")
    return F.when(result.isNotNull(), F.struct(status.alias("status"), trains.alias("is_training_script"), issues.alias("issues")))


def case_summary(cases: DataFrame) -> DataFrame:
    """(case_count, task_types): evaluation cases and the sorted distinct types of their tasks; blank types are left out."""
    return cases.agg(F.count("*").alias("case_count"), F.sort_array(F.collect_set(F.nullif("task_type", F.lit("")))).alias("task_types"))


def model_calls(events: DataFrame) -> DataFrame:
    """(model, kind, calls, latency_ms, cost_usd, total_tokens): the model calls among (event_type, data JSON), added up. A call without a kind is a main one."""
    call = F.from_json("data", "model string, kind string, latency_ms long, cost_usd double, total_tokens long")
    each = events.where("event_type = 'llm_call'").select(call.alias("c")).select("c.*").fillna({"kind": "main"})
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return each.groupBy("model", "kind").agg(F.count("*").alias("calls"), zero("latency_ms"), zero("cost_usd"), zero("total_tokens"))
