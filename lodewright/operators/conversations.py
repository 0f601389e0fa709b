"""Operators on ordered conversations (conv_id, turn, role, text): windows partitioned by conversation, never a global order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _by():
    return W.partitionBy("conv_id")


def _in_order():
    return _by().orderBy("turn")


def assembled(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, messages): one row per conversation, messages in turn order."""
    listed = F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content"))))
    return turns.groupBy("conv_id").agg(F.count("*").alias("n_turns"), listed.alias("m")).select("conv_id", "n_turns", F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("messages"))


def complete(turns: DataFrame) -> DataFrame:
    """(conv_id, has_both): whether a user and an assistant say something that is not blank."""
    said = lambda role: F.bool_or((F.col("role") == role) & (F.trim(F.coalesce("text", F.lit(""))) != ""))
    return turns.groupBy("conv_id").agg((said("user") & said("assistant")).alias("has_both"))


def last_answered(turns: DataFrame) -> DataFrame:
    """(conv_id, question_turn, question, answer_turn, answer): the last assistant turn after some user turn, with the nearest one."""
    user = lambda c: F.last(F.when(F.col("role") == "user", F.col(c)), True).over(_in_order().rowsBetween(W.unboundedPreceding, -1))
    pairs = turns.withColumn("question_turn", user("turn")).withColumn("question", user("text")).where("role = 'assistant' AND question_turn IS NOT NULL")
    best = pairs.groupBy("conv_id").agg(F.max_by(F.struct("question_turn", "question", F.col("turn").alias("answer_turn"), F.col("text").alias("answer")), "turn").alias("p"))
    return best.select("conv_id", "p.*")


def undone(turns: DataFrame) -> DataFrame:
    """Without everything from the last user turn on; system rows stay. With no user turn only system rows stay."""
    last = F.max(F.when(F.col("role") == "user", F.col("turn"))).over(_by())
    return turns.withColumn("_l", last).where("role = 'system' OR turn < _l").drop("_l")


def before_user(turns: DataFrame, n: int) -> DataFrame:
    """Rows before the n-th (from 0) user turn; the first row never counts as one. Conversations with fewer are unchanged."""
    first = F.min("turn").over(_by())
    nth = F.sum(F.when((F.col("role") == "user") & (F.col("turn") > F.col("_f")), 1).otherwise(0)).over(_in_order())
    return turns.withColumn("_f", first).withColumn("_n", nth).where(F.col("_n") <= n).drop("_f", "_n")


def runs(turns: DataFrame) -> DataFrame:
    """(conv_id, run, role, first_turn, n): runs of consecutive turns of one role."""
    new = F.when(F.lag("role").over(_in_order()).eqNullSafe(F.col("role")) & F.lag("turn").over(_in_order()).isNotNull(), 0).otherwise(1)
    marked = turns.withColumn("_c", new).withColumn("run", F.sum("_c").over(_in_order()))
    return marked.groupBy("conv_id", "run", "role").agg(F.min("turn").alias("first_turn"), F.count("*").alias("n"))


def merged_assistant(turns: DataFrame) -> DataFrame:
    """(conv_id, first_turn, role, text): adjacent assistant turns become one, texts joined by a newline; others stay."""
    new = F.when((F.col("role") == "assistant") & (F.lag("role").over(_in_order()) == "assistant"), 0).otherwise(1)
    marked = turns.withColumn("_c", new).withColumn("_g", F.sum("_c").over(_in_order()))
    parts = marked.groupBy("conv_id", "_g", "role").agg(F.min("turn").alias("first_turn"), F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("p"))
    return parts.select("conv_id", "first_turn", "role", F.array_join(F.transform("p", lambda x: x["text"]), "\n").alias("text"))


def compacted(turns: DataFrame, keep: int = 5) -> DataFrame:
    """System rows, the first user row, and the tail that starts at the last user turn at or before the ``keep``-th row from the end."""
    ranked = turns.withColumn("_r", F.row_number().over(_by().orderBy(F.desc("turn")))).withColumn("_u", F.min(F.when(F.col("role") == "user", F.col("turn"))).over(_by()))
    start = F.max(F.when((F.col("role") == "user") & (F.col("_r") >= keep), F.col("turn"))).over(_by())
    return ranked.withColumn("_s", start).where("role = 'system' OR turn = _u OR turn >= coalesce(_s, -1)").drop("_r", "_u", "_s")


def repeated_calls(calls: DataFrame, turns: DataFrame | None = None, lookback: int = 30, least: int = 3) -> DataFrame:
    """Of (conv_id, turn, name, arguments, and place within the turn if there): (conv_id, kind, pattern) where the calls of the last ``lookback``
    messages hold ``least`` equal ones in a row, or end in a block of two to five calls that stands twice or more, the shortest first.

    ``turns`` (conv_id, turn) are all messages; without them turn numbers count messages and the last call's is the last. Calls of one turn
    without a place stand by signature. A pattern is the name of the equal call, or the signatures of the block."""
    if turns is None:
        recent = calls.withColumn("_from", F.max("turn").over(_by()) - (lookback - 1))
    else:
        nth = F.row_number().over(_by().orderBy(F.desc("turn")))
        first = turns.select("conv_id", "turn").distinct().withColumn("_n", nth).where(F.col("_n") <= lookback).groupBy("conv_id").agg(F.min("turn").alias("_from"))
        recent = calls.join(first, "conv_id")
    signed = F.concat_ws(":", "name", F.left(F.md5(F.coalesce("arguments", F.lit("")).cast("binary")), F.lit(12)))
    place = F.col("place") if "place" in calls.columns else F.lit(0)
    own = recent.where("turn >= _from").select("conv_id", F.struct(F.col("turn"), place.alias("place"), signed.alias("s"), F.coalesce("name", F.lit("")).alias("name")).alias("c"))
    lists = own.groupBy("conv_id").agg(F.array_sort(F.collect_list("c")).alias("c")).select("conv_id", F.transform("c", lambda x: x["s"]).alias("a"), F.transform("c", lambda x: x["name"]).alias("names")).where(F.size("a") >= least)
    same = F.filter(F.sequence(F.lit(0), F.size("a") - least), lambda i: F.size(F.array_distinct(F.slice("a", i + 1, least))) == 1)
    out = F.when(F.size(same) > 0, F.struct(F.lit("identical").alias("kind"), F.get("names", F.get(same, F.lit(0)).cast("int")).alias("pattern")))
    for k in range(2, 6):
        tail, before = F.slice("a", F.greatest(F.size("a") - k + 1, F.lit(1)), k), F.slice("a", F.greatest(F.size("a") - 2 * k + 1, F.lit(1)), k)
        out = F.coalesce(out, F.when((F.size("a") >= 2 * k) & (tail == before), F.struct(F.lit("repeating").alias("kind"), F.array_join(tail, " ").alias("pattern"))))
    return lists.select("conv_id", out.alias("d")).where("d IS NOT NULL").select("conv_id", "d.*")


def dangling(calls: DataFrame, results: DataFrame) -> DataFrame:
    """Calls (tool_call_id, ...) without a result."""
    return calls.join(results.select("tool_call_id").distinct(), "tool_call_id", "left_anti")


def visible(turns: DataFrame) -> DataFrame:
    """Without system and tool rows and user rows that are internal nudges."""
    return turns.where("role NOT IN ('system', 'tool') AND NOT (role = 'user' AND ltrim(text) LIKE '[SYSTEM:%')")


def log_lines(logs: DataFrame, key: str = "log_id") -> DataFrame:
    """Of (log_id, text): lines in order; of each line the last non-empty carriage-return segment; of consecutive progress lines the last."""
    lines = logs.select(key, F.posexplode(F.split("text", "\n")).alias("n", "raw"))
    lines = lines.withColumn("line", F.coalesce(F.expr("try_element_at(filter(split(raw, '\\r'), x -> trim(x) <> ''), -1)"), F.lit("")))
    lines = lines.withColumn("_p", F.col("line").rlike(r"(?i)^\s*(downloading|.*\d+%\|)"))
    nxt = F.lead("_p").over(W.partitionBy(key).orderBy("n"))
    return lines.withColumn("_x", nxt).where("NOT (_p AND coalesce(_x, false))").select(key, "n", "line")
