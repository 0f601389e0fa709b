"""Sessions, events, quotas, costs and policy gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.values import timeout_hours, utc


def event_kpis(events: DataFrame) -> DataFrame:
    """(event_type, n): events by type and, with a null type, in total; one pass by grouping sets."""
    return events.groupingSets([[], ["event_type"]], "event_type").agg(F.count("*").alias("n"))


def session_kpis(sessions: DataFrame) -> DataFrame:
    """One row of overlapping counts: active (neither deleted nor ended), ended, deleted, and running jobs."""
    gone, over = F.col("visibility") == "deleted", F.col("status") == "ended"
    return sessions.agg(F.count_if(~gone & ~over).alias("active"), F.count_if(over).alias("ended"), F.count_if(gone).alias("deleted"), F.coalesce(F.sum(F.size("running_job_ids")), F.lit(0)).alias("jobs"))


def cap_for(plan: Column) -> Column:
    """Sessions a day: one on the free plan and without one, twenty on any other."""
    return F.when(F.coalesce(plan, F.lit("")).isin("", "free"), 1).otherwise(20)


def daily_quota(marks: DataFrame) -> DataFrame:
    """Of (user_id, ts, plan, mark_id): every mark with its place in the user's UTC day and whether the plan's cap admits it."""
    day = marks.withColumn("day", F.to_date("ts"))
    return day.withColumn("nth", F.row_number().over(W.partitionBy("user_id", "day").orderBy("ts", "mark_id"))).withColumn("admitted", F.col("nth") <= cap_for(F.col("plan")))


def quota_balance(marks: DataFrame) -> DataFrame:
    """Of (user_id, ts, mark_id, refund boolean): every mark with ``used``, what counts of the user's UTC day after it. A use adds one, a refund takes one
    off but never below none; a null refund is a use. The count is the running sum less its lowest point below zero so far."""
    day = W.partitionBy("user_id", "_d").orderBy("ts", "mark_id").rowsBetween(W.unboundedPreceding, 0)
    rows = marks.withColumn("_d", F.to_date("ts")).withColumn("_s", F.sum(F.when(F.coalesce("refund", F.lit(False)), -1).otherwise(1)).over(day))
    return rows.withColumn("used", (F.col("_s") - F.least(F.lit(0), F.min("_s").over(day))).cast("long")).drop("_d", "_s")


def stale(last: DataFrame, now: Column, hours: int, seen: str = "seen") -> DataFrame:
    """Rows not seen for more than so many hours; rows never seen are not stale."""
    return last.where(F.col(seen) < now - F.make_dt_interval(hours=F.lit(hours)))


def running_spend(costs: DataFrame, cap: float) -> DataFrame:
    """Of (session_id, seq, cost): spend so far, four decimals, and what remains under the cap."""
    spend = F.round(F.sum("cost").over(W.partitionBy("session_id").orderBy("seq").rowsBetween(W.unboundedPreceding, 0)), 4)
    return costs.withColumn("spend", spend).withColumn("remaining", F.greatest(F.lit(0.0), F.round(cap - F.col("spend"), 4)))


def orphan_jobs(sessions: DataFrame, now: Column, stale_hours: float) -> DataFrame:
    """(session_id, provider_id, job_id, reason) of jobs whose session is deleted, ended, or idle and stale."""
    stale = (F.col("runtime_state") == "idle") & (utc(F.col("updated_at")) < now - F.make_dt_interval(hours=F.lit(stale_hours).cast("int")))
    reason = F.when(F.col("visibility") == "deleted", "deleted").when(F.col("status") == "ended", "ended").when(stale, "stale")
    return sessions.withColumn("reason", reason).where("reason IS NOT NULL").select("session_id", "provider_id", F.explode("running_job_ids").alias("job_id"), "reason")


def job_costs(jobs: DataFrame, prices: DataFrame) -> DataFrame:
    """Jobs (flavor, timeout) with hours and cost; unknown flavors and bad timeouts have a null cost. Spark broadcasts the prices if their
    size is under its threshold."""
    hours = timeout_hours(F.col("timeout"))
    return jobs.withColumn("hours", hours).join(prices, "flavor", "left").withColumn("cost", F.round(F.col("usd_per_hour") * F.col("hours"), 4))


def overlaid_prices(static: DataFrame, live: DataFrame) -> DataFrame:
    """Static prices with live ones over them."""
    s, v = static.withColumnRenamed("usd_per_hour", "s"), live.withColumnRenamed("usd_per_hour", "v")
    return s.join(v, "flavor", "full").select("flavor", F.coalesce("v", "s").alias("usd_per_hour"))


def latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Latest row of each key over an append log."""
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy(F.desc(order)))).where("_n = 1").drop("_n")


def events_after(events: DataFrame, seq: int) -> DataFrame:
    return events.where(F.col("seq") > seq)


def sequenced(events: DataFrame, key: str = "session_id", order: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    """Dense ``seq`` from 1 in each session."""
    return events.withColumn("seq", F.row_number().over(W.partitionBy(key).orderBy(*order)))


def runtime_state(pending: Column, processing: Column, ended: Column) -> Column:
    return F.when(pending, "waiting_approval").when(processing, "processing").when(ended, "ended").otherwise("idle")


def admitted_sessions(sessions: DataFrame, overall: int = 200, per_user: int = 10) -> DataFrame:
    """Live sessions in order of creation with whether the user's and the overall capacity admit them; user ``dev`` is exempt from the
    former. The overall place is counted over days first, so no task sees every session."""
    mine = F.row_number().over(W.partitionBy("user_id").orderBy("created_at", "session_id"))
    day = F.to_date(utc(F.col("created_at")))
    rows = sessions.withColumn("_d", day).withColumn("_m", mine)
    ahead = rows.groupBy("_d").agg(F.count("*").alias("_c")).withColumn("_a", F.coalesce(F.sum("_c").over(W.orderBy("_d").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).select("_d", "_a")
    place = F.row_number().over(W.partitionBy("_d").orderBy("created_at", "session_id"))
    out = rows.withColumn("_p", place).join(ahead, "_d")
    return out.withColumn("admitted", (F.col("_a") + F.col("_p") <= overall) & ((F.col("_m") <= per_user) | (F.col("user_id") == "dev"))).drop("_d", "_m", "_p", "_a")


def approval(profile_known: Column, blocked: Column, smoke_failed: Column, scheduled: Column, required: Column, automatic: Column, cost: Column, remaining: Column, budgeted: Column | None = None) -> Column:
    """Decision on a tool call; the first reason that holds wins. Only calls that are ``budgeted`` (all unless given) are held to their cost: one
    without an estimate, or over what remains, is asked about. A null condition does not hold; nothing remaining named means no limit."""
    holds = lambda c: F.coalesce(c, F.lit(False))
    costed = F.lit(True) if budgeted is None else holds(budgeted)
    return (
        F.when(holds(blocked), "block_trainability").when(~holds(profile_known), "block_no_profile").when(holds(smoke_failed), "block_smoke").when(holds(scheduled), "ask_scheduled")
        .when(~holds(required), "allow").when(~holds(automatic), "ask").when(costed & cost.isNull(), "ask_unknown_cost").when(costed & holds(cost > remaining), "ask_over_cap").otherwise("allow_auto")
    )
