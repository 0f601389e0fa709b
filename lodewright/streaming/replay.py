"""Replay of stored events joined to live ones, and assembly of streamed model output, each as a batch and as a stream.

The stream forms keep one small state a key and answer as the batch forms do, whatever order rows arrive in; a restart from the checkpoint
goes on where it stopped.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Event types after which a subscriber is sent no more.
TERMINAL = ("turn_complete", "approval_required", "error", "interrupted", "shutdown")


def frame(seq: Column, event_type: Column, data: Column) -> Column:
    """A server-sent-event frame; events without a number have no id line. ``data`` is JSON text, empty for an empty object."""
    quoted = lambda c: F.regexp_extract(F.to_json(F.struct(c.alias("x"))), r"(?s)^\{\"x\":(.*)\}$", 1)
    kind = F.when(event_type.isNull(), F.lit("null")).otherwise(quoted(event_type))
    body = F.concat(F.lit('{"event_type": '), kind, F.lit(', "data": '), F.when(F.coalesce(F.trim(data), F.lit("")) == "", "{}").otherwise(data))
    numbered = F.concat(F.lit("id: "), seq.cast("string"), F.lit("\ndata: "), body, F.lit(', "seq": '), seq.cast("string"), F.lit("}\n\n"))
    return F.when(seq.isNull(), F.concat(F.lit("data: "), body, F.lit("}\n\n"))).otherwise(numbered)


def _after(cursors: DataFrame | int, events: DataFrame) -> DataFrame:
    if isinstance(cursors, int):
        return events.withColumn("after", F.lit(cursors).cast("long"))
    return events.join(cursors.select("session_id", F.col("after").cast("long").alias("after")), "session_id", "left").withColumn("after", F.coalesce("after", F.lit(0)))


def replayed(stored: DataFrame, live: DataFrame, after: DataFrame | int = 0, terminal: tuple[str, ...] = TERMINAL) -> DataFrame:
    """(session_id, seq, event_type, data, frame): of (session_id, seq, event_type, data) stored and live, what a subscriber that has seen events up to
    ``after`` (a number, or (session_id, after); unknown sessions from the start) is sent: each number once, the stored one where both have
    it, in order, up to the first terminal event. Rows without a session or a number are not sent; of rows alike in number the first by type stays.
    """
    both = stored.withColumn("late", F.lit(0)).unionByName(live.withColumn("late", F.lit(1))).where("session_id IS NOT NULL AND seq IS NOT NULL")
    once = _after(after, both).where("seq > after").groupBy("session_id", "seq").agg(F.min(F.struct("late", "event_type", "data")).alias("e"))
    seen = once.select("session_id", "seq", "e.event_type", "e.data")
    over = F.max(F.when(F.col("event_type").isin(*terminal), 1)).over(W.partitionBy("session_id").orderBy("seq").rowsBetween(W.unboundedPreceding, -1))
    out = seen.withColumn("over", over).where("over IS NULL").drop("over")
    return out.withColumn("frame", frame(F.col("seq"), F.col("event_type"), F.col("data")))


def replay_stream(events: DataFrame, after: int = 0, terminal: tuple[str, ...] = TERMINAL, late: str = "1 hour", ts: str = "ts") -> DataFrame:
    """The stream form of ``replayed`` over one stream in which the stored backfill comes first and live events follow: (session_id, seq, event_type,
    data, frame).

    Numbers that come again within ``late`` are dropped before the state is met; the state of a session is its last number sent and whether
    a terminal event has gone out. A number under the last one sent is not sent any more, as a subscriber's cursor only goes on."""

    def send(key, batches: Iterator, state: GroupState) -> Iterator:
        import pandas as pd

        last, over = state.get if state.exists else (after, False)
        rows = pd.concat(list(batches)).sort_values(["seq", "event_type"])
        keep = []
        for i, (seq, kind) in enumerate(zip(rows["seq"], rows["event_type"])):
            if not over and seq > last:
                keep.append(i)
                last, over = int(seq), kind in terminal
        state.update((last, over))
        yield rows.iloc[keep][["session_id", "seq", "event_type", "data"]]

    own = events.where("session_id IS NOT NULL AND seq IS NOT NULL").withWatermark(ts, late).dropDuplicatesWithinWatermark(["session_id", "seq"])
    kind = events.schema["session_id"].dataType.simpleString()
    sent = own.select("session_id", "seq", "event_type", "data").groupBy("session_id").applyInPandasWithState(
        send, f"session_id {kind}, seq long, event_type string, data string", "last long, over boolean", "append", GroupStateTimeout.NoTimeout
    )
    return sent.withColumn("frame", frame(F.col("seq"), F.col("event_type"), F.col("data")))


CALLS = "array<struct<index:int,id:string,name:string,arguments:string>>"
MESSAGE = f"content string, tool_calls {CALLS}, finish_reason string, total_tokens long"


def assembled(pieces: DataFrame) -> DataFrame:
    """(message_id, content, tool_calls, finish_reason, total_tokens, complete) of streamed pieces (message_id, seq, content, tool_calls,
    finish_reason, total_tokens, last), ``tool_calls`` an array of (index, id, name, arguments) fragments.

    By sequence number: texts, and each call's names and arguments, are joined; a call's id, the finish reason and the token count are the last
    ones given. Calls stand by index. Content is null where no piece has any. A message is complete once the pieces up to the one marked
    ``last`` are there, numbered from 1. A number that comes again counts once, the first by its texts; rows without a message or number count nowhere."""
    known = pieces.where("message_id IS NOT NULL AND seq IS NOT NULL")
    kind = pieces.schema["message_id"].dataType.simpleString()
    one = known.groupBy("message_id", "seq").agg(F.min(F.struct(F.coalesce("content", F.lit("")).alias("content"), F.to_json("tool_calls").alias("calls"), "finish_reason", "total_tokens", F.coalesce("last", F.lit(False)).alias("last"))).alias("p"))
    one = one.select("message_id", "seq", "p.*").withColumn("calls", F.from_json("calls", CALLS))
    ordered = F.sort_array(F.collect_list(F.struct("seq", "content")))
    latest = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c)
    text = one.groupBy("message_id").agg(
        F.array_join(F.transform(ordered, lambda x: x["content"]), "").alias("content"), latest("finish_reason"), latest("total_tokens"),
        F.max(F.when(F.col("last"), F.col("seq"))).alias("end"), F.count_if(F.col("seq") >= 1).alias("n"), F.max("seq").alias("top"),
    )
    calls = one.select("message_id", "seq", F.inline("calls")).where("index IS NOT NULL")
    given = lambda c: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col("seq"))
    joined = lambda c: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", F.coalesce(c, F.lit("")).alias("t")))), lambda x: x["t"]), "").alias(c)
    made = calls.groupBy("message_id", "index").agg(F.coalesce(F.max_by("id", given("id")), F.lit("")).alias("id"), joined("name"), joined("arguments"))
    listed = made.groupBy("message_id").agg(F.sort_array(F.collect_list(F.struct("index", "id", "name", "arguments"))).alias("tool_calls"))
    out = text.join(listed, "message_id", "left")
    return out.select(
        F.col("message_id").cast(kind).alias("message_id"), F.when(F.col("content") != "", F.col("content")).alias("content"), F.coalesce("tool_calls", F.array().cast(CALLS)).alias("tool_calls"),
        "finish_reason", "total_tokens", F.coalesce((F.col("end") == F.col("n")) & (F.col("top") == F.col("end")), F.lit(False)).alias("complete"),
    )


def _merged(pieces: dict) -> tuple:
    """The fields of one message from its pieces by number."""
    content, calls, reason, tokens = [], {}, None, None
    for seq in sorted(pieces):
        text, found, why, total, _ = pieces[seq]
        content.append(text or "")
        for c in found or ():
            own = calls.setdefault(c["index"], {"index": c["index"], "id": "", "name": "", "arguments": ""})
            own["id"] = c.get("id") or own["id"]
            own["name"] += c.get("name") or ""
            own["arguments"] += c.get("arguments") or ""
        reason, tokens = why if why is not None else reason, total if total is not None else tokens
    return "".join(content) or None, [calls[i] for i in sorted(calls)], reason, tokens


def assembled_stream(pieces: DataFrame, late: str = "1 hour", ts: str = "ts") -> DataFrame:
    """The stream form of ``assembled``: a message goes out once, when its pieces up to the last are there; one whose pieces stop goes out as
    it is, not complete, once the watermark has passed its latest piece by ``late``. The state is the pieces not yet sent."""

    def gather(key, batches: Iterator, state: GroupState) -> Iterator:
        import pandas as pd

        held, done = ({int(k): v for k, v in json.loads(state.get[0]).items()}, state.get[1]) if state.exists else ({}, False)
        latest = None
        for b in batches:
            for seq, content, calls, why, total, last, at in zip(b["seq"], b["content"], b["calls"], b["finish_reason"], b["total_tokens"], b["last"], b[ts]):
                found = [c for c in json.loads(calls) if c.get("index") is not None] if isinstance(calls, str) else []
                piece = [content or "", found, why, None if pd.isna(total) else int(total), bool(last)]
                held[int(seq)] = min(held.get(int(seq), piece), piece, key=lambda p: (p[0], json.dumps(p[1])))
                latest = at if latest is None else max(latest, at)
        ends = [s for s in held if held[s][4]]
        whole = bool(ends) and max(held) == max(ends) == len(held) and min(held) >= 1
        rows = []
        if held and not done and (whole or state.hasTimedOut):
            rows, held, done = [(key[0], *_merged(held), whole)], {}, True
        if state.hasTimedOut:
            state.remove()
        else:
            state.update((json.dumps({} if done else held), done))
            if latest is not None:
                state.setTimeoutTimestamp(max(int(latest.timestamp() * 1000), state.getCurrentWatermarkMs() + 1) + wait)
        yield pd.DataFrame(rows, columns=["message_id", "content", "tool_calls", "finish_reason", "total_tokens", "complete"]).astype({"total_tokens": "Int64"})

    epoch = "TIMESTAMP'1970-01-01 00:00:00'"
    wait = pieces.sparkSession.range(1).select(F.expr(f"unix_millis({epoch} + INTERVAL {late}) - unix_millis({epoch})")).first()[0]
    kind = pieces.schema["message_id"].dataType.simpleString()
    known = pieces.where("message_id IS NOT NULL AND seq IS NOT NULL").withWatermark(ts, late)
    flat = known.select("message_id", "seq", "content", F.to_json("tool_calls").alias("calls"), "finish_reason", "total_tokens", F.coalesce("last", F.lit(False)).alias("last"), ts)
    return flat.groupBy("message_id").applyInPandasWithState(gather, f"message_id {kind}, {MESSAGE}, complete boolean", "held string, done boolean", "append", GroupStateTimeout.EventTimeTimeout)
