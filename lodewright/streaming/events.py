"""Structured Streaming forms of the event operators; each takes a streaming or a batch DataFrame unless it says otherwise."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.text import redacted


def sequenced(events: DataFrame, key: str = "user_id") -> DataFrame:
    """(key, seq, ts, event_type, data): dense sequence numbers per key in order of arrival, text redacted; the state is the last number."""

    def number(k, batches: Iterator, state: GroupState) -> Iterator:
        import pandas as pd

        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        last = state.get[0] if state.exists else 0
        rows["seq"] = range(last + 1, last + 1 + len(rows))
        state.update((last + len(rows),))
        yield rows[[key, "seq", "ts", "event_type", "data"]]

    clean = events.select(key, "event_id", "ts", "event_type", redacted(F.col("props")).alias("data"))
    return clean.groupBy(key).applyInPandasWithState(number, f"{key} long, seq long, ts timestamp, event_type string, data string", "last long", "append", GroupStateTimeout.NoTimeout)


def daily_counts(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Marks per user and UTC day; the watermark (an extension, the batch form has none) bounds the state."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy("user_id", F.window("ts", "1 day")).agg(F.count("*").alias("n")).select("user_id", F.to_date("window.start").alias("day"), "n")


def replay(stored: DataFrame, live: DataFrame, after: int, key: tuple[str, ...] = ("session_id", "seq")) -> DataFrame:
    """Stored events after a sequence number, then live ones, each (session, seq) once. Batch; in a stream the same rows are dropped by
    ``dropDuplicatesWithinWatermark`` and the checkpoint stands for the cursor."""
    return stored.where(F.col("seq") > after).unionByName(live.where(F.col("seq") > after)).dropDuplicates(list(key))


def merged_deltas(deltas: DataFrame) -> DataFrame:
    """(message_id, content, finish_reason) of streamed pieces (message_id, seq, delta, finish_reason)."""
    parts = F.array_sort(F.collect_list(F.struct("seq", F.coalesce("delta", F.lit("")).alias("d"))))
    return deltas.groupBy("message_id").agg(F.array_join(F.transform(parts, lambda x: x["d"]), "").alias("content"), F.max_by("finish_reason", F.when(F.col("finish_reason").isNotNull(), F.col("seq"))).alias("finish_reason"))


def fan_out(events: DataFrame, sinks: dict[str, object], checkpoint: str):
    """One streaming source to several subscribers (name -> function of a batch), each batch read once."""

    def each(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        for write in sinks.values():
            write(batch, batch_id)
        batch.unpersist()

    return events.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)


def heartbeats(events: DataFrame, seconds: float, key: str = "session_id", ts: str = "ts") -> DataFrame:
    """(key, ts) of the events at which a session is saved: the first one arms the timer, later ones fire once the interval has passed
    since it was armed or fired last. For streams; the state is one time. No interval, no saves; null times are passed over."""

    def gate(k, batches: Iterator, state: GroupState) -> Iterator:
        import pandas as pd

        last, fired = state.get[0] if state.exists else None, []
        for t in sorted(t for b in batches for t in b[ts].dropna()):
            if last is None:
                last = t.timestamp()
            elif t.timestamp() - last >= seconds > 0:
                last = t.timestamp()
                fired.append(t)
        if last is not None:
            state.update((last,))
        yield pd.DataFrame({key: [k[0]] * len(fired), ts: pd.Series(fired, dtype="datetime64[ns]")})

    kind = events.schema[key].dataType.simpleString()
    return events.select(key, ts).groupBy(key).applyInPandasWithState(gate, f"{key} {kind}, {ts} timestamp", "last double", "append", GroupStateTimeout.NoTimeout)
