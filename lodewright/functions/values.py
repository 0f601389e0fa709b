"""Durations, prices, dates, coercions and JSON access."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def timeout_hours(c: Column) -> Column:
    """``30m``, ``3h``, ``1d``, ``45s`` or plain seconds as hours; null or empty is half an hour; anything else, zero or less is null."""
    t = F.lower(F.btrim(c))
    n = F.expr("try_cast(NULL AS DOUBLE)")
    number = F.regexp_extract(t, r"^([0-9]+(?:\.[0-9]+)?)([smhd]?)$", 1).try_cast("double")
    unit = F.regexp_extract(t, r"^([0-9]+(?:\.[0-9]+)?)([smhd]?)$", 2)
    hours = F.when(unit == "m", number / 60).when(unit == "h", number).when(unit == "d", number * 24).when(unit.isin("s", ""), number / 3600)
    return F.when(c.isNull() | (t == ""), F.lit(0.5)).when(number > 0, hours).otherwise(n)


def price(c: Column) -> Column:
    """First decimal number of a text, commas removed; negative numbers are not read."""
    return F.regexp_extract(F.regexp_replace(c, ",", ""), r"([0-9]+(?:\.[0-9]+)?)", 1).try_cast("double")


def utc(c: Column) -> Column:
    """ISO text as a timestamp, naive as UTC, bad as null."""
    return F.try_to_timestamp(c)


def shown_date(c: Column) -> Column:
    return F.coalesce(F.date_format(utc(c), "yyyy-MM-dd HH:mm:ss"), c, F.lit("N/A"))


def non_negative(c: Column) -> Column:
    v = c.try_cast("long")
    return F.when(v >= 0, v)


def fraction(c: Column) -> Column:
    v = c.try_cast("double")
    return F.when(v.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), v)))


def score(c: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(100), F.coalesce(c.try_cast("int"), F.lit(0))))


def confidence(points: Column, low: float, high: float) -> Column:
    return F.round(F.greatest(F.lit(low), F.least(F.lit(high), points / 100)), 2)


def higher_risk(a: Column, b: Column) -> Column:
    order = F.array(F.lit("low"), F.lit("medium"), F.lit("high"))
    return F.get(order, (F.greatest(F.array_position(order, a), F.array_position(order, b)) - 1).cast("int"))


def messages(c: Column) -> Column:
    """JSON text as role and content; bad text is an empty list."""
    return F.coalesce(F.from_json(c, "array<struct<role:string,content:string>>"), F.array().cast("array<struct<role:string,content:string>>"))


def usage(c: Column) -> Column:
    """Token counters of a usage record in JSON; the total falls back to prompt plus completion."""
    get = lambda *paths: F.coalesce(*(F.get_json_object(c, p).try_cast("long") for p in paths), F.lit(0))
    prompt, done = get("$.prompt_tokens"), get("$.completion_tokens")
    total = get("$.total_tokens")
    return F.struct(
        prompt.alias("prompt_tokens"), done.alias("completion_tokens"), F.when(total == 0, prompt + done).otherwise(total).alias("total_tokens"),
        get("$.cache_read_tokens", "$.prompt_tokens_details.cached_tokens").alias("cache_read_tokens"), get("$.cache_creation_tokens").alias("cache_creation_tokens"),
    )


def substituted(c: Column, variables: Column) -> Column:
    """A text with ``${NAME}`` and ``${NAME:-default}`` replaced from a map of variables; a name that the map has not and that has no default is an error,
    one with an empty default is empty. What comes in is not looked at again."""
    place = r"\$\{([^}:]+)(?::(-)?([^}]*))?\}"
    marks = F.regexp_extract_all(c, F.lit(place), F.lit(0))
    between = F.split(c, place, -1)

    def value(m: Column) -> Column:
        name, has, default = (F.regexp_extract(m, place, k) for k in (1, 2, 3))
        missing = F.raise_error(F.concat(F.lit("variable not set: "), name)).cast("string")
        return F.coalesce(variables[name], F.when(has == "-", default), missing)

    pieces = F.transform(F.arrays_zip(between.alias("text"), F.concat(F.transform(marks, value), F.array(F.lit(""))).alias("value")), lambda x: F.concat(x["text"], x["value"]))
    return F.when(F.size(marks) > 0, F.array_join(pieces, "")).otherwise(c)
