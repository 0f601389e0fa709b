"""Rows from JSON payloads of web services: dataset previews, hardware price lists and OpenAPI documents."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VERBS = ["get", "post", "put", "delete", "patch", "head", "options"]


def sample_rows(payload: Column) -> Column:
    """The row objects of a preview as JSON texts; rows that are not objects are left out."""
    rows = F.from_json(payload, "rows array<struct<row:string>>")["rows"]
    return F.coalesce(F.filter(F.transform(rows, lambda r: r["row"]), lambda r: r.startswith("{")), F.array().cast("array<string>"))


def schema_columns(payload: Column) -> Column:
    """Names of the features of a dataset's description, in order."""
    return F.coalesce(F.json_object_keys(F.get_json_object(payload, "$.dataset_info.features")), F.array().cast("array<string>"))


def split_rows(payload: Column, config: str, split: str) -> Column:
    """Whole ``num_examples``, else ``num_rows``, of the first split that has one; a missing config is ``default``."""
    splits = F.from_json(payload, "splits array<struct<config:string,split:string,num_examples:long,num_rows:long>>")["splits"]
    mine = F.filter(splits, lambda s: (F.coalesce(s["config"], F.lit("default")) == config) & (s["split"] == split))
    return F.get(F.filter(F.transform(mine, lambda s: F.coalesce(s["num_examples"], s["num_rows"])), lambda n: n.isNotNull()), F.lit(0))


def _operations(specs: DataFrame, spec: str) -> DataFrame:
    paths = F.from_json(F.get_json_object(spec, "$.paths"), "map<string,map<string,string>>")
    each = specs.select(F.col(spec).alias("_spec"), F.explode(paths).alias("path", "_item"))
    return each.select("_spec", "path", F.explode("_item").alias("_verb", "_op")).where(F.col("_verb").isin(VERBS))


def _tags(c: Column) -> Column:
    return F.coalesce(F.from_json(F.get_json_object(c, "$.tags"), "array<string>"), F.array().cast("array<string>"))


def endpoints(specs: DataFrame, spec: str = "spec", default_url: str = "") -> DataFrame:
    """One row per path and verb of each OpenAPI document; tags and parameters' names joined by spaces, nested parts as JSON texts."""
    op = lambda key, empty: F.coalesce(F.get_json_object("_op", f"$.{key}"), F.lit(empty))
    return _operations(specs, spec).select(
        "path", F.upper("_verb").alias("method"), op("operationId", "").alias("operation_id"), op("summary", "").alias("summary"), op("description", "").alias("description"),
        F.array_join(_tags(F.col("_op")), " ").alias("tags"), op("parameters", "[]").alias("parameters"),
        F.array_join(F.from_json(op("parameters", "[]"), "array<struct<name:string>>")["name"], " ").alias("param_names"), op("requestBody", "{}").alias("request_body"), op("responses", "{}").alias("responses"),
        F.coalesce(F.get_json_object("_spec", "$.servers[0].url"), F.lit(default_url)).alias("base_url"),
    )


def tags(specs: DataFrame, spec: str = "spec") -> DataFrame:
    """(tag): distinct tags, declared or used, sorted."""
    declared = specs.select(F.explode(F.from_json(F.get_json_object(spec, "$.tags"), "array<struct<name:string>>")["name"]).alias("tag"))
    used = _operations(specs, spec).select(F.explode(_tags(F.col("_op"))).alias("tag"))
    return declared.union(used).where("tag IS NOT NULL").distinct().orderBy("tag")


# Where price lists name hardware, its price, nested prices and nested lists, first match first.
NAMES = ("flavor", "name", "id", "value", "hardware", "hardware_flavor")
PRICES = ("price", "price_usd", "priceUsd", "price_per_hour", "pricePerHour", "hourly_price", "hourlyPrice", "usd_per_hour", "usdPerHour")
INNER_PRICES = ("pricing", "billing", "cost")
LISTS = ("hardware", "flavors", "items", "data", "jobs")


def _amount(v) -> float | None:
    if isinstance(v, str):
        digits = re.search(r"[0-9]+(\.[0-9]+)?", v.replace(",", ""))
        return float(digits[0]) if digits else None
    return float(v) if type(v) in (int, float) and v >= 0 else None


def _hourly(item: dict) -> float | None:
    prices = [_amount(item.get(k)) for k in PRICES] + [_hourly(item[k]) for k in INNER_PRICES if isinstance(item.get(k), dict)]
    return next((p for p in prices if p is not None), None)


def _priced(text: str | None) -> list[tuple[str, float]]:
    try:
        todo = [json.loads(text or "")]
    except ValueError:
        return []
    prices: dict[str, float] = {}
    while todo:
        x = todo.pop()
        if isinstance(x, list):
            todo += reversed(x)
        elif isinstance(x, dict):
            name, cost = next((x[k] for k in NAMES if isinstance(x.get(k), str) and x[k]), None), _hourly(x)
            if name and cost is not None:
                prices[name] = cost
            todo += [x[k] for k in reversed(LISTS) if x.get(k) is not None]
    return list(prices.items())


def hardware_prices(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """(flavor, usd_per_hour) of each payload, nested to any depth; in one payload the last price of a flavor holds; bad JSON has none."""

    @F.pandas_udf("array<struct<flavor:string,usd_per_hour:double>>")
    def priced(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"flavor": f, "usd_per_hour": p} for f, p in _priced(t)])

    return payloads.select(F.inline(priced(payload)))
