"""Structure of message columns, numbered section trees and compaction of long conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: The keys of a message whose presence is told.
KEYS = ("role", "content", "tool_calls", "tool_call_id", "name", "function_call")


def _is(v, *kinds: str):
    return F.coalesce(F.regexp_like(F.schema_of_variant(v), F.lit("^(" + "|".join(kinds) + ")")), F.lit(False))


def message_structure(rows: DataFrame, order: str, messages: str = "messages") -> DataFrame:
    """One row on a column of messages, JSON text of a list a row: roles (sorted), keys (of KEYS, those that some message has), has_tool_calls,
    has_tool_results, schema (of all messages together), example (JSON) and n.

    The example is the first message with a call, else the first of the assistant, else the first that is not the system's, by row order
    and place; its content is cut at 100 characters. What is no list, and messages that are no objects, count nowhere; without a message all but n are
    empty. Roles of any case stay as they are."""
    each = rows.select(F.col(order).alias("o"), F.posexplode(F.from_json(messages, "array<variant>")).alias("p", "m")).where(_is(F.col("m"), "OBJECT"))
    get = lambda k: F.try_variant_get("m", f"$.{k}", "variant")
    names = F.json_object_keys(F.to_json("m"))
    has = lambda k: F.array_contains("names", k)
    # a value that says something: no null, false, zero, empty text, list or object
    true = lambda k: F.coalesce(~F.is_variant_null(get(k)) & ~F.to_json(get(k)).isin("false", "0", '""', "[]", "{}"), F.lit(False))
    role = F.when(_is(get("role"), "STRING"), F.try_variant_get("m", "$.role", "string"))
    said = each.withColumns({"names": names, "role": F.coalesce(role, F.lit("")), "call": true("tool_calls") | true("function_call"), "result": true("tool_call_id")})
    rank = F.when(F.col("call"), 0).when(F.col("role") == "assistant", 1).when(F.col("role") != "system", 2)
    content = F.try_variant_get("m", "$.content", "string")
    long = _is(get("content"), "STRING") & (F.length(content) > 100)
    pairs = F.from_json(F.to_json("m"), "map<string,variant>")
    cut = F.transform_values(pairs, lambda k, v: F.when((k == "content") & long, F.concat(F.left(content, F.lit(100)), F.lit("...")).cast("variant")).otherwise(v))
    said = said.withColumn("rank", rank)
    found = said.agg(
        F.sort_array(F.collect_set(F.when(F.col("role") != "", F.col("role")))).alias("roles"), *(F.coalesce(F.max(has(k)), F.lit(False)).alias(k) for k in KEYS),
        F.coalesce(F.max(has("tool_calls") | has("function_call")), F.lit(False)).alias("has_tool_calls"), F.coalesce(F.max(F.col("role").isin("tool", "function") | F.col("result")), F.lit(False)).alias("has_tool_results"),
        F.schema_of_variant_agg("m").alias("schema"), F.min(F.when(F.col("rank").isNotNull(), F.struct("rank", "o", "p", F.to_json(cut).alias("example")))).alias("first"), F.count("*").alias("n"),
    )
    return found.select("roles", F.array_compact(F.array(*(F.when(F.col(k), F.lit(k)) for k in KEYS))).alias("keys"), "has_tool_calls", "has_tool_results", "schema", F.col("first.example").alias("example"), "n")


def compaction(turns: DataFrame, budget: int, untouched: int = 5, share: float = 0.9) -> DataFrame:
    """Turns (conv_id, turn, role, tokens) with ``usage`` (the conversation's tokens), ``to_end`` (tokens from a turn to the end) and ``part``.

    Conversations whose usage is over ``share`` of the budget, rounded down, fall into: system (the first turn, if it is the system's), task (the first
    user turn after the first turn), summarised (what lies between it and the tail), tail (from the last user turn that leaves ``untouched``
    turns or more, the turn itself included) and dropped (other turns ahead of the task). Without such a user turn the tail begins at the second turn.
    Where nothing would be summarised, and in all other conversations, every part is kept. Null tokens count 0; turns are told apart by number."""
    by, on = W.partitionBy("conv_id"), W.partitionBy("conv_id").orderBy("turn")
    tokens = F.coalesce("tokens", F.lit(0))
    rows = turns.withColumns({
        "usage": F.sum(tokens).over(by).cast("long"), "to_end": F.sum(tokens).over(W.partitionBy("conv_id").orderBy(F.desc("turn")).rowsBetween(W.unboundedPreceding, 0)).cast("long"),
        "_i": F.row_number().over(on) - 1, "_n": F.count("*").over(by),
    })
    user = F.coalesce(F.col("role") == "user", F.lit(False))
    rows = rows.withColumn("_task", F.min(F.when(user & (F.col("_i") >= 1), F.col("_i"))).over(by)).withColumn("_last", F.max(F.when(user & (F.col("_i") > 1) & (F.col("_i") <= F.col("_n") - untouched), F.col("_i"))).over(by))
    first = F.coalesce("_task", F.lit(1))
    tail = F.coalesce("_last", F.least(F.lit(1), F.col("_n") - untouched))
    over = (F.col("usage") > int(budget * share)) & (tail > first + 1)
    part = (
        F.when(~over, "kept").when(F.col("_i") >= tail, "tail").when(F.col("_i") == F.col("_task"), "task").when(F.col("_i") > first, "summarised")
        .when((F.col("_i") == 0) & (F.col("role") == "system"), "system").otherwise("dropped")
    )
    return rows.withColumn("part", part).drop("_i", "_n", "_task", "_last")


def section_tree(sections: DataFrame) -> DataFrame:
    """Sections (page_id, pos, level, title, text) with ``id``, ``parent`` and ``whole``.

    The id is the number that leads the title, as 4, 4.1 or A.1.2 after its letter; a section without one is named after the section above it in the
    stack of headings and its place there, from 1 (a top one by its place alone), with a leading ~ so that numbers stay apart. ``parent`` is the
    position of the nearest earlier heading of a higher level (null for none) and ``whole`` the text of the section and of all below it, an
    empty line between them."""
    by = W.partitionBy("page_id").orderBy("pos")
    # the stack: for each level the last position so far, void once a heading of a higher level has come
    levels = range(0, 7)
    last = {i: F.max(F.when(F.col("level") == i, F.col("pos"))).over(by.rowsBetween(W.unboundedPreceding, -1)) for i in levels}
    rows = sections.withColumns({f"_l{i}": last[i] for i in levels})
    open_ = lambda i: F.when(F.col(f"_l{i}") >= F.greatest(F.lit(-1), F.lit(-1), *(F.coalesce(F.col(f"_l{j}"), F.lit(-1)) for j in range(1, i))), F.col(f"_l{i}"))
    above = F.lit(None).cast("int")
    for i in range(1, 7):
        above = F.when((F.col("level") > i) & open_(i).isNotNull(), open_(i)).otherwise(above)
    rows = rows.withColumn("parent", above).drop(*(f"_l{i}" for i in levels))
    number = F.nullif(F.regexp_extract(F.concat(F.trim("title"), F.lit(" ")), r"^([A-Z]?\d+(?:\.\d+)*|[A-Z](?:\.\d+)+)\s", 1), F.lit(""))
    place = F.row_number().over(W.partitionBy("page_id", "parent").orderBy("pos"))
    rows = rows.withColumns({"_number": number, "_place": place})
    page = rows.groupBy("page_id").agg(F.sort_array(F.collect_list(F.struct("pos", "level", "title", "text", "parent", "_number", "_place"))).alias("s"))
    # a page's sections in one array: ids from the top down, each after its parent
    def named(ids, x):
        made = F.coalesce(x["_number"], F.concat(F.lit("~"), F.coalesce(F.concat(F.ltrim(ids[x["parent"]], F.lit("~")), F.lit(".")), F.lit("")), x["_place"].cast("string")))
        return F.map_concat(ids, F.create_map(x["pos"], made))

    ids = page.withColumn("ids", F.aggregate("s", F.map_from_arrays(F.array().cast("array<int>"), F.array().cast("array<string>")), named))

    def end(x):
        """The first later section of no lower level, in position."""
        return F.coalesce(F.array_min(F.transform(F.filter("s", lambda y: (y["pos"] > x["pos"]) & (y["level"] <= x["level"])), lambda y: y["pos"])), F.lit(2**31 - 1))

    def whole(x):
        below = F.filter("s", lambda y: (y["pos"] >= x["pos"]) & (y["pos"] < end(x)) & (F.coalesce(y["text"], F.lit("")) != ""))
        return F.array_join(F.transform(below, lambda y: y["text"]), "\n\n")

    made = F.transform("s", lambda x: F.struct(x["pos"].alias("pos"), x["level"].alias("level"), F.element_at("ids", x["pos"]).alias("id"), x["title"].alias("title"), x["text"].alias("text"), x["parent"].alias("parent"), whole(x).alias("whole")))
    return ids.select("page_id", F.inline(made))


def abstract(sections: DataFrame) -> DataFrame:
    """(page_id, abstract): the text of the first section titled abstract, in any case; pages without one have none."""
    own = sections.where(F.lower(F.trim("title")) == "abstract")
    return own.groupBy("page_id").agg(F.min_by("text", "pos").alias("abstract"))
