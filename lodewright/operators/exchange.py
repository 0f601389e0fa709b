"""Records as other programs exchange them: event streams, chat parts, provider lists, refs, links, workflow notes and job tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def stream_events(streams: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, pos, seq, event_type, body): the events of each stored server-sent stream.

    A blank line or the end closes an event; its data lines are joined, comments and other fields skipped. Events without data or with a
    body that is no JSON are left out. The sequence number is the body's, else that of the last id line; null if neither is a number."""
    lines = F.transform(F.split(F.col(text), "\n", -1), lambda x: F.regexp_replace(x, r"\r$", ""))
    blocks = F.split(F.array_join(lines, "\n"), "\n\n", -1)
    each = streams.select(F.col(key), F.posexplode(blocks).alias("pos", "block")).withColumn("of", F.split("block", "\n", -1))
    field = lambda name, cut: F.transform(F.filter("of", lambda x: F.startswith(x, F.lit(name))), lambda x: cut(F.substr(x, F.lit(len(name) + 1))))
    body = F.trim(F.array_join(field("data:", F.ltrim), "\n"))
    ids = field("id:", F.trim)
    out = each.select(key, "pos", body.alias("body"), F.try_element_at(ids, F.lit(-1)).alias("last_id")).where((F.col("body") != "") & F.try_parse_json("body").isNotNull())
    seq = F.coalesce(F.get_json_object("body", "$.seq"), F.col("last_id")).try_cast("long")
    return out.select(key, "pos", seq.alias("seq"), F.get_json_object("body", "$.event_type").alias("event_type"), "body")


def turns_of(messages: DataFrame, key: str) -> DataFrame:
    """(key, pos, sub, role, content, tool_calls, tool_call_id): chat messages (key, pos, role, parts) as turns of a model's conversation.

    ``parts`` are structs of type, text, toolCallId, toolName, input, output and errorText, the last three as texts. A user's message is its
    text, if any. An assistant's is its text and calls, then a tool turn for each call that has an output or an error; calls without stay
    dangling. Other roles and calls without an id or a name are left out."""
    said = F.array_join(F.transform(F.filter("parts", lambda p: p["type"] == "text"), lambda p: p["text"]), "")
    name = lambda p: F.coalesce(p["toolName"], F.when(F.startswith(p["type"], F.lit("tool-")), F.substr(p["type"], F.lit(6))))
    tool = lambda p: ((p["type"] == "dynamic-tool") | F.startswith(p["type"], F.lit("tool-"))) & (F.coalesce(p["toolCallId"], F.lit("")) != "") & (F.coalesce(name(p), F.lit("")) != "")
    calls = F.transform("tools", lambda p: F.struct(p["toolCallId"].alias("id"), name(p).alias("name"), F.coalesce(p["input"], F.lit("{}")).alias("arguments")))
    result = lambda p: F.coalesce(p["output"], F.nullif(p["errorText"], F.lit("")))
    base = messages.where(F.col("role").isin("user", "assistant")).select(key, "pos", "role", said.alias("said"), F.when(F.col("role") == "assistant", F.filter("parts", tool)).otherwise(F.filter("parts", lambda p: F.lit(False))).alias("tools"))
    turn = lambda role, content, called, call_id: F.struct(role.alias("role"), content.alias("content"), called.alias("tool_calls"), call_id.alias("tool_call_id"))
    nothing, none = F.lit(None).cast("string"), F.lit(None).cast("array<struct<id:string,name:string,arguments:string>>")
    own = F.when((F.col("said") != "") | (F.size("tools") > 0), F.array(turn(F.col("role"), F.nullif("said", F.lit("")), F.when(F.size("tools") > 0, calls), nothing)))
    answered = F.transform(F.filter("tools", lambda p: result(p).isNotNull()), lambda p: turn(F.lit("tool"), result(p), none, p["toolCallId"]))
    return base.select(key, "pos", F.posexplode(F.concat(F.coalesce(own, F.slice(F.array(turn(nothing, nothing, none, nothing)), 1, 0)), answered)).alias("sub", "t")).select(key, "pos", "sub", "t.*")


def found_section(sections: Column, query: Column) -> Column:
    """Of an array of structs with id and title, the first that is asked for: by its id, else by its title, else by a part of the title, else
    the first below the id. Null for none."""
    low = F.trim(F.lower(query))
    title = lambda s: F.lower(F.coalesce(s["title"], F.lit("")))
    rank = lambda s: F.when((s["id"] == low) | (s["id"] == query), 0).when(title(s) == low, 1).when(F.contains(title(s), low), 2).when(F.startswith(s["id"], F.concat(low, F.lit("."))), 3)
    ranked = F.filter(F.transform(sections, lambda s, i: F.struct(rank(s).alias("rank"), i.alias("i"))), lambda x: x["rank"].isNotNull())
    return F.get(sections, F.array_min(ranked)["i"])


def providers(entry: Column) -> Column:
    """The providers of a model's entry in a router's catalogue, JSON, as structs with flat prices; empty for none."""
    shape = "providers array<struct<provider:string,status:string,context_length:long,pricing:struct<input:double,output:double>,supports_tools:boolean,supports_structured_output:boolean>>"
    flat = lambda p: F.struct(
        F.coalesce(p["provider"], F.lit("")).alias("provider"), F.coalesce(p["status"], F.lit("")).alias("status"), p["context_length"].alias("context_length"), p["pricing"]["input"].alias("input_price"),
        p["pricing"]["output"].alias("output_price"), F.coalesce(p["supports_tools"], F.lit(False)).alias("supports_tools"), F.coalesce(p["supports_structured_output"], F.lit(False)).alias("supports_structured_output"),
    )
    given = F.transform(F.from_json(entry, shape)["providers"], flat)
    return F.coalesce(given, F.transform(F.from_json(F.lit('{"providers": []}'), shape)["providers"], flat))


def tree_files(listing: DataFrame) -> DataFrame:
    """(path, ref, size, url): the files of a repository's listing (path, type, sha, size, url); a missing size is 0."""
    return listing.where("type = 'blob'").select("path", F.col("sha").alias("ref"), F.coalesce("size", F.lit(0)).alias("size"), "url")


def refs_text(branches: Column, tags: Column) -> Column:
    """Two lines that list a repository's branches and tags with their counts."""
    line = lambda name, c: F.when(F.coalesce(F.size(c), F.lit(0)) > 0, F.concat(F.format_string(f"**{name} (%d):** ", F.size(c)), F.array_join(c, ", "))).otherwise(F.lit(f"**{name}:** none"))
    return F.concat_ws("\n", line("Branches", branches), line("Tags", tags))


#: First parts of a hub's paths that are no owners.
RESERVED = ("api", "collections", "datasets", "docs", "jobs", "models", "organizations", "papers", "pricing", "settings", "spaces")


def _on_host(url: Column, host: str) -> tuple[Column, Column]:
    clean = F.regexp_replace(F.trim(url), r"[.,;:!?]+$", "")
    path = F.regexp_extract(clean, rf"^https://\Q{host}\E(?::443)?(/[^?#]*)?(?:[?#].*)?$", 1)
    return clean, F.when(clean.rlike(rf"^https://\Q{host}\E(?::443)?(?:[/?#]|$)"), path)


def job_link(url: Column, host: str) -> Column:
    """The address, closing punctuation off, if it is a job's on ``host``, else null."""
    clean, path = _on_host(url, host)
    return F.when(F.startswith(path, F.lit("/jobs/")), clean)


def model_link(url: Column, host: str) -> Column:
    """The address, closing punctuation off, if it has an owner and a model on ``host``, else null."""
    clean, path = _on_host(url, host)
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    return F.when((F.size(parts) >= 2) & ~F.get(parts, F.lit(0)).isin(*RESERVED), clean)


def noted_workflow(note: Column, domains: Mapping[str, str], hosts: Mapping[str, str]) -> Column:
    """(domain_id, provider_id, dataset_repo) of a workflow's note in plain text; ``domains`` and ``hosts`` are labels by id, the first of each
    the default. The first domain and host, in their order, that the note names count."""
    low = F.lower(F.coalesce(note, F.lit("")))

    def first(labels: Mapping[str, str], marks: tuple[str, ...]) -> Column:
        named = [F.when(F.exists(F.array(*(F.contains(low, F.lit(f"{m}: {label.lower()}")) for m in marks)), lambda x: x), F.lit(i)) for i, label in labels.items()]
        return F.coalesce(*named, F.lit(next(iter(labels))))

    repo = F.nullif(F.trim(F.regexp_extract(F.coalesce(note, F.lit("")), r"(?im)^[^\S\r\n]*- dataset repo:(.*)$", 1)), F.lit(""))
    return F.struct(first(domains, ("vertical", "domain")).alias("domain_id"), first(hosts, ("compute provider",)).alias("provider_id"), repo.alias("dataset_repo"))


#: Columns of a job table after the id, with their heads and widths.
JOB_COLUMNS = (("image", "IMAGE/SPACE", 20), ("command", "COMMAND", 30), ("created", "CREATED", 19), ("status", "STATUS", 12))


def job_lines(jobs: DataFrame, ord: str) -> DataFrame:
    """(ord, line): jobs (id, image, command, created, status) as lines of a Markdown table, padded and cut; ids are never cut. Its two head
    lines have ``ord`` null and stand apart in ``head``. Without jobs there is one line that says so."""
    own = jobs.select(F.col(ord).alias("ord"), "id", *(c for c, _, _ in JOB_COLUMNS))
    wide = own.agg(F.greatest(F.max(F.length("id")), F.lit(len("JOB ID"))).alias("wide"), F.count("*").alias("n"))
    row = lambda cells: F.concat(F.lit("| "), F.array_join(F.array(*cells), " | "), F.lit(" |"))
    pad = lambda c, n: F.rpad(c, n, " ")
    wide_id = lambda c: F.concat(c, F.repeat(F.lit(" "), F.col("wide") - F.length(c)))
    cut = lambda c, n: F.when(F.length(c) > n, F.concat(F.left(c, F.lit(n - 3)), F.lit("..."))).otherwise(c)
    body = own.join(F.broadcast(wide)).select(F.lit(1).alias("head"), "ord", row([wide_id(F.col("id")), *(pad(cut(F.coalesce(c, F.lit("")), n), n) for c, _, n in JOB_COLUMNS)]).alias("line"))
    rule = F.concat(F.lit("|"), F.repeat(F.lit("-"), F.col("wide") + 2), F.lit("|"), F.lit("|".join("-" * (n + 2) for _, _, n in JOB_COLUMNS) + "|"))
    title = row([wide_id(F.lit("JOB ID")), *(F.lit(h.ljust(n)) for _, h, n in JOB_COLUMNS)])
    top = wide.select(F.explode(F.when(F.col("n") == 0, F.array(F.lit("No jobs found."))).otherwise(F.array(title, rule))).alias("line"))
    named = top.select(F.when(F.startswith("line", F.lit("|-")), 0).otherwise(-1).alias("head"), F.lit(None).cast(own.schema["ord"].dataType).alias("ord"), "line")
    return named.unionByName(body)


def restored_calls(pending: Column) -> Column:
    """Of an array of pending calls in JSON, flat or with a ``function``, those that can be called again, as JSON with id, type and function; flat
    ones without an id or a tool, and what is no object, are dropped. Null if none is left."""
    get = lambda c, p: F.get_json_object(c, p)
    quoted = lambda v: F.regexp_extract(F.to_json(F.struct(v.alias("x"))), r"(?s)^\{\"x\":(.*)\}$", 1)

    def one(c: Column) -> Column:
        given = F.coalesce(F.when(F.json_object_keys(get(c, "$.arguments")).isNotNull(), get(c, "$.arguments")), F.lit("{}"))
        flat = F.concat(F.lit('{"id": '), quoted(get(c, "$.tool_call_id")), F.lit(', "type": "function", "function": {"name": '), quoted(get(c, "$.tool")), F.lit(', "arguments": '), quoted(given), F.lit("}}"))
        whole = get(c, "$.function.name").isNotNull() & get(c, "$.id").isNotNull()
        return F.when(whole, c).when(get(c, "$.function").isNull() & get(c, "$.tool").isNotNull() & get(c, "$.tool_call_id").isNotNull(), flat)

    kept = F.array_compact(F.transform(pending, one))
    return F.when(F.size(kept) > 0, kept)


#: Roles that a message can have.
ROLES = ("system", "user", "assistant", "tool", "function", "developer")


def seeds(messages: DataFrame, message: str = "message") -> DataFrame:
    """Messages (JSON) a new session starts from: those with a known role other than the system's whose content is a text, a list or absent."""
    role, content = F.get_json_object(message, "$.role"), F.try_variant_get(F.try_parse_json(message), "$.content", "variant")
    kind = F.coalesce(F.schema_of_variant(content), F.lit("VOID"))
    return messages.where(role.isin(*(r for r in ROLES if r != "system")) & kind.rlike("^(STRING|ARRAY|VOID)"))


def found_links(text: Column, host: str) -> Column:
    """(dataset, job, model) named in a text: the dataset of a link on ``host``, else the first pair of names with a slash that is part of no link; the
    first link to a job; the model's link behind the mark of a training log. Null for none."""
    import re

    site = re.escape(host)
    first = lambda c, p: F.nullif(F.regexp_extract(c, p, 1), F.lit(""))
    linked = first(text, rf"https?://{site}/datasets/([A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+)")
    bare = first(F.regexp_replace(text, r"https?://\S+", " "), r"\b([A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+)\b")
    return F.struct(F.coalesce(linked, bare).alias("dataset"), first(text, rf"(https://{site}/jobs/[^\s)]+)").alias("job"), first(text, rf"AUTO_FINETUNE_MODEL_URL=(https://{site}/\S+)").alias("model"))


def listed_files(files: DataFrame, prefix: str = "") -> DataFrame:
    """Files under a path, by path."""
    return files.where(F.startswith("path", F.lit(prefix))).orderBy("path")


def discussions(rows: DataFrame, most: int = 20) -> DataFrame:
    """The first discussions (num, title, status, is_pull_request) by number, the latest first, with a label of kind and status."""
    label = F.concat_ws(" ", F.when(F.coalesce("is_pull_request", F.lit(False)), "PR").otherwise("discussion"), F.concat(F.lit("("), F.coalesce("status", F.lit("open")), F.lit(")")))
    return rows.orderBy(F.desc("num")).limit(most).withColumn("label", label)


def composite(parts: dict[str, DataFrame]) -> DataFrame:
    """All parts' rows by name, in the order of the parts, with ``part`` and its ``place``; columns a part lacks are null."""
    from functools import reduce

    named = [df.withColumn("part", F.lit(name)).withColumn("place", F.lit(i)) for i, (name, df) in enumerate(parts.items())]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), named)


def rendered_context(label: Column, provider: Column, dataset: Column, sections: dict[str, Column]) -> Column:
    """A workflow's context as text: label, provider, the dataset if there is one, then each section (array of lines) that has lines, a titled one
    under its title. Empty without a label."""
    lines = [F.lit("Selected ML workflow context:"), F.concat(F.lit("- Domain: "), label), F.concat(F.lit("- Compute provider: "), provider), F.when(F.trim(dataset) != "", F.concat(F.lit("- Dataset repo: "), dataset))]
    for title, items in sections.items():
        body = F.array_join(F.transform(items, lambda x: F.concat(F.lit("- "), x)), "\n")
        lines.append(F.when(F.size(items) > 0, F.concat(F.lit(f"{title}:\n" if title else ""), body)))
    return F.when(F.trim(label) != "", F.concat_ws("\n", *lines)).otherwise("")
