"""Listings, splits, uploads, previews and small joins over catalogue tables: repositories, sessions, jobs, files, papers.

Filters come before limits throughout, so a limited listing never misses rows that a later filter would have kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import human_size, is_missing

#: Bytes of one upload's files, each and together.
UPLOAD_LIMIT = 100 * 1024 * 1024


def head_split(df: DataFrame, row_index: str, share: float = 0.95) -> DataFrame:
    """Rows with ``part``: train for those whose place (from 0, dense) is under ``share`` of the count, rounded down, test for the others."""
    n = df.agg(F.floor(F.count("*") * F.lit(share))).scalar()
    return df.withColumn("part", F.when(F.col(row_index) < n, "train").otherwise("test"))


def seeded_split(df: DataFrame, key: str, seed: int = 42, percent: int = 10, least: int = 20) -> DataFrame:
    """Rows with ``part``: ``percent`` of the keys, by the first 32 bits of the MD5 of seed and key, are test; all are train in a table of under
    ``least`` rows. Rows of one key stay together; a null key is train."""
    few = df.limit(least).count() < least
    hashed = F.conv(F.left(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary")), F.lit(8)), 16, 10).cast("long")
    test = hashed % 100 < percent
    return df.withColumn("part", F.lit("train") if few else F.when(test, "test").otherwise("train"))


def checked_uploads(files: DataFrame, limit: int = UPLOAD_LIMIT) -> DataFrame:
    """(upload_id, ord, size) with ``total``, sizes so far, and ``verdict``: empty, too_large, total_too_large or ok."""
    total = F.sum("size").over(W.partitionBy("upload_id").orderBy("ord").rowsBetween(W.unboundedPreceding, 0))
    verdict = F.when(F.col("size").isNull() | (F.col("size") <= 0), "empty").when(F.col("size") > limit, "too_large").when(F.col("total") > limit, "total_too_large").otherwise("ok")
    return files.withColumn("total", total).withColumn("verdict", verdict)


def unique_names(files: DataFrame, group: str, name: str, order: str) -> DataFrame:
    """Rows with ``unique_name``: by order within a group, a name not yet used is kept, else -2, -3 and so on is put before its ending until it is
    not used. A group's names meet as one list, as those of one upload; rows of one order and name are told apart by no more than their place."""
    rest = [c for c in files.columns if c != group]
    lists = files.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(name).alias("f"), F.struct(*rest).alias("row")))).alias("files"))

    @F.pandas_udf("array<string>")
    def named(lists_of_names):
        def each(names):
            used, out = set(), []
            for full in names:
                stem, dot, ending = full.rpartition(".")
                stem, ending = (stem, dot + ending) if stem.strip(".") and "/" not in ending else (full, "")
                made, k = full, 2
                while made in used:
                    made, k = f"{stem}-{k}{ending}", k + 1
                used.add(made)
                out.append(made)
            return out

        return lists_of_names.map(each)

    both = lists.withColumn("names", named(F.transform("files", lambda x: F.coalesce(x["f"], F.lit("")))))
    return both.select(F.col(group), F.inline(F.arrays_zip(F.transform("files", lambda x: x["row"]).alias("row"), F.col("names").alias("unique_name")))).select(F.col(group), "row.*", "unique_name").select(*files.columns, "unique_name")


def matched_endpoints(hits: DataFrame, endpoints: DataFrame, order: str) -> DataFrame:
    """Hits (path, method, ...) with the first endpoint, by ``order``, of their path and method; hits without one are left out."""
    first = endpoints.groupBy("path", "method").agg(F.min_by(F.struct("*"), order).alias("endpoint"))
    return hits.join(first, ["path", "method"])


def call_states(calls: DataFrame, results: DataFrame) -> DataFrame:
    """Calls (tool_call_id, needs_approval) with ``state`` by whether a result came; several results count once."""
    seen = results.select("tool_call_id").distinct().withColumn("done", F.lit(True))
    state = F.when(F.col("done"), "output-available").when(F.coalesce("needs_approval", F.lit(False)), "approval-requested").otherwise("input-available")
    return calls.join(seen, "tool_call_id", "left").withColumn("state", state).drop("done")


def live_sessions(stored: DataFrame, live: DataFrame, key: str) -> DataFrame:
    """Stored rows, each replaced whole by the live row of its key where there is one; live rows of no stored key are not listed."""
    rest = [c for c in stored.columns if c != key]
    now = live.select(key, F.struct(*rest).alias("now"))
    both = stored.select(key, F.struct(*rest).alias("was")).join(now, key, "left")
    return both.select(key, F.coalesce("now", "was").alias("is")).select(key, "is.*")


def present(wanted: DataFrame, have: DataFrame, key: str) -> DataFrame:
    """Wanted rows that are there."""
    return wanted.join(have.select(key), key, "left_semi")


def intent_bonus(question: Column, intent: Column, points: int = 2) -> Column:
    """Points of a row whose intent, underscores as spaces, stands in the question, in any case."""
    return F.when(F.contains(F.lower(question), F.replace(F.lower(intent), F.lit("_"), F.lit(" "))), points).otherwise(0)


def configs(splits: DataFrame, order: str) -> DataFrame:
    """(config, splits, first): the splits of each config in the order of their first row, and the config's own."""
    each = splits.groupBy("config", "split").agg(F.min(order).alias("at"))
    listed = each.groupBy("config").agg(F.sort_array(F.collect_list(F.struct("at", "split"))).alias("s"), F.min("at").alias("first"))
    return listed.select("config", F.transform("s", lambda x: x["split"]).alias("splits"), "first")


def file_groups(files: DataFrame, limit: int = 10) -> DataFrame:
    """(config, split, n_files, bytes): the first ``limit`` groups by size; sizes that are no numbers count 0."""
    size = F.coalesce(F.col("size").cast("string").try_cast("long"), F.lit(0))
    return files.groupBy("config", "split").agg(F.count("*").alias("n_files"), F.sum(size).alias("bytes")).orderBy(F.desc("bytes"), "config", "split").limit(limit)


def file_total(files: DataFrame) -> DataFrame:
    """(n_files, bytes, shown)."""
    one = files.agg(F.count("*").alias("n_files"), F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("bytes"))
    return one.withColumn("shown", human_size(F.col("bytes")))


def top_values(df: DataFrame, column: str, order: str, limit: int = 5) -> DataFrame:
    """(column, n): the ``limit`` most frequent values, a null one too; ties by where they come first."""
    return df.groupBy(column).agg(F.count("*").alias("n"), F.min(order).alias("first")).orderBy(F.desc("n"), "first").limit(limit).select(column, "n")


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    """(n, values): rows and the sorted distinct values of a column of few; nulls are left out."""
    return df.agg(F.count("*").alias("n"), F.sort_array(F.collect_set(column)).alias("values"))


def provider_health(checks: DataFrame) -> DataFrame:
    """(provider, ready, ok): a provider is ready if all its checks are; ``ok`` if every provider is. A check without a result fails."""
    per = checks.groupBy("provider").agg(F.bool_and(F.coalesce("ready", F.lit(False))).alias("ready"))
    return per.join(F.broadcast(per.agg(F.bool_and("ready").alias("ok"))))


def listed_sessions(sessions: DataFrame, user: str | None, limit: int | None = None) -> DataFrame:
    """Sessions not deleted that a user owns (all for no user), the latest change first by text, then by id."""
    own = sessions.where((F.coalesce("visibility", F.lit("live")) != "deleted") & (F.lit(user is None) | F.coalesce(F.col("user_id") == F.lit(user), F.lit(False))))
    return _limited(own.orderBy(F.desc_nulls_last("updated_at"), "session_id"), limit)


def _limited(df: DataFrame, limit: int | None) -> DataFrame:
    return df if limit is None else df.limit(limit)


#: Columns by which repositories can be listed.
REPO_ORDERS = ("stars", "forks", "updated", "created")


def listed_repos(repos: DataFrame, sort: str = "stars", descending: bool = True, limit: int = 30) -> DataFrame:
    """The first repositories by one of REPO_ORDERS, ties by name, over all of them."""
    if sort not in REPO_ORDERS:
        raise ValueError(f"sort must be one of {REPO_ORDERS}")
    return repos.orderBy(F.desc_nulls_last(sort) if descending else F.asc_nulls_first(sort), "name").limit(limit)


def jobs(df: DataFrame, every: bool = False, status: str | None = None) -> DataFrame:
    """Jobs that run, or all, whose stage holds ``status`` in upper case."""
    out = df if every else df.where("stage = 'RUNNING'")
    return out.where(F.contains("stage", F.lit(status.upper()))) if status else out


def trending(papers: DataFrame, query: str, limit: int) -> DataFrame:
    """Papers (ord, title, summary, keywords) in order of which the title, the summary or any keyword holds the query, in any case."""
    q = F.lit(query.lower())
    hit = F.contains(F.lower("title"), q) | F.contains(F.lower(F.coalesce("summary", F.lit(""))), q) | F.exists(F.coalesce("keywords", F.array()), lambda k: F.contains(F.lower(k), q))
    return papers.where(F.coalesce(hit, F.lit(False))).orderBy("ord").limit(limit)


def papers_between(papers: DataFrame, first: str, last: str, citations: int, limit: int, fields: tuple[str, ...] = ()) -> DataFrame:
    """Papers dated within both days, cited often enough, of any of the fields if some are given, the most cited first."""
    out = papers.where(F.col("date").between(F.lit(first).cast("timestamp"), F.lit(last).cast("timestamp")) & (F.col("citations") >= citations))
    if fields:
        out = out.where(F.col("field").isin(*fields))
    return out.orderBy(F.desc("citations"), "paper_id").limit(limit)


def lines(text: Column, start: int | None = None, end: int | None = None, most: int = 300) -> Column:
    """Lines ``start`` to ``end`` (from 1, clamped to the text) as an array of (n, line); without a range the first ``most``. A range that begins
    behind its end or the text's gives null. How many lines there are is ``line_count``."""
    every = F.split(text, "\n", -1)
    first, last = (1, F.least(F.size(every), F.lit(most))) if start is None and end is None else (max(1, start or 1), F.size(every) if end is None else F.least(F.size(every), F.lit(end)))
    cut = F.slice(every, F.lit(first), F.greatest(last - (first - 1), F.lit(0)))
    return F.when(last >= first, F.transform(cut, lambda x, i: F.struct((i + first).alias("n"), x.alias("line"))))


def line_count(text: Column) -> Column:
    return F.size(F.split(text, "\n", -1))


def clamped(value: Column, allowed: tuple[str, ...], default: str) -> Column:
    """The value, trimmed and in lower case, if it is allowed, else the default."""
    v = F.lower(F.trim(value))
    return F.when(v.isin(*allowed), v).otherwise(default)


def _paid(plan: Column) -> Column:
    """Whether a plan's text speaks of a paid one."""
    return F.coalesce(F.lower(plan).rlike("pro|enterprise|team"), F.lit(False))


def plan_of(kind: Column, is_pro: Column, organisations: Column) -> Column:
    """pro by the plan's text, or by the mark if there is no text; else org if any organisation (an array of their plans) pays; else free."""
    said = F.coalesce(kind, F.lit(""))
    pro = _paid(said) | ((said == "") & F.coalesce(is_pro, F.lit(False)))
    return F.when(pro, "pro").when(F.coalesce(F.exists(organisations, _paid), F.lit(False)), "org").otherwise("free")


#: What a task of a to-do list must have, and its states.
TODO_FIELDS, TODO_STATES = ("id", "content", "status"), ("pending", "in_progress", "completed")


def first_bad_todo(todos: DataFrame) -> DataFrame:
    """(list_id, ord, problem): the first task of each list without a field or with an unknown status."""
    problem = F.coalesce(*(F.when(is_missing(F.col(f)), F.lit(f"missing {f}")) for f in TODO_FIELDS), F.when(~F.col("status").isin(*TODO_STATES), F.lit("bad status")))
    bad = todos.select("list_id", "ord", problem.alias("problem")).where("problem IS NOT NULL")
    return bad.groupBy("list_id").agg(F.min_by("problem", "ord").alias("problem"), F.min("ord").alias("ord")).select("list_id", "ord", "problem")


def after_install(log: DataFrame) -> DataFrame:
    """Log lines (log_id, n, line) from the first that tells of installed packages and the time taken on, after one line that says what was left
    out, under the number of the line before; all of them where there is none or it comes first."""
    w = W.partitionBy("log_id")
    told = F.trim("line").rlike(r"^Installed\s+\d+\s+packages?\s+in\s+\d+(?:\.\d+)?\s*(?:ms|s)$")
    own = log.select("log_id", "n", "line", F.min(F.when(told, F.col("n"))).over(w).alias("at"), F.lag("n").over(w.orderBy("n")).alias("before"))
    kept = own.where("at IS NULL OR n >= at OR before IS NULL AND at IS NULL").select("log_id", "n", "line")
    note = own.where("n = at AND before IS NOT NULL").select("log_id", F.col("before").alias("n"), F.lit("[installs truncated]").alias("line"))
    return kept.unionByName(note)


def cited(edges: DataFrame, paper: object) -> DataFrame:
    """(direction, paper, n): what a paper cites and what cites it, from (src, dst), each with its number of edges."""
    out = edges.where(F.col("src") == F.lit(paper)).select(F.lit("references").alias("direction"), F.col("dst").alias("paper"))
    back = edges.where(F.col("dst") == F.lit(paper)).select(F.lit("citations").alias("direction"), F.col("src").alias("paper"))
    return out.unionByName(back).groupBy("direction", "paper").agg(F.count("*").alias("n"))


def resources(branches: dict[str, tuple[DataFrame, str]], limit: int = 10) -> DataFrame:
    """(kind, name): the first ``limit`` names of every branch (table, column)."""
    out = None
    for kind, (df, name) in branches.items():
        part = df.select(F.lit(kind).alias("kind"), F.col(name).cast("string").alias("name")).orderBy("name").limit(min(limit, 10))
        out = part if out is None else out.unionByName(part)
    return out


def to_messages(question: Column, answer: Column, system: str | None = None) -> Column:
    """A system turn if one is given, the user's and the assistant's, trimmed."""
    turn = lambda role, said: F.struct(F.lit(role).alias("role"), said.alias("content"))
    head = [turn("system", F.lit(system))] if system else []
    return F.array(*head, turn("user", F.trim(question)), turn("assistant", F.trim(answer)))


def good_calls(calls: DataFrame, arguments: str = "arguments") -> DataFrame:
    """Calls with ``good``, whether the arguments are a JSON object, and with bad ones replaced by an empty one."""
    good = F.coalesce(F.json_object_keys(arguments).isNotNull(), F.lit(False))
    return calls.withColumn("good", good).withColumn(arguments, F.when(good, F.col(arguments)).otherwise("{}"))


def pending_calls(call: Column) -> Column:
    """(tool, tool_call_id, arguments) of a call in JSON, flat or with a ``function``; null where it names no tool. Arguments that are not a
    JSON object are empty."""
    get = lambda p: F.get_json_object(call, p)
    tool, given = F.coalesce(get("$.function.name"), get("$.tool"), get("$.name")), F.coalesce(get("$.function.arguments"), get("$.arguments"))
    made = F.struct(tool.alias("tool"), F.coalesce(get("$.id"), get("$.tool_call_id")).alias("tool_call_id"), F.when(F.json_object_keys(given).isNotNull(), given).otherwise("{}").alias("arguments"))
    return F.when(tool.isNotNull(), made)


def budget_state(turns: DataFrame, warn: int, stop: int, most: int = 60) -> DataFrame:
    """Turns (session_id, seq, tokens) with ``state``: stop once the largest token count so far reaches ``stop`` or ``most`` turns have gone,
    warn on the first that reaches ``warn``, else go."""
    w = W.partitionBy("session_id").orderBy("seq")
    peak, before = F.max("tokens").over(w), F.max("tokens").over(w.rowsBetween(W.unboundedPreceding, -1))
    return turns.withColumn("state", F.when((peak >= stop) | (F.row_number().over(w) > most), "stop").when((peak >= warn) & (F.coalesce(before, F.lit(0)) < warn), "warn").otherwise("go"))


def context_length(providers: DataFrame, model: str) -> DataFrame:
    """(model, context): the longest context of any live provider of a model, a tag after a colon left out; (model, provider, status, context)."""
    bare = model.split(":", 1)[0]
    return providers.where((F.col("model") == F.lit(bare)) & (F.col("status") == "live")).agg(F.lit(bare).alias("model"), F.max("context").alias("context"))


def base_model(tags: Column, own: Column) -> Column:
    """The first ``base_model:`` tag's model that is not the model itself and speaks of no fine-tune, else that of the first fine-tune's tag."""
    names = F.transform(F.filter(tags, lambda t: F.startswith(t, F.lit("base_model:"))), lambda t: F.substr(t, F.lit(12)))
    plain = F.filter(names, lambda n: ~F.contains(n, F.lit("finetune")) & (n != own))
    tuned = F.transform(F.filter(names, lambda n: F.startswith(n, F.lit("finetune:"))), lambda n: F.substr(n, F.lit(10)))
    return F.coalesce(F.get(plain, F.lit(0)), F.get(tuned, F.lit(0)))


def shown_tags(tags: Column, most: int = 5) -> Column:
    """The first tags that are no paper and no region."""
    return F.slice(F.filter(tags, lambda t: ~F.startswith(t, F.lit("arxiv:")) & ~F.startswith(t, F.lit("region:"))), 1, most)


#: How Python text begins, and names that only it has.
SCRIPT_STARTS, SCRIPT_NAMES = ("import ", "from ", "def ", "class ", "print(", "#"), ("trainer.train", "trainingarguments", "sftconfig", "sfttrainer")


def is_inline_script(script: Column) -> Column:
    """Whether a text is Python itself and not a path or address of one."""
    t = F.regexp_replace(script, r"^\s+|\s+$", "")
    place = F.lower(t).rlike(r"^(https?://|/|\./|\.\./)") | t.rlike(r"(?:^|[\\/])[\w.-]+\.py$")
    holds = F.contains(t, F.lit("\n"))
    for s in SCRIPT_STARTS:
        holds = holds | F.startswith(t, F.lit(s))
    for s in SCRIPT_NAMES:
        holds = holds | F.contains(F.lower(t), F.lit(s))
    return F.coalesce((t != "") & holds & ~place, F.lit(False))


def save_warning(script: Column) -> Column:
    """What a training script that loads a model but never pushes it should be told; null for others."""
    loads, saves = F.contains(script, F.lit("from_pretrained")), F.contains(script, F.lit("push_to_hub"))
    return F.when(loads & ~saves, "the script loads a model and never saves it: call push_to_hub").when(loads & saves, "the model will be pushed")


def push_to_hub(script: Column) -> Column:
    """The first value that ``push_to_hub`` is set to; false if none."""
    return F.coalesce(F.lower(F.regexp_extract(script, r"(?i)push_to_hub\s*=\s*(true|false)", 1)) == "true", F.lit(False))


#: Names of held-out splits, and what parts them from their surroundings.
HOLDOUT = ("eval", "evaluation", "validation", "valid", "test", "holdout")
SEPARATORS = ("/", "\\", "_", "-", ".", " ")


def names_holdout(value: Column) -> Column:
    """Whether a source's name holds a held-out split's as a part, parted by one kind of separator at a time."""
    v = F.replace(F.lower(value), F.lit("\\"), F.lit("/"))
    names = F.array(*(F.lit(n) for n in HOLDOUT))
    out = F.lit(False)
    for s in SEPARATORS:
        out = out | F.arrays_overlap(F.split(v, "\\Q" + s + "\\E"), names)
    return F.coalesce(out, F.lit(False))


#: Words of other subjects than income tax, and the subjects.
OTHER_TOPICS = {
    "chemistry": ("acid", "acids", "base", "bases", "catalyst", "catalysts", "chemistry", "laboratory", "reaction", "reactions"),
    "us_tax": ("irs", "w2", "wage", "wages", "employer", "employers"),
}


def other_topics(domain: Column, known: Column, output: Column) -> Column:
    """Subjects of an output on income tax that neither the question nor its sources speak of, sorted; empty for other domains."""
    from ..functions.text import plain

    words = lambda c: F.regexp_extract_all(plain(F.coalesce(c, F.lit(""))), F.lit("([a-z0-9]+)"), F.lit(1))
    own = words(output)
    new = F.array_except(own, words(known))
    found = [F.when(F.arrays_overlap(new, F.array(*(F.lit(w) for w in names))), F.lit(topic)) for topic, names in OTHER_TOPICS.items()]
    found.append(F.when(F.array_contains(own, "w") & F.array_contains(own, "2"), F.lit("w-2")))
    return F.when(F.lower(domain) == "income_tax", F.array_sort(F.array_compact(F.array(*found)))).otherwise(F.array().cast("array<string>"))


def title(text: Column, limit: int = 40) -> Column:
    """A title from a first message: white space off its ends, over ``limit`` characters cut and marked, New chat for none."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)^\s+|\s+$", "")
    return F.when(t == "", F.lit("New chat")).when(F.length(t) > limit, F.concat(F.rtrim(F.left(t, F.lit(limit))), F.lit("…"))).otherwise(t)


def clean_title(made: Column, limit: int = 50) -> Column:
    """A title that a model made: quotes off its ends, marks of Markdown removed, over ``limit`` characters cut and marked."""
    t = F.btrim(F.btrim(F.btrim(F.coalesce(made, F.lit(""))), F.lit('"')), F.lit("'"))
    t = F.btrim(F.translate(t, "`*_~#[]()", ""))
    return F.when(F.length(t) > limit, F.concat(F.rtrim(F.left(t, F.lit(limit))), F.lit("…"))).otherwise(t)


def message_structure(conversations: DataFrame, messages: str = "messages") -> DataFrame:
    """(roles, with_content, n): the distinct roles in the messages of all rows, sorted, rows with content in every turn, and rows."""
    roles = F.array_distinct(F.transform(messages, lambda m: m["role"]))
    full = F.forall(messages, lambda m: F.coalesce(m["content"], F.lit("")) != "")
    each = conversations.select(roles.alias("roles"), full.alias("full"))
    return each.agg(F.sort_array(F.array_distinct(F.flatten(F.collect_set("roles")))).alias("roles"), F.count_if("full").alias("with_content"), F.count("*").alias("n"))
