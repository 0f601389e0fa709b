"""Queries over the driver's tables with equivalent DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths
from ..functions import text as X
from ..functions.values import timeout_hours
from ..operators import activity, conversations, evals, exchange, lookup, scripts, training
from ..operators import listings as L
from ..operators import profile as P
from ..sources.formats import sections, union_by_name

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def query(sql: str | None = None, *tables: str):
    """Register a function of the named tables under its own name."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, sf: f(*(_table(spark, sf, t) for t in tables))
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_BLANK = r"regexp_matches(coalesce(%s, ''), '^\s*$')"


@query(
    r"SELECT count(*) AS row_count, CAST(5 AS INTEGER) AS column_count, CAST(round((count(*) FILTER (doc_id IS NULL) + count(*) FILTER (" + _BLANK % "text" + ") + count(*) FILTER (" + _BLANK % "lang"
    + ") + count(*) FILTER (" + _BLANK % "source" + ") + count(*) FILTER (n_chars IS NULL)) / (5.0 * count(*)), 6) AS DOUBLE) AS missing_fraction, count(*) - count(DISTINCT (doc_id, text, lang, source, n_chars)) AS duplicate_count FROM documents",
    "documents",
)
def profile_documents(docs: DataFrame) -> DataFrame:
    return P.profile(docs).select("row_count", "column_count", "missing_fraction", "duplicate_count")


@query("UNPIVOT (SELECT count(*) FILTER (c_custkey IS NULL) AS c_custkey, count(*) FILTER (c_name IS NULL OR trim(c_name) = '') AS c_name FROM customer) ON COLUMNS(*) INTO NAME column_name VALUE missing", "customer")
def missing_by_column_customer(customer: DataFrame) -> DataFrame:
    return P.profile(customer.select("c_custkey", "c_name")).select(F.explode("missing_summary").alias("column_name", "missing"))


@query("SELECT count(*) AS row_count, count(*) - count(DISTINCT (text, lang)) AS duplicate_count FROM documents", "documents")
def duplicate_docs(docs: DataFrame) -> DataFrame:
    return P.profile(docs.select("text", "lang")).select("row_count", "duplicate_count")


@query(None, "documents")
def trainability_decision(docs: DataFrame) -> DataFrame:
    return P.decide(docs, "doc_id")


@query(None, "conversations")
def shape_inference(turns: DataFrame) -> DataFrame:
    return P.decide(conversations.assembled(turns), "conv_id").select("shape", "score", "recommendation", "risk", "strategy", "method")


@query(None, "documents")
def redact_documents(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", X.redacted(F.col("text")).alias("text"))


@query(None, "documents")
def redaction_counts_by_kind(docs: DataFrame) -> DataFrame:
    marks = docs.select(F.explode(F.regexp_extract_all(X.redacted(F.col("text")), F.lit(r"\[(REDACTED[A-Z_]*)\]"), F.lit(1))).alias("kind"))
    return marks.groupBy("kind").agg(F.count("*").alias("n"))


_CONV = "conversations"


@query("SELECT conv_id, count(*) AS n_turns, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS dialogue FROM conversations GROUP BY conv_id", _CONV)
def conversation_to_messages(turns: DataFrame) -> DataFrame:
    said = F.transform("messages", lambda m: F.concat(m["role"], F.lit(": "), m["content"]))
    return conversations.assembled(turns).select("conv_id", "n_turns", F.array_join(said, "\n").alias("dialogue"))


@query(
    "WITH u AS (SELECT *, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER w AS question_turn, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER w AS question FROM conversations "
    "WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) SELECT conv_id, question_turn, question, turn AS answer_turn, text AS answer FROM u "
    "WHERE role = 'assistant' AND question_turn IS NOT NULL QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1", _CONV,
)
def last_answered_pair(turns: DataFrame) -> DataFrame:
    return conversations.last_answered(turns)


@query("SELECT conv_id, turn, role, text FROM (SELECT *, max(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id) AS l FROM conversations) WHERE role = 'system' OR turn < l", _CONV)
def undo_last_turn(turns: DataFrame) -> DataFrame:
    return conversations.undone(turns)


@query(
    "SELECT conv_id, turn, role, text FROM (SELECT *, sum(CASE WHEN role = 'user' AND turn > f THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM "
    "(SELECT *, min(turn) OVER (PARTITION BY conv_id) AS f FROM conversations)) WHERE n <= 1", _CONV,
)
def truncate_before_nth_user(turns: DataFrame) -> DataFrame:
    return conversations.before_user(turns, 1)


_RUNS = "WITH m AS (SELECT *, CASE WHEN lag(role) OVER (PARTITION BY conv_id ORDER BY turn) = role THEN 0 ELSE 1 END AS c FROM conversations), r AS (SELECT *, sum(c) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM m) "


@query(_RUNS + "SELECT conv_id, CAST(run AS BIGINT) AS run, role, min(turn) AS first_turn, count(*) AS n FROM r GROUP BY conv_id, run, role", _CONV)
def consecutive_role_runs(turns: DataFrame) -> DataFrame:
    return conversations.runs(turns)


@query(
    _RUNS.replace("= role THEN 0", "= 'assistant' AND role = 'assistant' THEN 0") + "SELECT conv_id, min(turn) AS first_turn, role, string_agg(text, chr(10) ORDER BY turn) AS text FROM r GROUP BY conv_id, run, role", _CONV,
)
def merge_consecutive_assistant(turns: DataFrame) -> DataFrame:
    return conversations.merged_assistant(turns)


@query(None, "documents")
def chunk_documents(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.posexplode(X.chunks(F.col("text"))).alias("chunk_index", "text"))


@query("SELECT 'sft_reference_eval:' || doc_id || ':prompt_completion' AS case_id, lang AS expected FROM documents WHERE trim(text) <> '' AND trim(lang) <> '' ORDER BY doc_id LIMIT 25", "documents")
def golden_cases_prompt_completion(docs: DataFrame) -> DataFrame:
    return evals.prompt_cases(docs.withColumn("row_index", F.col("doc_id")), "text", "lang").select("case_id", "expected")


@query("SELECT count(*) AS cases, count(*) FILTER (quality IS NULL) AS needs_more_data, count(*) FILTER (quality = 1) AS passed, count(*) FILTER (quality = 0) AS failed, CASE WHEN count(*) FILTER (quality = 0) > 0 THEN 'failed' ELSE 'needs_more_data' END AS overall FROM documents LEFT JOIN labels USING (doc_id)", "documents", "labels")
def score_outputs_status_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Every document is a case that expects a word its output holds if it is labelled good; unlabelled ones have no output."""
    cases = docs.select(F.col("doc_id").cast("string").alias("case_id"), F.lit("verdict?").alias("question"), F.lit("accepted").alias("expected"))
    outputs = labels.select(F.col("doc_id").cast("string").alias("case_id"), F.when(F.col("quality") == 1, "accepted").otherwise("rejected").alias("output"))
    return evals.status_counts(evals.score_outputs(cases, outputs)).select("cases", "needs_more_data", "passed", "failed", "overall")


@query("SELECT n_nationkey AS question_id, 'answered' AS status, CAST(n_regionkey AS VARCHAR) AS answer FROM nation", "nation")
def lookup_best_row(nation: DataFrame) -> DataFrame:
    rows = nation.select(F.col("n_nationkey").cast("long").alias("row_index"), "n_name", F.col("n_regionkey").cast("string").alias("region"))
    asked = nation.select(F.col("n_nationkey").alias("question_id"), F.format_string("Which region is listed for %s?", F.col("n_name")).alias("question"))
    return lookup.answers(asked, rows, "n_name", "region").select("question_id", "status", "answer")


@query("SELECT r_regionkey AS question_id, CASE WHEN count(*) > 1 THEN 'ambiguous' ELSE 'answered' END AS status, count(*) AS n FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_regionkey", "region", "nation")
def lookup_ambiguous(region: DataFrame, nation: DataFrame) -> DataFrame:
    rows = nation.join(region, nation["n_regionkey"] == region["r_regionkey"]).select(F.col("n_nationkey").cast("long").alias("row_index"), "r_name", "n_name")
    asked = region.select(F.col("r_regionkey").alias("question_id"), F.format_string("Name the nation of %s", F.col("r_name")).alias("question"))
    return lookup.answers(asked, rows, "r_name", "n_name").select("question_id", "status", F.size("rows").cast("long").alias("n"))


@query(
    "WITH q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM benchmark), r AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM documents) "
    "SELECT question_id, row_id, shared FROM (SELECT item_id AS question_id, doc_id AS row_id, count(*) AS shared FROM q JOIN r USING (w) GROUP BY item_id, doc_id) QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY shared DESC, row_id) = 1", "benchmark", "documents",
)
def token_overlap_top1(benchmark: DataFrame, docs: DataFrame) -> DataFrame:
    return lookup.overlap_top1(benchmark.select(F.col("item_id").alias("question_id"), F.col("text").alias("question")), docs.select(F.col("doc_id").alias("row_id"), "text"))


@query("SELECT source, count(*) AS n FROM documents GROUP BY source ORDER BY n DESC, min(doc_id) LIMIT 5", "documents")
def category_top5(docs: DataFrame) -> DataFrame:
    return L.top_values(docs, "source", "doc_id")


@query("SELECT event_type, count(*) AS n FROM events GROUP BY GROUPING SETS ((), (event_type))", "events")
def kpi_events(events: DataFrame) -> DataFrame:
    return activity.event_kpis(events)


@query("SELECT event_id, user_id, nth <= 20 AS admitted FROM (SELECT *, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS nth FROM events)", "events")
def daily_quota_admission(events: DataFrame) -> DataFrame:
    return activity.daily_quota(events.withColumnRenamed("event_id", "mark_id").withColumn("plan", F.lit("pro"))).select(F.col("mark_id").alias("event_id"), "user_id", "admitted")


@query("SELECT user_id, event_id, count(*) OVER (PARTITION BY user_id ORDER BY event_id) * 0.25 AS spend FROM events".replace("* 0.25", "* CAST(0.25 AS DOUBLE)"), "events")
def running_spend(events: DataFrame) -> DataFrame:
    costs = events.select(F.col("user_id").alias("session_id"), F.col("event_id").alias("seq"), F.lit(0.25).alias("cost"))
    return activity.running_spend(costs, 5.0).select(F.col("session_id").alias("user_id"), F.col("seq").alias("event_id"), "spend")


@query("SELECT user_id FROM events GROUP BY user_id HAVING max(ts) < (SELECT max(ts) FROM events) - INTERVAL 24 HOUR", "events")
def stale_sessions(events: DataFrame) -> DataFrame:
    return activity.stale(events.groupBy("user_id").agg(F.max("ts").alias("seen")), events.agg(F.max("ts")).scalar(), 24).select("user_id")


@query("SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 0.5 WHEN 1 THEN CAST(o_orderkey % 7 + 1 AS DOUBLE) WHEN 2 THEN (o_orderkey % 5 + 1) * 24.0 END::DOUBLE AS hours FROM orders", "orders")
def timeout_hours_parse(orders: DataFrame) -> DataFrame:
    k = F.col("o_orderkey")
    t = F.when(k % 4 == 1, F.concat((k % 7 + 1).cast("string"), F.lit("h"))).when(k % 4 == 2, F.concat((k % 5 + 1).cast("string"), F.lit("d"))).when(k % 4 == 3, F.lit("soon"))
    return orders.select("o_orderkey", timeout_hours(t).alias("hours"))


@query("SELECT c_custkey, n_name, CAST((c_custkey % 9 + 1) * (n_nationkey + 1) AS DOUBLE) AS cost FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey", "customer", "nation")
def job_cost_broadcast_join(customer: DataFrame, nation: DataFrame) -> DataFrame:
    jobs = customer.select("c_custkey", F.col("c_nationkey").alias("flavor"), F.concat((F.col("c_custkey") % 9 + 1).cast("string"), F.lit("h")).alias("timeout"))
    prices = nation.select(F.col("n_nationkey").alias("flavor"), "n_name", (F.col("n_nationkey") + 1).cast("double").alias("usd_per_hour"))
    return activity.job_costs(jobs, prices).select("c_custkey", "n_name", "cost")


@query("SELECT doc_id FROM documents WHERE NOT EXISTS (SELECT 1 FROM labels WHERE labels.doc_id = documents.doc_id)", "documents", "labels")
def dangling_calls_anti_join(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return conversations.dangling(docs.select(F.col("doc_id").alias("tool_call_id")), labels.select(F.col("doc_id").alias("tool_call_id"))).select(F.col("tool_call_id").alias("doc_id"))


@query("SELECT coalesce(s.n_nationkey, v.n_nationkey) AS flavor, CAST(coalesce(v.n_regionkey, s.n_nationkey) AS DOUBLE) AS usd_per_hour FROM (SELECT * FROM nation WHERE n_nationkey < 15) s FULL JOIN (SELECT * FROM nation WHERE n_nationkey >= 10) v USING (n_nationkey)".replace(
    "coalesce(s.n_nationkey, v.n_nationkey) AS flavor", "n_nationkey AS flavor"), "nation")
def price_overlay_full_join(nation: DataFrame) -> DataFrame:
    price = lambda c: nation.select(F.col("n_nationkey").alias("flavor"), F.col(c).cast("double").alias("usd_per_hour"))
    return activity.overlaid_prices(price("n_nationkey").where("flavor < 15"), price("n_regionkey").where("flavor >= 10"))


@query("SELECT r_regionkey AS k, r_name AS name, NULL AS region FROM region UNION ALL SELECT n_nationkey, n_name, CAST(n_regionkey AS VARCHAR) FROM nation", "region", "nation")
def union_by_name_files(region: DataFrame, nation: DataFrame) -> DataFrame:
    return union_by_name([region.select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("name")), nation.select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"), F.col("n_regionkey").cast("string").alias("region"))])


_BM25 = " + ".join(f"ln(1 + (docs - d{i} + 0.5) / (d{i} + 0.5)) * t{i} * 2.2 / (t{i} + 1.2 * (0.25 + 0.75 * n / mean))" for i in range(3))


@query(
    "WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents), t AS (SELECT doc_id, len(w) AS n, len(list_filter(w, lambda x: x = 'clown')) AS t0, len(list_filter(w, lambda x: x = 'idiot')) AS t1, "
    "len(list_filter(w, lambda x: x = 'the')) AS t2 FROM w), s AS (SELECT count(*) AS docs, avg(n) AS mean, count(*) FILTER (t0 > 0) AS d0, count(*) FILTER (t1 > 0) AS d1, count(*) FILTER (t2 > 0) AS d2 FROM t) "
    f"SELECT doc_id, round({_BM25}, 4) AS score FROM t, s WHERE t0 + t1 + t2 > 0 ORDER BY 2 DESC, 1 LIMIT 10", "documents",
)
def bm25_search(docs: DataFrame) -> DataFrame:
    return lookup.bm25(docs, "the idiot clown", 10)


@query("SELECT * FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events) WHERE seq > 3", "events")
def event_replay_after_seq(events: DataFrame) -> DataFrame:
    return activity.events_after(activity.sequenced(events, "user_id"), 3).select("user_id", "event_id", F.col("seq").cast("long").alias("seq"))


@query(None, "pages")
def page_sections(pages: DataFrame) -> DataFrame:
    return sections(pages)


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events", "events")
def json_field_extract(events: DataFrame) -> DataFrame:
    return events.select("event_id", F.get_json_object("props", "$.k").try_cast("long").alias("k"))


@query("SELECT conv_id, bool_or(role = 'user' AND trim(coalesce(text, '')) <> '') AND bool_or(role = 'assistant' AND trim(coalesce(text, '')) <> '') AS has_both FROM conversations GROUP BY conv_id", _CONV)
def has_user_and_assistant(turns: DataFrame) -> DataFrame:
    return conversations.complete(turns)


_MARKS = "[" + ", ".join(f"'{m}'" for m in paths.EXAMPLES) + "]"


@query(
    f"SELECT page_id, CAST(CASE WHEN parts[1] IN ('examples', 'example') THEN 0 ELSE 1 END AS BIGINT) AS outside, CAST(coalesce(list_position({_MARKS}, list_filter(parts, lambda x: list_contains({_MARKS}, x))[-1]) - 1, 999) AS BIGINT) AS pattern, CAST(len(parts) AS BIGINT) AS depth"
    " FROM (SELECT page_id, string_split(lower(url), '/') AS parts FROM pages)",
    "pages",
)
def path_priority(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", F.inline(F.array(paths.path_priority(F.col("url")))))


@query(
    "SELECT p_partkey, array_to_string(list_filter(w, lambda x, i: list_position(w, x) = i), '-') AS words FROM (SELECT p_partkey, regexp_extract_all(lower(p_name), '[a-z0-9]+') AS w FROM part)",
    "part",
)
def upload_slug(part: DataFrame) -> DataFrame:
    return part.select("p_partkey", paths.file_slug(F.array("p_name")).alias("words"))


@query(None, "pages")
def example_path_scores(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", paths.example_score(F.col("url")).alias("score"))


@query(None, "documents")
def dataset_provenance(docs: DataFrame) -> DataFrame:
    return P.provenance(P.decide(docs, "doc_id"), dataset={"type": "table", "format": "parquet"}, method="sft")


@query("SELECT doc_id, CAST(CASE WHEN strpos(text, 'the') > 0 THEN strpos(text, 'the') - 1 END AS INTEGER) AS at FROM documents", "documents")
def text_found_at(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", paths.found_at(F.col("text"), F.lit("the"))["at"].alias("at"))


@query("SELECT doc_id, CASE WHEN doc_id < (SELECT CAST(floor(count(*) * 0.95) AS BIGINT) FROM documents) THEN 'train' ELSE 'test' END AS part FROM documents", "documents")
def head_split(docs: DataFrame) -> DataFrame:
    return L.head_split(docs, "doc_id").select("doc_id", "part")


@query("SELECT doc_id, CASE WHEN CAST('0x' || left(md5('42:' || doc_id), 8) AS BIGINT) % 100 < 10 THEN 'test' ELSE 'train' END AS part FROM documents", "documents")
def seeded_split(docs: DataFrame) -> DataFrame:
    return L.seeded_split(docs, "doc_id").select("doc_id", "part")


@query(
    "SELECT *, CASE WHEN size <= 0 THEN 'empty' WHEN size > 104857600 THEN 'too_large' WHEN total > 104857600 THEN 'total_too_large' ELSE 'ok' END AS verdict FROM (SELECT upload_id, ord, size, "
    "CAST(sum(size) OVER (PARTITION BY upload_id ORDER BY ord) AS BIGINT) AS total FROM (SELECT o_custkey AS upload_id, o_orderkey AS ord, (o_orderkey % 11) * 11000000 AS size FROM orders))", "orders",
)
def checked_uploads(orders: DataFrame) -> DataFrame:
    return L.checked_uploads(orders.select(F.col("o_custkey").alias("upload_id"), F.col("o_orderkey").alias("ord"), (F.col("o_orderkey") % 11 * 11000000).alias("size")))


@query(
    "SELECT p_partkey, CASE WHEN nth = 1 THEN n || '.csv' ELSE n || '-' || nth || '.csv' END AS unique_name FROM (SELECT p_partkey, replace(p_name, ' ', '_') AS n, "
    "row_number() OVER (PARTITION BY p_brand, p_name ORDER BY p_partkey) AS nth FROM part)", "part",
)
def unique_upload_names(part: DataFrame) -> DataFrame:
    files = part.select("p_partkey", "p_brand", F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit(".csv")).alias("name"))
    return L.unique_names(files, "p_brand", "name", "p_partkey").select("p_partkey", "unique_name")


@query(
    "SELECT event_id, first_id FROM events JOIN (SELECT p_type AS method, p_size AS path, min(p_partkey) AS first_id FROM part GROUP BY ALL) ON path = user_id AND method = upper(CASE event_type WHEN 'click' THEN 'economy' ELSE 'standard' END)", "events", "part",
)
def matched_endpoints(events: DataFrame, part: DataFrame) -> DataFrame:
    hits = events.select("event_id", F.col("user_id").alias("path"), F.when(F.col("event_type") == "click", "ECONOMY").otherwise("STANDARD").alias("method"))
    ends = part.select(F.col("p_size").cast("long").alias("path"), F.col("p_type").alias("method"), "p_partkey")
    return L.matched_endpoints(hits, ends, "p_partkey").select("event_id", F.col("endpoint.p_partkey").alias("first_id"))


@query("SELECT doc_id, CASE WHEN EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = documents.doc_id) THEN 'output-available' WHEN doc_id % 10 = 0 THEN 'approval-requested' ELSE 'input-available' END AS state FROM documents", "documents", "labels")
def tool_call_states(docs: DataFrame, labels: DataFrame) -> DataFrame:
    calls = docs.select(F.col("doc_id").alias("tool_call_id"), (F.col("doc_id") % 10 == 0).alias("needs_approval"))
    return L.call_states(calls, labels.select(F.col("doc_id").alias("tool_call_id"))).select(F.col("tool_call_id").alias("doc_id"), "state")


@query(
    "SELECT c_custkey AS session_id, CASE WHEN s_suppkey IS NULL THEN c_name ELSE s_name END AS name, CASE WHEN s_suppkey IS NULL THEN c_nationkey ELSE s_nationkey END AS nation FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey", "customer", "supplier",
)
def live_sessions(customer: DataFrame, supplier: DataFrame) -> DataFrame:
    live = supplier.select(F.col("s_suppkey").alias("session_id"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"))
    return L.live_sessions(customer.select(F.col("c_custkey").alias("session_id"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation")), live, "session_id")


@query("SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)", "documents", "labels")
def present_files(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return L.present(docs.select("doc_id"), labels, "doc_id")


@query("SELECT doc_id, CASE WHEN contains(lower(text), 'of the') THEN 2 ELSE 0 END AS points FROM documents", "documents")
def intent_bonus(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.coalesce(L.intent_bonus(F.col("text"), F.lit("OF_the")), F.lit(0)).alias("points"))


@query(
    "SELECT config, string_agg(split, ',' ORDER BY a) AS splits, min(a) AS first FROM (SELECT coalesce(source, '-') AS config, coalesce(lang, '-') AS split, min(doc_id) AS a FROM documents GROUP BY ALL) GROUP BY config", "documents",
)
def dataset_configs(docs: DataFrame) -> DataFrame:
    own = docs.select(F.coalesce("source", F.lit("-")).alias("config"), F.coalesce("lang", F.lit("-")).alias("split"), "doc_id")
    return L.configs(own, "doc_id").select("config", F.array_join("splits", ",").alias("splits"), "first")


@query("SELECT source AS config, lang AS split, count(*) AS n_files, CAST(sum(CASE WHEN doc_id % 7 = 0 THEN 0 ELSE n_chars END) AS BIGINT) AS bytes FROM documents GROUP BY ALL ORDER BY bytes DESC, config NULLS FIRST, split NULLS FIRST LIMIT 10", "documents")
def file_groups(docs: DataFrame) -> DataFrame:
    return L.file_groups(docs.select(F.col("source").alias("config"), F.col("lang").alias("split"), F.when(F.col("doc_id") % 7 == 0, "unknown").otherwise(F.col("n_chars").cast("string")).alias("size")))


@query(
    "SELECT n_files, bytes, CASE WHEN bytes >= 1073741824 THEN printf('%.1f GB', bytes / 1073741824) WHEN bytes >= 1048576 THEN printf('%.1f MB', bytes / 1048576) WHEN bytes >= 1024 THEN printf('%.1f KB', bytes / 1024) ELSE bytes || ' B' END AS shown "
    "FROM (SELECT count(*) AS n_files, CAST(sum(n_chars) AS BIGINT) AS bytes FROM documents)", "documents",
)
def file_total(docs: DataFrame) -> DataFrame:
    return L.file_total(docs.select(F.col("n_chars").alias("size")))


@query("SELECT count(*) AS n, (SELECT string_agg(lang, ',' ORDER BY lang) FROM (SELECT DISTINCT lang FROM documents)) AS langs FROM documents", "documents")
def distinct_languages(docs: DataFrame) -> DataFrame:
    return L.distinct_values(docs, "lang").select("n", F.array_join("values", ",").alias("langs"))


@query("SELECT provider, ready, bool_and(ready) OVER () AS ok FROM (SELECT user_id AS provider, bool_and(event_type <> 'error') AS ready FROM events GROUP BY user_id)", "events")
def provider_health(events: DataFrame) -> DataFrame:
    return L.provider_health(events.select(F.col("user_id").alias("provider"), (F.col("event_type") != "error").alias("ready")))


@query("SELECT o_orderkey AS session_id, strftime(o_orderdate, '%Y-%m-%d') AS updated_at FROM orders WHERE o_orderstatus <> 'F' AND o_custkey = 7 ORDER BY 2 DESC, 1 LIMIT 20", "orders")
def listed_sessions(orders: DataFrame) -> DataFrame:
    own = orders.select(F.col("o_orderkey").alias("session_id"), F.col("o_custkey").cast("string").alias("user_id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("updated_at"), F.when(F.col("o_orderstatus") == "F", "deleted").otherwise("live").alias("visibility"))
    return L.listed_sessions(own, "7", 20).select("session_id", "updated_at")


@query("SELECT s_name AS name, s_acctbal AS stars FROM supplier ORDER BY s_acctbal DESC, s_name LIMIT 30", "supplier")
def listed_repos(supplier: DataFrame) -> DataFrame:
    return L.listed_repos(supplier.select(F.col("s_name").alias("name"), F.col("s_acctbal").alias("stars"))).select("name", "stars")


@query("SELECT o_orderkey FROM orders WHERE o_orderpriority LIKE '%URGENT%'", "orders")
def filtered_jobs(orders: DataFrame) -> DataFrame:
    return L.jobs(orders.withColumn("stage", F.upper("o_orderpriority")), every=True, status="urgent").select("o_orderkey")


@query("SELECT p_partkey FROM part WHERE p_name LIKE '%ring%' OR p_type LIKE '%PROMO%' OR p_brand = 'Brand#17ring' ORDER BY p_partkey LIMIT 40", "part")
def trending_papers(part: DataFrame) -> DataFrame:
    rows = part.select(F.col("p_partkey").alias("ord"), F.col("p_name").alias("title"), F.when(F.contains("p_type", F.lit("PROMO")), "of a RING").alias("summary"), F.array("p_brand").alias("keywords"))
    return L.trending(rows, "Ring", 40).select(F.col("ord").alias("p_partkey"))


@query("SELECT o_orderkey AS paper_id, o_totalprice AS citations FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1997-12-31' AND o_totalprice >= 100000 AND o_orderstatus IN ('F', 'O') ORDER BY 2 DESC, 1 LIMIT 25", "orders")
def papers_between(orders: DataFrame) -> DataFrame:
    rows = orders.select(F.col("o_orderkey").alias("paper_id"), F.col("o_orderdate").alias("date"), F.col("o_totalprice").alias("citations"), F.col("o_orderstatus").alias("field"))
    return L.papers_between(rows, "1996-01-01", "1997-12-31", 100000, 25, ("F", "O")).select("paper_id", "citations")


@query("SELECT doc_id, CAST(u.n AS INTEGER) AS n, u.line AS line FROM (SELECT doc_id, unnest(list_transform(range(2, least(len(l), 4000) + 1), lambda i: {'n': i, 'line': l[i]})) AS u FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))", "documents")
def line_range(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.inline(L.lines(F.col("text"), 2, 4000)))


@query("SELECT doc_id, CASE WHEN lang IN ('en', 'de') THEN lang ELSE 'other' END AS lang FROM documents", "documents")
def clamped_ids(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", L.clamped(F.upper("lang"), ("en", "de"), "other").alias("lang"))


@query("SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' OR c_mktsegment = 'FURNITURE' AND c_custkey % 2 = 0 THEN 'pro' WHEN c_custkey % 3 = 0 AND NOT (c_mktsegment = 'FURNITURE') THEN 'pro' WHEN c_mktsegment = 'MACHINERY' OR c_custkey % 7 = 0 THEN 'org' ELSE 'free' END AS plan FROM customer", "customer")
def plans(customer: DataFrame) -> DataFrame:
    """Every branch: a plan's text of a paid plan, one of another plan that overrules the mark, the mark alone, an organisation that pays."""
    org = F.array(F.lit("none"), F.when(F.col("c_mktsegment") == "MACHINERY", "My Team").when(F.col("c_custkey") % 7 == 0, "ENTERPRISE hub"))
    kind = F.when(F.col("c_mktsegment") == "BUILDING", "PRO").when(F.col("c_mktsegment") == "FURNITURE", F.when(F.col("c_custkey") % 2 == 0, "team").otherwise("user"))
    return customer.select("c_custkey", L.plan_of(kind, F.col("c_custkey") % 3 == 0, org).alias("plan"))


@query("SELECT o_custkey AS list_id, o_orderkey AS ord, 'bad status' AS problem FROM orders WHERE o_orderstatus = 'P' QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1", "orders")
def first_bad_todo(orders: DataFrame) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "pending").otherwise("parked")
    return L.first_bad_todo(orders.select(F.col("o_custkey").alias("list_id"), F.col("o_orderkey").alias("ord"), F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderpriority").alias("content"), status.alias("status")))


@query(
    "WITH e AS (SELECT *, min(CASE WHEN event_type = 'signup' THEN event_id END) OVER (PARTITION BY user_id) AS m, lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events) "
    "SELECT user_id, event_id, CASE WHEN event_type = 'signup' THEN 'Installed 12 packages in 30ms' WHEN event_type = 'view' THEN 'Installed 3 packages in /tmp' ELSE event_type END AS line FROM e WHERE m IS NULL OR event_id >= m "
    "UNION ALL SELECT user_id, before, '[installs truncated]' FROM e WHERE event_id = m AND before IS NOT NULL", "events",
)
def log_after_install(events: DataFrame) -> DataFrame:
    line = F.when(F.col("event_type") == "signup", "Installed 12 packages in 30ms").when(F.col("event_type") == "view", "Installed 3 packages in /tmp").otherwise(F.col("event_type"))
    return L.after_install(events.select(F.col("user_id").alias("log_id"), F.col("event_id").alias("n"), line.alias("line"))).select(F.col("log_id").alias("user_id"), F.col("n").alias("event_id"), "line")


@query(
    "SELECT direction, paper, count(*) AS n FROM (SELECT 'references' AS direction, l_partkey AS paper FROM lineitem WHERE l_suppkey = 3 UNION ALL SELECT 'citations', l_suppkey FROM lineitem WHERE l_partkey = 3) GROUP BY ALL", "lineitem",
)
def citation_graph(lineitem: DataFrame) -> DataFrame:
    return L.cited(lineitem.select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst")), 3)


@query(
    "(SELECT 'model' AS kind, p_name AS name FROM part ORDER BY 2 LIMIT 10) UNION ALL (SELECT 'dataset', s_name FROM supplier ORDER BY 2 LIMIT 10) UNION ALL (SELECT 'space', n_name FROM nation ORDER BY 2 LIMIT 10)", "part", "supplier", "nation",
)
def all_resources(part: DataFrame, supplier: DataFrame, nation: DataFrame) -> DataFrame:
    return L.resources({"model": (part, "p_name"), "dataset": (supplier, "s_name"), "space": (nation, "n_name")})


@query("SELECT item_id, 'system: help;user: ' || trim(text) || ';assistant: item ' || item_id AS said FROM benchmark", "benchmark")
def training_messages(benchmark: DataFrame) -> DataFrame:
    made = L.to_messages(F.col("text"), F.concat(F.lit(" item "), F.col("item_id").cast("string")), "help")
    return benchmark.select("item_id", F.array_join(F.transform(made, lambda m: F.concat(m["role"], F.lit(": "), m["content"])), ";").alias("said"))


@query("SELECT event_id, event_id % 5 <> 0 AS good, CASE WHEN event_id % 5 <> 0 THEN props ELSE '{}' END AS arguments FROM events", "events")
def good_tool_calls(events: DataFrame) -> DataFrame:
    return L.good_calls(events.select("event_id", F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("{"), "props")).otherwise(F.col("props")).alias("arguments")))


@query("SELECT event_id, event_type AS tool, CAST(event_id AS VARCHAR) AS tool_call_id, CASE WHEN event_id % 2 = 0 THEN props ELSE '{}' END AS arguments FROM events", "events")
def pending_approvals(events: DataFrame) -> DataFrame:
    key = F.col("event_id").cast("string")
    nested = F.to_json(F.struct(key.alias("id"), F.struct(F.col("event_type").alias("name"), F.col("props").alias("arguments")).alias("function")))
    flat = F.to_json(F.struct(key.alias("tool_call_id"), F.col("event_type").alias("tool"), F.lit("not json").alias("arguments")))
    return events.select("event_id", L.pending_calls(F.when(F.col("event_id") % 2 == 0, nested).otherwise(flat)).alias("c")).select("event_id", "c.*")


@query(
    "SELECT event_id, CASE WHEN p >= 60 OR k > 60 THEN 'stop' WHEN p >= 40 AND coalesce(b, 0) < 40 THEN 'warn' ELSE 'go' END AS state FROM (SELECT event_id, max(value) OVER w AS p, row_number() OVER w AS k, "
    "max(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))", "events",
)
def token_budget(events: DataFrame) -> DataFrame:
    return L.budget_state(events.select("event_id", F.col("user_id").alias("session_id"), F.col("event_id").alias("seq"), F.col("value").alias("tokens")), 40, 60).select("event_id", "state")


@query("SELECT 'red widget' AS model, max(p_size) AS context FROM part WHERE p_name = 'red widget' AND p_type = 'ECONOMY'", "part")
def model_context(part: DataFrame) -> DataFrame:
    rows = part.select(F.col("p_name").alias("model"), F.col("p_brand").alias("provider"), F.when(F.col("p_type") == "ECONOMY", "live").otherwise("down").alias("status"), F.col("p_size").alias("context"))
    return L.context_length(rows, "red widget:fast")


@query("SELECT doc_id, source IN ('eval', 'test') OR doc_id % 4 = 1 AS holdout FROM documents", "documents")
def holdout_sources(docs: DataFrame) -> DataFrame:
    k = F.col("doc_id") % 4
    name = F.when(k == 1, "Data\\Test/part").when(k == 2, "attestation").when(k == 3, "testset").otherwise(F.col("source"))
    return docs.select("doc_id", L.names_holdout(name).alias("holdout"))


@query("SELECT string_agg(role, ',' ORDER BY role) AS roles, (SELECT count(*) FROM (SELECT conv_id FROM conversations GROUP BY conv_id HAVING bool_and(coalesce(text, '') <> ''))) AS with_content, (SELECT count(DISTINCT conv_id) FROM conversations) AS n FROM (SELECT DISTINCT role FROM conversations)", _CONV)
def message_structure(turns: DataFrame) -> DataFrame:
    return L.message_structure(conversations.assembled(turns)).select(F.array_join("roles", ",").alias("roles"), "with_content", "n")


@query(
    "SELECT n_nationkey AS question_id, 'answered' AS status, n_name AS answer, 'Purpose' AS answer_column FROM nation", "nation",
)
def table_answers(nation: DataFrame) -> DataFrame:
    rows = nation.select(F.col("n_nationkey").cast("long").alias("row_index"), F.format_string("Form N%d", "n_nationkey").alias("Form No"), F.col("n_name").alias("Purpose"))
    asked = nation.select(F.col("n_nationkey").alias("question_id"), F.format_string("What is form n-%d used for?", "n_nationkey").alias("question"))
    return lookup.table_answers(asked, rows).select("question_id", "status", "answer", "answer_column")


@query(r"SELECT conv_id, turn, regexp_matches(text || CASE WHEN turn % 3 = 0 THEN ' Fine-tune' ELSE 'sft' END, '(?i)\b(?:fine[-\s]?tune|finetune|sft)\b') AS wanted FROM conversations", _CONV)
def finetune_requests(turns: DataFrame) -> DataFrame:
    said = F.concat("text", F.when(F.col("turn") % 3 == 0, " Fine-tune").otherwise("sft"))
    return turns.select("conv_id", "turn", training.wants_finetune(said).alias("wanted"))


@query(
    "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'trackio_sync_failure' END AS error, CASE event_id % 4 WHEN 0 THEN 'n = ' || event_id || chr(10) || 'a(max_seq_length=1)' WHEN 1 THEN 'import trackio' || chr(10) || 'n = ' || event_id || chr(10) || 'a(max_length=1)' END AS script FROM events", "events",
)
def training_repairs(events: DataFrame) -> DataFrame:
    k = F.col("event_id") % 4
    log = F.when(k == 0, "rank_pattern: cannot write struct type (trackio)").when(k == 1, "unknown argument max_seq_length").when(k == 2, "rank_pattern only")
    script = F.concat(F.lit("import trackio\nn = "), F.col("event_id").cast("string"), F.lit("\na(max_seq_length=1)"))
    return events.select("event_id", training.known_error(log).alias("error"), training.repaired_script(script, log).alias("script"))


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'fail' WHEN 1 THEN 'warn' ELSE 'pass' END AS status, CASE WHEN event_id % 3 = 2 THEN 0 ELSE 1 END AS issues FROM events", "events")
def script_checks(events: DataFrame) -> DataFrame:
    severity = F.when(F.col("event_id") % 3 == 0, "Error").when(F.col("event_id") % 3 == 1, "warning").otherwise("note")
    given = F.to_json(F.struct(F.lit("pass").alias("status"), F.array(F.struct(severity.alias("severity"), F.col("event_type").alias("code"))).alias("issues")))
    checked = training.checked_script(given)
    return events.select("event_id", checked["status"].alias("status"), F.size(checked["issues"]).alias("issues"))


@query("SELECT event_type AS model, 'main' AS kind, count(*) AS calls, CAST(sum(user_id) AS BIGINT) AS latency_ms, CAST(sum(user_id) AS DOUBLE) / 4 AS cost_usd FROM events GROUP BY ALL", "events")
def model_call_totals(events: DataFrame) -> DataFrame:
    data = F.to_json(F.struct(F.col("event_type").alias("model"), F.col("user_id").alias("latency_ms"), (F.col("user_id") / 4).alias("cost_usd")))
    return training.model_calls(events.select(F.lit("llm_call").alias("event_type"), data.alias("data"))).drop("total_tokens")


@query("SELECT event_id, CAST(0 AS INTEGER) AS pos, event_id AS seq, props AS body FROM events UNION ALL SELECT event_id, 1, event_id + 5, '{\"seq\":' || (event_id + 5) || '}' FROM events", "events")
def parsed_streams(events: DataFrame) -> DataFrame:
    key = F.col("event_id").cast("string")
    text = F.concat(F.lit(": on\r\nid: "), key, F.lit("\r\ndata: "), "props", F.lit('\r\n\r\ndata: {"seq":'), (F.col("event_id") + 5).cast("string"), F.lit("}"))
    return exchange.stream_events(events.select("event_id", text.alias("text")), "event_id").select("event_id", "pos", "seq", "body")


@query(
    "SELECT conv_id, turn AS pos, CAST(0 AS INTEGER) AS sub, role, text AS content, NULL AS tool_call_id FROM conversations WHERE role IN ('user', 'assistant') AND text <> '' UNION ALL "
    "SELECT conv_id, turn, 1, 'tool', 'done', 'c' || turn FROM conversations WHERE role = 'assistant' AND turn % 2 = 1", _CONV,
)
def exploded_chat(turns: DataFrame) -> DataFrame:
    null = F.lit(None).cast("string")
    part = lambda kind, text, call, output: F.struct(F.lit(kind).alias("type"), text.alias("text"), call.alias("toolCallId"), null.alias("toolName"), null.alias("input"), output.alias("output"), null.alias("errorText"))
    parts = F.array(part("text", F.col("text"), null, null), part("tool-read", null, F.concat(F.lit("c"), F.col("turn").cast("string")), F.when(F.col("turn") % 2 == 1, "done")))
    return exchange.turns_of(turns.select("conv_id", F.col("turn").alias("pos"), "role", parts.alias("parts")), "conv_id").drop("tool_calls")


@query(
    "SELECT r_regionkey, min(n_nationkey) FILTER (CAST(n_nationkey AS VARCHAR) LIKE '%' || r_regionkey || '%') AS found FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_regionkey", "region", "nation",
)
def found_sections(region: DataFrame, nation: DataFrame) -> DataFrame:
    """Of each region's nations the first whose name's number holds the region's."""
    own = nation.groupBy("n_regionkey").agg(F.sort_array(F.collect_list(F.struct(F.col("n_nationkey").alias("at"), F.lit("-").alias("id"), F.concat(F.lit("Nation "), F.col("n_nationkey").cast("string")).alias("title")))).alias("s"))
    asked = region.join(own, F.col("r_regionkey") == F.col("n_regionkey"))
    return asked.select("r_regionkey", exchange.found_section(F.col("s"), F.col("r_regionkey").cast("string"))["at"].alias("found"))


@query(
    "WITH j AS (SELECT n_nationkey AS ord, n_name AS id, 'image ' || repeat('x', CAST(n_nationkey AS INTEGER)) AS image FROM nation), w AS (SELECT greatest(max(length(id)), 6) AS w FROM j) "
    "SELECT ord, '| ' || rpad(id, CAST(w AS INTEGER), ' ') || ' | ' || rpad(CASE WHEN length(image) > 20 THEN left(image, 17) || '...' ELSE image END, 20, ' ') || ' | ' || rpad('python train.py', 30, ' ') || ' | ' || rpad('N/A', 19, ' ') || ' | ' || rpad('RUNNING', 12, ' ') || ' |' AS line FROM j, w", "nation",
)
def job_table(nation: DataFrame) -> DataFrame:
    rows = nation.select("n_nationkey", F.col("n_name").alias("id"), F.concat(F.lit("image "), F.repeat(F.lit("x"), F.col("n_nationkey").cast("int"))).alias("image"), F.lit("python train.py").alias("command"), F.lit("N/A").alias("created"), F.lit("RUNNING").alias("status"))
    return exchange.job_lines(rows, "n_nationkey").where("head = 1").select("ord", "line")


def _field_score(query: tuple[str, ...], fields: dict[str, float]) -> str:
    """DuckDB SQL of the weighted BM25 sum over columns t{i}_{j}, n{i} and statistics d{i}_{j}, mean{i}, docs."""
    part = "CASE WHEN t{i}_{j} > 0 THEN {w} * ln(1 + (docs - d{i}_{j} + 0.5) / (d{i}_{j} + 0.5)) * t{i}_{j} * 2.2 / (t{i}_{j} + 1.2 * (0.25 + 0.75 * n{i} / mean{i})) ELSE 0 END"
    met = [(i, j) for i in range(len(fields)) for j in range(len(query))]
    words = ", ".join(f"list_transform(regexp_extract_all(lower({f}), '[a-z0-9]+'), lambda x: regexp_replace(x, '^(.{{3,}}[^su])s$', '\\1')) AS w{i}" for i, f in enumerate(fields))
    counts = ", ".join([f"len(w{i}) AS n{i}" for i in range(len(fields))] + [f"len(list_filter(w{i}, lambda x: x = '{query[j]}')) AS t{i}_{j}" for i, j in met])
    stats = ", ".join([f"avg(n{i}) AS mean{i}" for i in range(len(fields))] + [f"count(*) FILTER (t{i}_{j} > 0) AS d{i}_{j}" for i, j in met])
    total = " + ".join(part.format(i=i, j=j, w=list(fields.values())[i]) for i, j in met)
    return (
        f"WITH s AS (SELECT *, {words} FROM part), t AS (SELECT p_partkey, p_brand, {counts} FROM s), a AS (SELECT count(*) AS docs, {stats} FROM t) SELECT p_partkey, round({total}, 2) AS score FROM t, a "
        f"WHERE ({' OR '.join(f't{i}_{j} > 0' for i, j in met)}) AND contains(p_brand, '#1') ORDER BY 2 DESC, 1 LIMIT 20"
    )


_PART_FIELDS = {"p_name": 3.0, "p_type": 1.5}


@query(_field_score(("promo", "small"), _PART_FIELDS), "part")
def endpoint_search(part: DataFrame) -> DataFrame:
    return lookup.field_search(part, _PART_FIELDS, "Promos, small!", 20, lookup.tagged("#1", "p_brand"), ("p_partkey",)).select("p_partkey", "score")


@query(
    "WITH m AS (SELECT * FROM conversations WHERE trim(text) <> ''), u AS (SELECT *, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS q FROM m), "
    "p AS (SELECT conv_id, trim(q) AS q, trim(text) AS a FROM u WHERE role = 'assistant' AND q IS NOT NULL QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1) SELECT 'sft_reference_eval:' || conv_id || ':messages' AS case_id, "
    "CASE WHEN length(q) > 240 THEN rtrim(left(q, 240)) || '...' ELSE q END AS question, CASE WHEN length(a) > 240 THEN rtrim(left(a, 240)) || '...' ELSE a END AS expected FROM p ORDER BY conv_id LIMIT 25", _CONV,
)
def golden_cases_messages(turns: DataFrame) -> DataFrame:
    return evals.golden_cases(conversations.assembled(turns).withColumn("row_index", F.col("conv_id")))


@query(
    "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'pass' WHEN event_id % 4 = 3 THEN 'pass' ELSE 'fail' END AS status, event_id % 4 <> 3 AND event_id % 4 <> 2 AS trains, "
    "CASE event_id % 4 WHEN 1 THEN 'missing_push_to_hub' WHEN 2 THEN 'python_syntax_error' ELSE '' END AS codes FROM events", "events",
)
def checked_scripts(events: DataFrame) -> DataFrame:
    k = F.col("event_id") % 4
    named = F.concat(F.lit("hub_model_id='o/m"), F.col("event_id").cast("string"), F.lit("')\n"))
    script = F.when(k == 0, F.concat(F.lit("import trackio\nSFTConfig(push_to_hub=True, "), named)).when(k == 1, F.concat(F.lit("import trackio\nSFTConfig("), named)).when(k == 2, "x = (").otherwise("print(1)")
    found = scripts.script_check(script, F.lit("8h"), F.array(F.lit("trackio")))
    return events.select("event_id", found.alias("c")).select("event_id", "c.status", F.col("c.is_training_script").alias("trains"), F.array_join(F.transform("c.issues", lambda i: i["code"]), ",").alias("codes"))
