"""Further queries of the catalogue: files, streams' batch forms, telemetry, index, scrub, structure, uploads, compaction and strategies."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scrub import scrubbed_json
from ..operators import activity, conversations, decisions, evals, structure, telemetry, text_index
from ..sources import formats, pdf, sinks
from ..streaming import replay
from .catalogue import query

WORDS = r"[^\x20\x09-\x0D]+"


@query(
    r"SELECT doc_id, CAST(1 AS BIGINT) AS page_number, CAST(len(w) AS BIGINT) AS n_words, md5(array_to_string(w, ' ')) AS words_md5 FROM (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM documents) WHERE len(w) > 0 "
    "UNION ALL SELECT doc_id, 2, 2, md5(lang || ' ' || source) FROM documents", "documents",
)
def pdf_pages(docs: DataFrame) -> DataFrame:
    """A two-page file of every document, and the words that its pages give back."""

    @F.pandas_udf("binary")
    def made(first, second):
        return first.combine(second, lambda a, b: pdf.simple_pdf([a, b]))

    files = docs.select("doc_id", made(F.coalesce("text", F.lit("")), F.concat_ws("\n", "lang", "source")).alias("content"))
    words = F.regexp_extract_all("text", F.lit(WORDS), F.lit(0))
    read = pdf.pages(files, "doc_id").select("doc_id", "page_number", words.alias("w")).where("size(w) > 0")
    return read.select("doc_id", "page_number", F.size("w").cast("long").alias("n_words"), F.md5(F.array_join("w", " ").cast("binary")).alias("words_md5"))


@query(
    """WITH s AS (SELECT user_id AS session_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, event_type, props FROM events),
    k AS (SELECT * FROM s WHERE seq > session_id % 5),
    o AS (SELECT *, max(CASE WHEN event_type = 'purchase' THEN 1 END) OVER (PARTITION BY session_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS over FROM k)
    SELECT session_id, CAST(seq AS BIGINT) AS seq, 'id: ' || seq || chr(10) || 'data: {"event_type": "' || event_type || '", "data": ' || props || ', "seq": ' || seq || '}' || chr(10) || chr(10) AS frame FROM o WHERE over IS NULL""", "events",
)
def replayed_events(events: DataFrame) -> DataFrame:
    """Each user's events, the first twenty stored, those from the fifteenth on live, for subscribers that have seen none to four."""
    seq = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")).cast("long")
    every = events.select(F.col("user_id").alias("session_id"), seq.alias("seq"), "event_type", F.col("props").alias("data"))
    cursors = events.select(F.col("user_id").alias("session_id"), (F.col("user_id") % 5).alias("after")).distinct()
    return replay.replayed(every.where("seq <= 20"), every.where("seq >= 15"), cursors, ("purchase",)).select("session_id", "seq", "frame")


@query(
    """WITH w AS (SELECT conv_id * 1000 + turn AS message_id, text, string_split(text, ' ') AS w FROM conversations)
    SELECT message_id, nullif(text, '') AS content, array_to_string(list_filter(w, lambda x, i: i % 2 = 1), '') AS even, CASE WHEN len(w) > 1 THEN array_to_string(list_filter(w, lambda x, i: i % 2 = 0), '') END AS odd,
    'c0' AS id, 'stop' AS finish_reason, CAST(len(w) AS BIGINT) AS total_tokens, true AS complete FROM w""", "conversations",
)
def assembled_messages(turns: DataFrame) -> DataFrame:
    """Every turn streamed word by word, each word also a fragment of the arguments of one of two calls, and put together again."""
    words = turns.select((F.col("conv_id") * 1000 + F.col("turn")).alias("message_id"), F.split("text", " ", -1).alias("w"))
    each = words.select("message_id", F.size("w").alias("n"), F.posexplode("w").alias("i", "word"))
    last = F.col("i") == F.col("n") - 1
    head = lambda v: F.when(F.col("i") < 2, v)
    call = F.struct((F.col("i") % 2).alias("index"), head(F.concat(F.lit("c"), F.col("i").cast("string"))).alias("id"), head(F.lit("f")).alias("name"), F.col("word").alias("arguments"))
    pieces = each.select(
        "message_id", (F.col("i") + 1).cast("long").alias("seq"), F.when(last, F.col("word")).otherwise(F.concat("word", F.lit(" "))).alias("content"), F.array(call).alias("tool_calls"),
        F.when(last, F.lit("stop")).alias("finish_reason"), F.when(last, F.col("n").cast("long")).alias("total_tokens"), last.alias("last"),
    )
    c = F.col("tool_calls")
    return replay.assembled(pieces).select("message_id", "content", c[0]["arguments"].alias("even"), F.get(c, F.lit(1))["arguments"].alias("odd"), c[0]["id"].alias("id"), "finish_reason", "total_tokens", "complete")


_KINDS = tuple(telemetry.RECORDS)


@query(
    """WITH k AS (SELECT event_id, user_id, event_type AS said, value, CAST(event_id % 8 AS INTEGER) AS k FROM events)
    SELECT event_id, CASE k WHEN 0 THEN 'llm_call' WHEN 1 THEN 'hf_job_submit' WHEN 2 THEN 'hf_job_complete' WHEN 3 THEN 'feedback' WHEN 4 THEN 'dataset_upload' WHEN 5 THEN 'model_chat' WHEN 6 THEN 'provider_error' ELSE 'ping' END AS kind,
    CASE WHEN k = 7 THEN 'unknown type' WHEN event_id % 11 = 0 THEN 'not an object' WHEN event_id % 13 = 0 THEN CASE k WHEN 0 THEN 'missing model' WHEN 1 THEN 'missing job_type' WHEN 2 THEN 'missing final_status' WHEN 3 THEN 'missing rating'
         WHEN 4 THEN 'missing repo_id' WHEN 5 THEN 'missing model_id' ELSE 'missing provider' END
         WHEN event_id % 17 = 0 AND k IN (0, 2, 3, 4, 5) THEN CASE k WHEN 0 THEN 'bad latency_ms' WHEN 2 THEN 'bad wall_time_s' WHEN 3 THEN 'bad turn_index' WHEN 4 THEN 'bad size_bytes' ELSE 'bad message_count' END END AS problem,
    CASE WHEN k = 7 OR event_id % 11 = 0 OR event_id % 13 = 0 OR (event_id % 17 = 0 AND k IN (0, 2, 3, 4, 5)) OR k IN (1, 6) THEN NULL ELSE user_id END AS number,
    CASE WHEN k IN (3, 6) AND event_id % 11 <> 0 AND event_id % 13 <> 0 AND (k = 6 OR event_id % 17 <> 0) THEN left(repeat(said || ' [REDACTED_EMAIL] ', 40), 500) WHEN k = 1 AND event_id % 11 <> 0 AND event_id % 13 <> 0 THEN 'cpu-basic 30m' END AS text
    FROM k""", "events",
)
def telemetry_records(events: DataFrame) -> DataFrame:
    """Payloads of all seven types made of the events, some broken, routed to typed records."""
    k, i = F.col("event_id") % 8, F.col("event_id")
    kinds = F.array(*(F.lit(x) for x in (*_KINDS, "ping")))
    needed = {"llm_call": "model", "hf_job_submit": "job_type", "hf_job_complete": "final_status", "feedback": "rating", "dataset_upload": "repo_id", "model_chat": "model_id", "provider_error": "provider"}
    rest = {"llm_call": "latency_ms", "hf_job_complete": "wall_time_s", "feedback": "turn_index", "dataset_upload": "size_bytes", "model_chat": "message_count"}
    number = F.when(i % 17 == 0, F.lit('"many"')).otherwise(F.col("user_id").cast("string"))
    said = F.repeat(F.concat("event_type", F.lit(" a.b@example.org ")), F.lit(40))
    body = F.lit(None).cast("string")
    for n, name in enumerate(_KINDS):
        fields = [F.when(i % 13 != 0, F.lit(f'"{needed[name]}": "x"'))]
        if name in rest:
            fields.append(F.concat(F.lit(f'"{rest[name]}": '), number))
        if name in ("feedback", "provider_error"):
            fields.append(F.concat(F.lit('"comment": "' if name == "feedback" else '"operation": "y", "error": "'), said, F.lit('"')))
        if name == "dataset_upload":
            fields.append(F.lit('"filename": "f"'))
        body = F.when(k == n, F.concat(F.lit("{"), F.concat_ws(", ", *fields), F.lit("}"))).otherwise(body)
    made = events.select("event_id", F.element_at(kinds, (k + 1).cast("int")).alias("event_type"), F.when(i % 11 == 0, F.lit("[not json")).otherwise(F.coalesce(body, F.lit("{}"))).alias("data"))
    r = telemetry.routed(made)
    return r.select(
        "event_id", F.col("event_type").alias("kind"), "problem", F.coalesce("llm_call.latency_ms", "hf_job_complete.wall_time_s", "feedback.turn_index", "dataset_upload.size_bytes", "model_chat.message_count").alias("number"),
        F.coalesce("feedback.comment", "provider_error.error", F.when(F.col("hf_job_submit").isNotNull(), F.concat_ws(" ", "hf_job_submit.flavor", "hf_job_submit.timeout"))).alias("text"),
    )


@query(None, "documents", "benchmark")
def index_search(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The first five documents of every benchmark item by a stored index of texts and sources, all items in one search."""
    path = sinks.scratch(docs.sparkSession, "index")
    text_index.build(docs.select("doc_id", F.col("source").alias("title"), F.col("text").alias("content")), path)
    return text_index.search(docs.sparkSession, path, benchmark.select(F.col("item_id").alias("query_id"), F.col("text").alias("query")), 5)


@query(
    """SELECT c_custkey, '{"user": {"email": "[REDACTED_EMAIL]", "password": "[REDACTED_SECRET]", "names": ["' || c_name || '", "[REDACTED_EMAIL]"]}, "prompt_tokens": ' || c_custkey || ', "token": "[REDACTED_SECRET]", "share": 0.1, "none": null}' AS payload FROM customer""", "customer",
)
def scrubbed_payloads(customer: DataFrame) -> DataFrame:
    """Nested payloads with addresses, secrets and counters, as JSON text of no declared shape."""
    key = F.col("c_custkey").cast("string")
    mail = F.concat(F.lit("c"), key, F.lit("@example.org"))
    body = F.concat(F.lit('{"user": {"email": "'), mail, F.lit('", "password": {"is": "'), key, F.lit('"}, "names": ["'), F.col("c_name"), F.lit('", "'), mail, F.lit('"]}, "prompt_tokens": '), key, F.lit(', "token": "t'), key, F.lit('", "share": 0.10, "none": null}'))
    return customer.select("c_custkey", scrubbed_json(body).alias("payload"))


@query(
    """SELECT (SELECT list_sort(list(DISTINCT role)) FROM conversations WHERE role <> '') AS roles, ['role', 'content', 'tool_calls', 'tool_call_id'] AS keys, true AS has_tool_calls, true AS has_tool_results, (SELECT count(*) FROM conversations) AS n,
    (SELECT CASE WHEN length(text) > 100 THEN left(text, 100) || '...' ELSE text END FROM conversations WHERE turn % 5 = 3 ORDER BY conv_id, turn LIMIT 1) AS example""", "conversations",
)
def message_columns(turns: DataFrame) -> DataFrame:
    """The structure of a column of messages: each conversation's turns, every fifth with a call, every seventh a result."""
    calls = F.when(F.col("turn") % 5 == 3, F.array(F.struct(F.lit("c").alias("id"))))
    message = F.struct("role", F.col("text").alias("content"), calls.alias("tool_calls"), F.when(F.col("turn") % 7 == 2, F.lit("c")).alias("tool_call_id"))
    lists = turns.groupBy("conv_id").agg(F.to_json(F.transform(F.sort_array(F.collect_list(F.struct("turn", message.alias("m")))), lambda x: x["m"])).alias("messages"))
    s = structure.message_structure(lists, "conv_id")
    return s.select("roles", "keys", "has_tool_calls", "has_tool_results", "n", F.get_json_object("example", "$.content").alias("example"))


_CLEAN = r"regexp_replace(trim(regexp_replace(line, '[^A-Za-z]+', ' ', 'g')), ' +', ' ', 'g')"


@query(
    f"""WITH l AS (SELECT doc_id AS page_id, {_CLEAN} AS text, CAST(i - 1 AS INTEGER) AS i FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)),
    s AS (SELECT page_id, i AS pos, i // 3 + 1 AS a, i % 3 AS b, text FROM l),
    t AS (SELECT page_id, a, string_agg(text, chr(10) || chr(10) ORDER BY pos) FILTER (text <> '') AS whole FROM s GROUP BY page_id, a)
    SELECT s.page_id, s.pos, CASE WHEN b = 0 THEN CAST(s.a AS VARCHAR) WHEN b = 1 THEN s.a || '.1' ELSE '~' || s.a || '.2' END AS id, CASE WHEN b > 0 THEN s.pos - b END AS parent, md5(CASE WHEN b = 0 THEN coalesce(t.whole, '') ELSE s.text END) AS whole_md5 FROM s JOIN t ON t.page_id = s.page_id AND t.a = s.a""", "documents",
)
def section_trees(docs: DataFrame) -> DataFrame:
    """Documents as pages, every third line a numbered heading, the next one numbered below it, the third without a number: ids, parents and whole texts."""
    line = lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, "[^A-Za-z]+", " "), " +", " "))
    part = lambda x, i: F.concat(
        F.when(i % 3 == 0, F.concat(F.lit("<h2>"), (i / 3).cast("int") + 1, F.lit(" Part</h2>"))).when(i % 3 == 1, F.concat(F.lit("<h3>"), (i / 3).cast("int") + 1, F.lit(".1 Point</h3>"))).otherwise("<h3>Rest</h3>"), F.lit("<p>"), line(x), F.lit("</p>"),
    )
    pages = docs.select(F.col("doc_id").alias("page_id"), F.array_join(F.transform(F.split("text", "\n", -1), part), "").alias("html"))
    return structure.section_tree(formats.sections(pages)).select("page_id", "pos", "id", "parent", F.md5(F.col("whole").cast("binary")).alias("whole_md5"))


@query(
    """WITH s AS (SELECT user_id, count(*) AS n, max(ts) AS at FROM events GROUP BY user_id), a AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS attempt, event_type, ts FROM events),
    l AS (SELECT user_id, max(attempt) AS attempt, max(ts) AS at, max(CASE WHEN event_type = 'purchase' THEN 1 END) AS ok FROM a WHERE attempt < user_id % 5 GROUP BY user_id)
    SELECT s.user_id AS session_id, CAST(coalesce(l.attempt + 1, 0) AS INTEGER) AS attempt FROM s LEFT JOIN l ON l.user_id = s.user_id WHERE s.user_id % 3 <> 0 AND l.ok IS NULL AND (l.attempt IS NULL OR (l.attempt + 1 < 3 AND l.at + to_seconds(CAST(power(2, l.attempt) AS INTEGER)) <= TIMESTAMP '2024-02-01'))""", "events",
)
def uploads_due(events: DataFrame) -> DataFrame:
    """Users as sessions, their first events as attempts, a purchase as a success; two of three are not uploaded yet."""
    sessions = events.groupBy(F.col("user_id").alias("session_id")).agg(F.count("*").alias("n")).withColumn("upload_status", F.when(F.col("session_id") % 3 == 0, "success").when(F.col("session_id") % 3 == 1, "failed"))
    nth = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    tried = events.select(F.col("user_id").alias("session_id"), nth.alias("attempt"), F.when(F.col("event_type") == "purchase", "success").otherwise("failed").alias("status"), F.col("ts").alias("at")).where("attempt < session_id % 5")
    return sinks.due_uploads(sessions, tried, F.lit("2024-02-01").cast("timestamp")).select("session_id", "attempt")


@query(
    """WITH t AS (SELECT conv_id, turn, role, length(text) AS tokens, sum(length(text)) OVER (PARTITION BY conv_id) AS usage, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) AS to_end,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations),
    m AS (SELECT *, min(CASE WHEN role = 'user' AND i >= 1 THEN i END) OVER (PARTITION BY conv_id) AS task, max(CASE WHEN role = 'user' AND i > 1 AND i <= n - 2 THEN i END) OVER (PARTITION BY conv_id) AS last FROM t),
    k AS (SELECT *, coalesce(task, 1) AS first, coalesce(last, least(1, n - 2)) AS tail FROM m)
    SELECT conv_id, turn, CAST(usage AS BIGINT) AS usage, CAST(to_end AS BIGINT) AS to_end, CASE WHEN usage <= 900 OR tail <= first + 1 THEN 'kept' WHEN i >= tail THEN 'tail' WHEN i = task THEN 'task' WHEN i > first THEN 'summarised' WHEN i = 0 AND role = 'system' THEN 'system' ELSE 'dropped' END AS part FROM k""", "conversations",
)
def compacted_conversations(turns: DataFrame) -> DataFrame:
    return structure.compaction(turns.select("conv_id", "turn", "role", F.length("text").alias("tokens")), 1000, untouched=2).select("conv_id", "turn", "usage", "to_end", "part")


_SAMPLES = {"en": [{"prompt": "q", "completion": "a"}], "de": [{"text": "t", "source_format": "pdf"}], "fr": [{"Form No": "1", "Purpose": "p", "Section": "s"}], "es": [{"prompt": "q"}]}
_FORMATS = {"en": "jsonl", "de": "pdf", "fr": "csv", "es": "jsonl"}


@query(
    """WITH g AS (SELECT lang, lang AS dataset, text, nullif(n_chars % 7, 0) AS m FROM documents UNION ALL SELECT lang, lang || '/' || source, text, nullif(n_chars % 7, 0) FROM documents UNION ALL SELECT lang, lang || '/' || source || '/' || doc_id % 3, text, nullif(n_chars % 3, 0) FROM documents),
    p AS (SELECT lang, dataset, count(*) AS n, round((count(*) FILTER (m IS NULL) + count(*) FILTER (coalesce(trim(lang), '') = '') + count(*) FILTER (regexp_matches(coalesce(text, ''), '^\\s*$'))) / (3.0 * count(*)), 6) AS missing, round((count(*) - count(DISTINCT (text, m))) / (1.0 * count(*)), 6) AS twice FROM g GROUP BY lang, dataset),
    c AS (SELECT *, greatest(0, 100 - CASE WHEN n = 0 THEN 70 WHEN n < 50 THEN 40 WHEN n < 200 THEN 25 WHEN n < 1000 THEN 10 ELSE 0 END - CASE lang WHEN 'en' THEN 0 WHEN 'de' THEN 70 WHEN 'fr' THEN 65 ELSE 25 END
      - CASE WHEN missing >= 0.3 THEN 20 WHEN missing >= 0.1 THEN 10 ELSE 0 END - CASE WHEN twice >= 0.25 THEN 15 WHEN twice >= 0.1 THEN 8 ELSE 0 END) AS score FROM p),
    a AS (SELECT *, CASE WHEN missing >= 0.4 THEN 'data_needed' WHEN lang = 'de' THEN 'rag' WHEN lang = 'fr' THEN CASE WHEN n < 200 THEN 'rag' ELSE 'hybrid' END WHEN score < 35 THEN 'data_needed' WHEN lang = 'en' THEN CASE WHEN score >= 55 THEN 'fine_tune' ELSE 'data_needed' END WHEN score >= 50 THEN 'hybrid' ELSE 'data_needed' END AS advice FROM c),
    r AS (SELECT *, CASE WHEN advice = 'data_needed' OR score < 50 THEN 'high' WHEN score < 80 OR advice IN ('rag', 'hybrid') THEN 'medium' ELSE 'low' END AS risk FROM a),
    k AS (SELECT *, CASE WHEN missing >= 0.4 THEN 'weak' WHEN lang = 'de' THEN 'corpus' WHEN lang = 'fr' THEN 'reference' WHEN advice = 'data_needed' OR (risk = 'high' AND advice <> 'fine_tune') THEN 'blocked' WHEN lang = 'es' THEN 'grpo' ELSE 'train' END AS k FROM r),
    q AS (SELECT *, CASE WHEN k IN ('weak', 'blocked') THEN 'high' WHEN k = 'corpus' THEN 'medium' WHEN k = 'train' THEN CASE WHEN n < 50 THEN 'high' ELSE risk END ELSE CASE WHEN risk = 'high' THEN 'high' ELSE 'medium' END END AS own FROM k)
    SELECT dataset, CAST(n AS BIGINT) AS row_count, CAST(score AS INTEGER) AS score, advice AS recommendation, risk, CASE WHEN k IN ('weak', 'blocked') THEN 'data_needed' WHEN k = 'corpus' THEN 'rag' WHEN k = 'reference' THEN CASE WHEN n < 200 THEN 'rag' ELSE 'hybrid' END ELSE 'fine_tune' END AS strategy,
    CASE k WHEN 'grpo' THEN 'grpo' WHEN 'train' THEN 'sft' END AS method, CAST(CASE k WHEN 'weak' THEN 0.9 WHEN 'blocked' THEN 0.84 WHEN 'corpus' THEN 0.88 WHEN 'reference' THEN CASE WHEN n < 200 THEN 0.86 ELSE 0.78 END WHEN 'grpo' THEN greatest(0.65, least(0.82, score / 100.0))
      ELSE CASE WHEN own = 'high' THEN 0.42 WHEN n >= 1000 THEN greatest(0.86, least(0.96, score / 100.0)) ELSE greatest(0.65, least(0.84, score / 100.0)) END END AS DOUBLE) AS confidence, own AS own_risk, NOT (k = 'train' AND own <> 'high') AS requires_override FROM q""", "documents",
)
def strategy_per_source(docs: DataFrame) -> DataFrame:
    """One decision for each language, source of a language and third of such a source, all in one plan."""
    row = lambda name, by: docs.select(name.alias("dataset"), "lang", "text", F.nullif(F.col("n_chars") % by, F.lit(0).cast("long")).alias("m"))
    own = F.concat_ws("/", "lang", "source")
    every = row(F.col("lang"), 7).union(row(own, 7)).union(row(F.concat_ws("/", own, (F.col("doc_id") % 3).cast("string")), 3))
    lang = F.substring_index("dataset", "/", 1)
    of = lambda table: F.create_map(*(x for k, v in table.items() for x in (F.lit(k), F.lit(v) if isinstance(v, str) else F.array(*(F.lit(y) for y in v)))))[lang]
    given = decisions.profiles(every, "dataset").drop("columns").withColumns({"columns": of({k: list(v[0]) for k, v in _SAMPLES.items()}), "format": of(_FORMATS), "sample_rows": of({k: json.dumps(v) for k, v in _SAMPLES.items()})})
    done = decisions.strategies(decisions.assessed(decisions.inferred(given)))
    t, s = F.col("trainability"), F.col("strategy")
    return done.select("dataset", "row_count", t["score"].alias("score"), t["recommendation"].alias("recommendation"), t["risk_level"].alias("risk"), s["strategy"].alias("strategy"), s["method"].alias("method"), s["confidence"].alias("confidence"), s["risk_level"].alias("own_risk"), s["requires_override"].alias("requires_override"))


@query(
    """WITH p AS (SELECT p_partkey, trim(p_name) AS name, p_partkey % 5 AS k FROM part WHERE trim(p_name) <> '' ORDER BY p_partkey LIMIT 100000)
    SELECT 'structured_reference_qa:' || p_partkey || ':lookup' AS case_id, CASE k WHEN 0 THEN 'passed' WHEN 1 THEN 'needs_more_data' WHEN 2 THEN 'needs_rag' ELSE 'failed' END AS status, CAST(CASE WHEN k IN (0, 4) THEN 1.0 ELSE 0.0 END AS DOUBLE) AS score,
    CASE WHEN k = 2 OR k = 3 THEN name END AS missing, CASE WHEN k IN (3, 4) THEN 'automatic guarante refund tax' END AS claim FROM p""", "part",
)
def eval_statuses(part: DataFrame) -> DataFrame:
    """Cases of a reference table and outputs that meet every status: right, none, asking, wrong, right with a claim of its own."""
    rows = part.select(F.col("p_partkey").alias("row_index"), F.concat(F.lit("S"), F.col("p_partkey").cast("string")).alias("Section"), F.col("p_name").alias("Description"))
    cases = evals.reference_cases(rows, 100_000)
    k, claim = F.col("p_partkey") % 5, F.lit("It guarantees automatic tax refunds.")
    said = F.when(k == 0, F.col("p_name")).when(k == 2, F.lit("I do not know.")).when(k == 3, claim).when(k == 4, F.concat("p_name", F.lit(". "), claim))
    outputs = part.select(F.concat(F.lit("structured_reference_qa:"), F.col("p_partkey").cast("string"), F.lit(":lookup")).alias("case_id"), said.alias("output"))
    return evals.score_outputs(cases, outputs).select("case_id", "status", "score", F.get("missing_facts", F.lit(0)).alias("missing"), F.get("claims", F.lit(0)).alias("claim"))


@query(
    """WITH c AS (SELECT conv_id, turn, turn % 2 AS place, CASE WHEN conv_id % 3 = 0 THEN 'same' WHEN conv_id % 3 = 1 THEN 'ab'[1 + turn % 2:1 + turn % 2] ELSE 'f' || turn END AS name FROM conversations),
    n AS (SELECT conv_id, count(*) AS n FROM c GROUP BY conv_id)
    SELECT conv_id, CASE WHEN conv_id % 3 = 0 THEN 'identical' ELSE 'repeating' END AS kind FROM n WHERE (conv_id % 3 = 0 AND n >= 3) OR (conv_id % 3 = 1 AND n >= 4)""", "conversations",
)
def call_loops(turns: DataFrame) -> DataFrame:
    """Conversations whose turns are calls: equal ones, alternating ones and ones of their own."""
    name = F.when(F.col("conv_id") % 3 == 0, "same").when(F.col("conv_id") % 3 == 1, F.when(F.col("turn") % 2 == 0, "a").otherwise("b")).otherwise(F.concat(F.lit("f"), F.col("turn").cast("string")))
    return conversations.repeated_calls(turns.select("conv_id", "turn", name.alias("name"), F.lit("{}").alias("arguments")), turns).select("conv_id", "kind")


@query(
    """WITH s AS (SELECT event_id, user_id, ts, CAST(ts AS DATE) AS d, sum(CASE WHEN event_type = 'error' THEN -1 ELSE 1 END) OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM events)
    SELECT event_id, user_id, CAST(s - least(0, min(s) OVER (PARTITION BY user_id, d ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)) AS BIGINT) AS used FROM s""", "events",
)
def quota_after_refunds(events: DataFrame) -> DataFrame:
    """Every event a use, errors refunds."""
    marks = events.select(F.col("event_id").alias("mark_id"), "user_id", "ts", (F.col("event_type") == "error").alias("refund"))
    return activity.quota_balance(marks).select(F.col("mark_id").alias("event_id"), "user_id", "used")
