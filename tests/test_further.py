"""Files, streams, telemetry, index, scrub, structure, uploads and word overlap against expected values, brute force and restarts."""

import json
import math
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lodewright.functions.scrub import scrub, scrub_json, scrubbed
from lodewright.operators import decisions, lookup, structure, telemetry, text_index
from lodewright.sources import formats, job_logs, pdf, sinks
from lodewright.streaming import replay


def body(*objects: bytes) -> bytes:
    return b"%PDF-1.5\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % x for x in enumerate(objects, 1)) + b"trailer << /Root 1 0 R >>\n%%EOF"


def stream(data: bytes, more: bytes = b"") -> bytes:
    return b"<< /Length %d %s >>\nstream\n%s\nendstream" % (len(data), more, data)


def test_pdf_text_operators_and_filters():
    shown = rb"BT /F1 12 Tf 72 720 Td (Re\(fund\)\040ru\154es) Tj 0 -14 Td [(re) -20 (quire) -400 <466f726d>] TJ T* (16.) ' ET BT 1 0 0 1 0 5 Tm (end\
less) Tj ET"
    want = "Re(fund) rules\nrequire Form\n16.\nendless"
    tree = (b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [3 0 R] /Count 1 >>", b"<< /Type /Page /Contents [4 0 R] >>")
    for data, how in ((shown, b""), (zlib.compress(shown), b"/Filter /FlateDecode"), (shown.hex().encode() + b">", b"/Filter [/ASCIIHexDecode]")):
        assert pdf.page_texts(body(*tree, stream(data, how))) == [(1, want)]


def test_pdf_object_streams_fonts_and_nested_trees():
    cmap = b"1 beginbfchar <01> <00E9> endbfchar 1 beginbfrange <02> <04> <0041> endbfrange 1 beginbfrange <05> <06> [<0078> <0079>] endbfrange"
    inner = b"1 0 2 33 3 90 "
    objects = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [3 0 R 6 0 R 2 0 R] /Resources << /Font << /F1 8 0 R >> >> >>", b"<< /Type /Pages /Kids [5 0 R] >>"]
    at, heads, packed = 0, b"", b""
    for n, o in enumerate(objects, 1):
        heads += b"%d %d " % (n, at)
        packed += o + b" "
        at = len(packed)
    del inner
    file = b"%PDF-1.5\n" + b"4 0 obj\n" + stream(zlib.compress(heads + packed), b"/Type /ObjStm /N 3 /First %d /Filter /FlateDecode" % len(heads)) + b"\nendobj\n"
    file += b"5 0 obj\n<< /Type /Page /Contents 7 0 R >>\nendobj\n6 0 obj\n<< /Type /Page /Contents 10 0 R >>\nendobj\n7 0 obj\n" + stream(b"BT /F1 9 Tf <0102030405ff> Tj ET") + b"\nendobj\n"
    file += b"8 0 obj\n<< /Type /Font /ToUnicode 9 0 R >>\nendobj\n9 0 obj\n" + stream(cmap) + b"\nendobj\n10 0 obj\n" + stream(b"BT /F2 9 Tf <FEFF65E5672C> Tj ET") + b"\nendobj\ntrailer << /Root 1 0 R >>"
    assert pdf.page_texts(file) == [(1, "éABCx"), (2, "日本")]


LITERAL = b"%PDF-1.4\n1 0 obj<<>>endobj\n2 0 obj<< /Length 64 >>stream\nBT /F1 12 Tf 72 720 Td (Refund rules require Form 16.) Tj ET\nendstream\nendobj\ntrailer<< /Root 1 0 R >>\n%%EOF"


def test_pdf_chunks_run_on_across_pages(spark, tmp_path):
    lines = "\n".join(f"line {i} of the first page" for i in range(100))
    (tmp_path / "two.pdf").write_bytes(pdf.simple_pdf([lines, "", "second page"]))
    (tmp_path / "broken.pdf").write_bytes(LITERAL)
    (tmp_path / "locked.pdf").write_bytes(LITERAL.replace(b"/Root", b"/Encrypt 9 0 R /Root"))
    (tmp_path / "empty.pdf").write_bytes(b"")
    rows = pdf.read_pdf(spark, str(tmp_path)).collect()
    own = sorted((r.chunk_index, r.page_number, len(r.text)) for r in rows if r.path.endswith("two.pdf"))
    assert [x[:2] for x in own] == [(0, 1), (1, 1), (2, 1), (3, 3)] and all(n <= 1200 for *_, n in own)
    assert "\n".join(r.text for r in sorted(rows, key=lambda r: r.chunk_index) if r.path.endswith("two.pdf")) == lines + "\nsecond page"
    assert [(r.page_number, r.chunk_index, r.text) for r in rows if not r.path.endswith("two.pdf")] == [(None, 0, "Refund rules require Form 16.")] * 2
    one = formats.read_any(spark, str(tmp_path / "broken.pdf")).first()
    assert (one.text, one.source_format, one.page_number) == ("Refund rules require Form 16.", "pdf", None)
    files = spark.createDataFrame([(1, None), (2, bytearray(LITERAL)), (2, bytearray(LITERAL))], "path long, content binary")
    assert [r.path for r in pdf.pages(files).collect()] == [2, 2] and pdf.chunked(files.limit(0)).count() == 0


EVENTS = "session_id string, seq long, event_type string, data string"


def test_replay_stops_at_terminal_events_and_sends_each_number_once(spark):
    stored = spark.createDataFrame([("a", 1, "processing", '{"message": "old"}'), ("a", 2, "turn_complete", "{}"), ("b", 2, "processing", None), ("b", 2, "processing", None), (None, 1, "x", "{}"), ("b", None, "x", "{}")], EVENTS)
    live = spark.createDataFrame([("a", 3, "processing", "{}"), ("b", 2, "late", "{}"), ("b", 3, "turn_complete", "{}"), ("b", 4, "processing", "{}")], EVENTS)
    got = [r.frame for r in replay.replayed(stored, live, 1).orderBy("session_id", "seq").collect()]
    assert got == ['id: 2\ndata: {"event_type": "turn_complete", "data": {}, "seq": 2}\n\n', 'id: 2\ndata: {"event_type": "processing", "data": {}, "seq": 2}\n\n', 'id: 3\ndata: {"event_type": "turn_complete", "data": {}, "seq": 3}\n\n']
    assert replay.replayed(stored, live, spark.createDataFrame([("b", 3)], "session_id string, after long")).count() == 3
    assert replay.replayed(stored.limit(0), live.limit(0)).count() == 0


def drained(query):
    query.awaitTermination(120)
    assert not query.isActive


def test_replay_stream_with_a_restart(spark, tmp_path):
    kind, where = EVENTS + ", ts timestamp", str(tmp_path / "in")

    def put(name, rows):
        os.makedirs(where, exist_ok=True)
        with open(f"{where}/{name}.json", "w") as f:
            f.writelines(json.dumps(dict(zip(("session_id", "seq", "event_type", "data", "ts"), (*r, f"2024-01-01 00:00:{r[1]:02d}")))) + "\n" for r in rows)

    def run():
        events = replay.replay_stream(spark.readStream.schema(kind).json(where), after=1)
        drained(events.writeStream.option("checkpointLocation", str(tmp_path / "check")).format("parquet").option("path", str(tmp_path / "out")).trigger(availableNow=True).start())

    put("0", [("a", 1, "processing", "{}"), ("a", 2, "processing", "{}"), ("b", 5, "processing", "{}")])
    run()
    put("1", [("a", 2, "processing", "{}"), ("a", 3, "turn_complete", "{}"), ("b", 4, "processing", "{}"), ("b", 5, "processing", "{}"), ("b", 6, "error", "{}")])
    run()
    put("2", [("a", 4, "processing", "{}"), ("b", 7, "processing", "{}"), ("c", 2, "processing", "{}")])
    run()
    got = [(r.session_id, r.seq) for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert sorted(got) == [("a", 2), ("a", 3), ("b", 5), ("b", 6), ("c", 2)]


PIECES = "message_id string, seq long, content string, tool_calls array<struct<index:int,id:string,name:string,arguments:string>>, finish_reason string, total_tokens long, last boolean"
STREAMED = [
    ("m", 1, "Hel", None, None, None, None), ("m", 2, "lo", None, None, None, False), ("m", 2, "lo", None, None, None, False), ("m", 3, None, [(1, "c1", "find", '{"a')], None, None, None),
    ("m", 4, None, [(0, "c0", "re", "{}"), (1, None, None, '": 1}')], None, None, None), ("m", 5, "", [(0, "", "ad", "")], "tool_calls", None, None), ("m", 6, None, None, None, 42, True),
    ("n", 1, None, None, None, None, None), ("n", 2, None, None, "stop", 7, True), ("o", 1, "open", None, None, None, None), ("o", 3, " end", None, "stop", 3, True), (None, 1, "x", None, None, None, True), ("p", None, "x", None, None, None, True),
]
ASSEMBLED = [
    ("m", "Hello", [(0, "c0", "read", "{}"), (1, "c1", "find", '{"a": 1}')], "tool_calls", 42, True), ("n", None, [], "stop", 7, True), ("o", "open end", [], "stop", 3, False),
]


def flat(rows):
    return sorted((r.message_id, r.content, [tuple(c) for c in r.tool_calls], r.finish_reason, r.total_tokens, r.complete) for r in rows)


def test_fragments_in_any_order(spark):
    for seed in range(3):
        rows = random.Random(seed).sample(STREAMED, len(STREAMED))
        assert flat(replay.assembled(spark.createDataFrame(rows, PIECES)).collect()) == ASSEMBLED
    assert replay.assembled(spark.createDataFrame([], PIECES)).count() == 0


def test_fragment_stream_agrees_with_the_batch_on_shuffled_arrivals(spark, tmp_path):
    where = str(tmp_path / "in")
    os.makedirs(where)
    rows = random.Random(1).sample(STREAMED, len(STREAMED))
    names = ("message_id", "seq", "content", "tool_calls", "finish_reason", "total_tokens", "last")

    def put(name, some, ts):
        with open(f"{where}/{name}.json", "w") as f:
            for r in some:
                one = dict(zip(names, r)) | {"ts": ts}
                one["tool_calls"] = r[3] and [dict(zip(("index", "id", "name", "arguments"), c)) for c in r[3]]
                f.write(json.dumps(one) + "\n")

    def run():
        pieces = spark.readStream.schema(PIECES + ", ts timestamp").json(where)
        out = replay.assembled_stream(pieces, "1 minute").writeStream.option("checkpointLocation", str(tmp_path / "check")).format("parquet").option("path", str(tmp_path / "out"))
        drained(out.trigger(availableNow=True).start())

    for i in range(0, len(rows), 5):
        put(f"{i:02d}", rows[i : i + 5], "2024-01-01 00:00:00")
        run()  # a restart after every file
    assert flat(spark.read.parquet(str(tmp_path / "out")).collect()) == ASSEMBLED[:2]
    put("98", [("z", 1, "z", None, None, None, None)], "2024-01-01 01:00:00")
    run()
    put("99", [("z", 2, "z", None, None, None, None)], "2024-01-01 01:00:01")
    run()
    assert flat(spark.read.parquet(str(tmp_path / "out")).collect()) == ASSEMBLED


def test_job_logs_give_each_line_once(spark, tmp_path, sf):
    """Lines of the events' table grow in pieces, half lines included; a log is read again from its start, shorter at first; every run is a restart."""
    spark.dataSource.register(job_logs.JobLogs)
    logs = tmp_path / "logs"
    logs.mkdir()
    lines = defaultdict(list)
    for r in spark.read.parquet(f"{sf}/events.parquet").orderBy("event_id").limit(200).collect():
        lines[f"job{r.user_id % 3}"].append(f"{r.event_id} {r.event_type} é {r.props}")
    whole = {job: "".join(x + "\n" for x in own).encode() for job, own in lines.items()}

    def run():
        source = spark.readStream.format("job_logs").option("marks", str(tmp_path / "marks.json")).option("wait", 0).load(str(logs))
        out = source.writeStream.option("checkpointLocation", str(tmp_path / "check")).format("parquet").option("path", str(tmp_path / "out"))
        drained(out.trigger(availableNow=True).start())

    for share in (0.3, 0.55, 0.2, 0.7, 1.0):
        for job, data in whole.items():
            (logs / f"{job}.log").write_bytes(data[: int(len(data) * share)])
        run()
    got = defaultdict(list)
    for r in spark.read.parquet(str(tmp_path / "out")).orderBy("job_id", "at").collect():
        got[r.job_id].append(r.line)
    assert got == lines


def test_job_logs_try_again_after_a_lost_connection():
    tries = []

    def call():
        tries.append(1)
        if len(tries) < 3:
            raise ConnectionError
        return 5

    assert job_logs._retried(call, 5, 0) == 5 and len(tries) == 3
    with pytest.raises(ConnectionError):
        job_logs._retried(lambda: (_ for _ in ()).throw(ConnectionError()), 2, 0)


def test_telemetry_of_all_types(spark):
    rows = [
        (1, "llm_call", '{"model": "m", "latency_ms": 12, "prompt_tokens": 3, "cost_usd": null}'), (2, "hf_job_submit", '{"job_type": "train", "push_to_hub": true, "job_id": "j"}'), (3, "hf_job_complete", '{"final_status": "COMPLETED", "wall_time_s": -4}'),
        (4, "feedback", json.dumps({"rating": "up", "comment": "mail a.b@example.org " + "x" * 600})), (5, "dataset_upload", '{"repo_id": "r", "filename": "f", "size_bytes": 10, "status": "ok"}'), (6, "model_chat", '{"model_id": "m", "message_count": 2}'),
        (7, "provider_error", json.dumps({"provider": "p", "operation": "o", "error": "e" * 700})), (8, "llm_call", "[1]"), (9, "llm_call", None), (10, "llm_call", '{"model": "m"}'), (11, "llm_call", '{"model": "m", "latency_ms": "soon"}'), (12, None, "{}"), (13, "ping", '{"token": "abc"}'),
        (14, "feedback", '{"rating": "up", "comment": null}'),
    ]
    r = telemetry.routed(spark.createDataFrame(rows, "event_id long, event_type string, data string"))
    one = {k: telemetry.records(r, k, "event_id").collect() for k in telemetry.RECORDS}
    assert {k: [x.event_id for x in v] for k, v in one.items()} == {"llm_call": [1], "hf_job_submit": [2], "hf_job_complete": [3], "feedback": [4, 14], "dataset_upload": [5], "model_chat": [6], "provider_error": [7]}
    assert (one["llm_call"][0].prompt_tokens, one["llm_call"][0].kind, one["llm_call"][0].cost_usd) == (3, "main", 0.0)
    assert (one["hf_job_submit"][0].flavor, one["hf_job_submit"][0].push_to_hub, one["hf_job_complete"][0].wall_time_s) == ("cpu-basic", True, 0)
    assert len(one["feedback"][0].comment) == 500 and one["feedback"][0].comment.startswith("mail [REDACTED_EMAIL] x") and one["feedback"][1].comment == "" and len(one["provider_error"][0].error) == 500
    bad = {x.event_id: (x.problem, x.payload) for x in r.where("problem IS NOT NULL").collect()}
    assert bad == {8: ("not an object", "[1]"), 9: ("not an object", None), 10: ("missing latency_ms", '{"model": "m"}'), 11: ("bad latency_ms", '{"model": "m", "latency_ms": "soon"}'), 12: ("unknown type", "{}"), 13: ("unknown type", '{"token": "[REDACTED_SECRET]"}')}


def test_scrub_of_any_shape(spark):
    deep = "x@example.org"
    for _ in range(60):
        deep = [deep]
    got = scrub(deep)
    for _ in range(50):
        got = got[0]
    assert got == "[REDACTED_MAX_DEPTH]"
    given = {"HF_TOKEN": "hf_" + "a" * 30, "prompt_tokens": 5, "token_count": 3, "list": [{"password": {"a": 1}}, "Bearer " + "b" * 24, True, None, 1.5], "é": "sk-" + "c" * 41, "access-key": None}
    want = {"HF_TOKEN": "[REDACTED_SECRET]", "prompt_tokens": 5, "token_count": 3, "list": [{"password": "[REDACTED_SECRET]"}, "Bearer [REDACTED]", True, None, 1.5], "é": "[REDACTED_OPENAI_KEY]", "access-key": "[REDACTED_SECRET]"}
    assert json.loads(scrub_json(json.dumps(given))) == want
    assert scrub_json("not json a@b.org") == "not json [REDACTED_EMAIL]" and scrub_json("[" * 100_000) == "[" * 100_000 and scrub_json('{"a": 1e999, "b": "x@y.org"}') == '{"a": 1e999, "b": "[REDACTED_EMAIL]"}'
    rows = spark.createDataFrame([(json.dumps(given),), (None,)], "t string").select(F.to_json(scrubbed(F.try_parse_json("t"))).alias("v")).collect()
    assert sorted((json.loads(r.v) if r.v else None for r in rows), key=str) == sorted([want, None], key=str)


PORTER = {"caresses": "caress", "ponies": "poni", "agreed": "agre", "plastered": "plaster", "hopping": "hop", "falling": "fall", "filing": "file", "happy": "happi", "sky": "sky", "relational": "relat", "hopeful": "hope", "adoption": "adopt", "cease": "ceas", "controll": "control", "generalizations": "gener", "oscillators": "oscil", "été": "été", "is": "is"}


def brute_search(docs, queries, k, weights):
    words = lambda t: [text_index.porter(w) for w in re.findall(r"[^\W_]+", (t or "").lower()) if w not in text_index.STOP and len(w) > 1]
    tf = {f: {d[0]: Counter(words(d[1 + i])) for d in docs} for i, f in enumerate(weights)}
    out = []
    for q, text in queries:
        scores = defaultdict(float)
        for f, w in weights.items():
            mean = sum(sum(c.values()) for c in tf[f].values()) / len(docs)
            for term in set(words(text)):
                df = sum(term in c for c in tf[f].values())
                idf = math.log(1 + (len(docs) - df + 0.5) / (df + 0.5))
                for d, c in tf[f].items():
                    if term in c:
                        scores[d] += w * idf * c[term] * 2.2 / (c[term] + 1.2 * (0.25 + 0.75 * sum(c.values()) / mean))
        best = sorted(scores.items(), key=lambda x: (-round(x[1], 6), x[0]))[:k]
        out += [(q, i, d, round(s, 4)) for i, (d, s) in enumerate(best, 1)]
    return sorted(out)


def test_porter():
    assert {w: text_index.porter(w) for w in PORTER} == PORTER


@pytest.mark.parametrize("salted", [text_index.SALTED, 5])
def test_stored_index_by_brute_force(spark, sf, tmp_path, salted):
    rows = [(r.doc_id, r.source, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()] + [(9001, None, None), (9002, "Hopping hopes", "controlling the relational relations of hope"), (9003, "", "")]
    asked = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").limit(12).collect()] + [(-1, "hoping the relate of control"), (-2, None), (-3, "the of zzzz"), (-4, "web web commons")]
    docs, queries = spark.createDataFrame(rows, "doc_id long, title string, content string"), spark.createDataFrame(asked, "query_id long, query string")
    path = str(tmp_path / "index")
    text_index.build(docs, path, salted=salted)
    got = [(r.query_id, r.rank, r.key, round(r.score, 4)) for r in text_index.search(spark, path, queries, 7).collect()]
    want = brute_search(rows, asked, 7, text_index.FIELDS)
    assert [x[:3] for x in sorted(got)] == [x[:3] for x in want] and all(abs(a[3] - b[3]) < 1e-3 for a, b in zip(sorted(got), want))
    order = spark.createDataFrame([(5, 2), (6, 1), (7, 3)], "key long, place int")
    shown = {(r.query_id, r.rank): (r.key, r.score) for r in text_index.search(spark, path, queries.where("query_id IN (-2, -3)"), 2, order=order).collect()}
    assert shown == {(q, n): (k, None) for q in (-2, -3) for n, k in ((1, 6), (2, 5))}
    read = text_index.search(spark, path, queries, 80).inputFiles()
    assert {f.split("/index/")[1].split("/")[0] for f in read if "/index/" in f} == {"postings", "words", "fields"} and all("/index/" in f for f in read)
    with pytest.raises(ValueError):
        text_index.search(spark, path, queries, 0)


def test_message_structure_of_odd_columns(spark):
    rows = [(1, None), (2, "not json"), (3, '[1, "x", {"role": "system", "content": "s"}]'), (4, json.dumps([{"role": "user", "content": "é" * 120, "name": None}, {"role": "assistant", "function_call": None}])), (5, json.dumps([{"role": "Tool", "tool_call_id": ""}]))]
    r = structure.message_structure(spark.createDataFrame(rows, "i int, messages string"), "i").first()
    assert (r.roles, r["keys"], r.has_tool_calls, r.has_tool_results, r.n) == (["Tool", "assistant", "system", "user"], ["role", "content", "tool_call_id", "name", "function_call"], True, False, 4)
    assert json.loads(r.example) == {"role": "assistant", "function_call": None}
    one = structure.message_structure(spark.createDataFrame(rows[3:4], "i int, messages string").withColumn("messages", F.replace("messages", F.lit("assistant"), F.lit("system"))), "i").first()
    assert json.loads(one.example)["content"] == "é" * 100 + "..."
    called = [(1, json.dumps([{"role": "assistant"}, {"role": "tool"}])), (2, json.dumps([{"role": "user", "tool_calls": [{"id": "c"}]}]))]
    two = structure.message_structure(spark.createDataFrame(called, "i int, messages string"), "i").first()
    assert json.loads(two.example)["role"] == "user" and two.has_tool_calls and two.has_tool_results
    assert structure.message_structure(spark.createDataFrame([], "i int, messages string"), "i").first().n == 0


def test_section_tree(spark):
    from lodewright.operators.exchange import found_section

    html = "<h1>Paper</h1><p>p</p><h2>Abstract</h2><p>We show.</p><h2>1 Intro</h2><p>i</p><h3>1.1 Aim</h3><p>a</p><h4>Detail</h4><p>d</p><h2>A Appendix</h2><p>x</p><h3>A.1 More</h3><h4>A.1.2 Proof</h4><p>q</p><h5>Step</h5><p>s</p>"
    sections = formats.sections(spark.createDataFrame([(1, html), (2, "no heading"), (3, None)], "page_id long, html string"))
    got = {r.pos: r for r in structure.section_tree(sections).where("page_id = 1").collect()}
    assert [got[i].id for i in sorted(got)] == ["~1", "~1.1", "1", "1.1", "~1.1.1", "~1.3", "A.1", "A.1.2", "~A.1.2.1"]
    assert [got[i].parent for i in sorted(got)] == [None, 0, 0, 2, 3, 0, 5, 6, 7]
    assert (got[2].whole, got[6].whole) == ("i\n\na\n\nd", "q\n\ns")
    assert structure.abstract(sections).collect() == [(1, "We show.")]
    listed = structure.section_tree(sections).where("page_id = 1").groupBy("page_id").agg(F.sort_array(F.collect_list(F.struct("pos", "id", "title"))).alias("s"))
    asked = lambda q: listed.select(found_section(F.col("s"), F.lit(q)).alias("x")).first().x.pos
    assert [asked(q) for q in ("1.1", "A.1.2", "abstract", "append")] == [3, 7, 1, 5]


def test_uploads_twice_and_again_after_failure(spark, tmp_path):
    path, log = str(tmp_path / "sessions"), str(tmp_path / "attempts")
    rows = [("a", "pending", "2024-01-01T10:00:00", "mail a@b.org", [1]), ("b", None, "2024-01-02T10:00:00", None, None), ("c", "success", "2024-01-01", "x", None), ("d", "failed", "no time", "x", None), (None, "pending", "2024-01-01", "x", None)]
    sessions = spark.createDataFrame(rows, "session_id string, upload_status string, session_start_time string, messages string, events array<int>")
    at = lambda s: F.lit(s).cast("timestamp")
    due = lambda now: sinks.due_uploads(sessions, sinks.read_attempts(spark, log), at(now))
    listed = lambda now: sorted((r.session_id, r.attempt) for r in due(now).collect())
    assert listed("2024-02-01 00:00:00") == [("a", 0), ("b", 0), ("d", 0)]
    sinks.upload_sessions(due("2024-02-01 00:00:00"), path, log, at("2024-02-01 00:00:00"))
    assert listed("2024-02-01 00:00:00") == [] and listed("2024-02-01 00:00:01") == [("d", 1)]
    sinks.upload_sessions(sessions.withColumn("attempt", F.lit(0)).where("session_id = 'a'"), path, log, at("2024-02-01 00:00:01"))
    got = spark.read.json(path).orderBy("session_id").collect()
    assert [(r.session_id, str(r.date)) for r in got] == [("a", "2024-01-01"), ("b", "2024-01-02")] and (got[0].messages, got[0].events) == ("mail [REDACTED_EMAIL]", "[1]")
    for second, attempt in (("02", 1), ("10", 2)):
        sinks.upload_sessions(due(f"2024-02-01 00:00:{second}"), path, log, at(f"2024-02-01 00:00:{second}"))
        assert max(r.attempt for r in sinks.read_attempts(spark, log).where("session_id = 'd'").collect()) == attempt
    assert listed("2024-03-01 00:00:00") == []
    broken = tmp_path / "file"
    broken.write_text("in the way")
    with pytest.raises(Exception):
        sinks.upload_sessions(sessions.where("session_id = 'a'").withColumn("attempt", F.lit(7)), str(broken / "x"), log, at("2024-02-01 00:00:20"))
    assert [r.status for r in sinks.read_attempts(spark, log).where("attempt = 7").collect()] == ["failed"]


def test_compaction(spark):
    def parts(roles, budget, untouched=5):
        turns = spark.createDataFrame([(1, i, r, 10) for i, r in enumerate(roles)], "conv_id int, turn int, role string, tokens int")
        return [r.part for r in structure.compaction(turns, budget, untouched).orderBy("turn").collect()]

    talk = ["system", "user", "assistant", "user", "assistant", "user", "assistant", "user", "assistant", "tool"]
    assert parts(talk, 111) == ["system", "task", "summarised", "summarised", "summarised"] + ["tail"] * 5
    assert parts(talk, 112) == ["kept"] * 10  # 100 is not over 90 % of 112, rounded down
    assert parts(talk, 50, untouched=2) == ["system", "task"] + ["summarised"] * 5 + ["tail"] * 3
    assert parts(["assistant", "assistant", "user", "assistant", "assistant", "user", "x", "y"], 10, 3) == ["dropped", "dropped", "task", "summarised", "summarised", "tail", "tail", "tail"]
    assert parts(["system", "user", "assistant"], 10) == ["kept"] * 3 and parts(["system"] + ["assistant"] * 8, 10) == ["kept"] * 9


def test_decisions_of_the_rule_tables(spark):
    pair, chat = json.dumps([{"prompt": "x", "completion": "y"}]), json.dumps([{"messages": [{"role": "user", "content": "x"}, {"role": "assistant", "content": "y"}]}])
    rows = [
        ("tiny", 30, ["prompt", "completion"], pair, "jsonl", "prompt_completion"), ("large", 5000, ["messages"], chat, "parquet", "sft_messages"), ("reward", 500, ["prompt"], json.dumps([{"prompt": "x"}]), "jsonl", "grpo_prompt_only"),
        ("sure", 5000, ["prompt"], json.dumps([{"prompt": "x"}]), "jsonl", "grpo_prompt_only"), ("unseen", 1200, ["prompt", "completion"], None, "jsonl", "prompt_completion"), ("blank", 1200, ["prompt", "completion"], json.dumps([{"prompt": "", "completion": " "}]), "jsonl", "prompt_completion"),
        ("empty", 0, [], None, None, None), ("unknown", None, None, None, None, None), ("prefer", 900, ["prompt", "chosen", "rejected"], json.dumps([{"prompt": "a", "chosen": "b", "rejected": "c"}]), "jsonl", "dpo"),
        ("table", 250, ["Form No", "Purpose", "Rate"], json.dumps([{"Form No": "1", "Purpose": "p", "Rate": 2}]), "csv", "structured_reference_table"), ("book", 40, ["text"], json.dumps([{"text": "x"}]), "pdf", "document_corpus"), ("table of lists", 800, ["a"], json.dumps([{"a": [1]}]), "parquet", "unknown"),
    ]
    df = spark.createDataFrame([(*r, 0.0, 0.0) for r in rows], "name string, row_count long, columns array<string>, sample_rows string, format string, shape string, missing_fraction double, duplicate_fraction double")
    got = {r.name: r.strategy for r in decisions.strategies(df).collect()}
    assert {k: (s.strategy, s.method, s.confidence, s.risk_level, s.requires_override) for k, s in got.items()} == {
        "tiny": ("fine_tune", "sft", 0.42, "high", True), "large": ("fine_tune", "sft", 0.96, "low", False), "reward": ("fine_tune", "grpo", 0.65, "medium", True), "sure": ("fine_tune", "grpo", 0.75, "medium", True),
        "unseen": ("data_needed", None, 0.84, "high", True), "blank": ("data_needed", None, 0.84, "high", True), "empty": ("data_needed", None, 0.9, "high", True), "unknown": ("hybrid", None, 0.78, "medium", True),
        "prefer": ("fine_tune", "dpo", 0.84, "low", False), "table": ("hybrid", None, 0.78, "high", True), "book": ("rag", None, 0.88, "medium", True), "table of lists": ("hybrid", None, 0.78, "medium", True),
    }
    assert got["tiny"].override_message and not got["large"].override_message and len(got["reward"].next_actions) == 3 and got["tiny"].reasons[-1] == "30 rows"


def test_word_overlap_by_brute_force(spark):
    """A word that all rows share, rows that share frequent words only, ties, repeated ids, nulls."""
    rng = random.Random(2)
    common = [f"c{i}" for i in range(70)]
    rows = [(i, " ".join(["the", *rng.sample(common, rng.randint(0, 30)), *(f"r{rng.randint(0, 400)}" for _ in range(rng.randint(0, 5)))])) for i in range(300)]
    rows += [(300, None), (301, ""), (5, "the unique r1 r1"), (302, "The, THE c1")]
    asked = [(q, " ".join(rng.sample([*common, "the"], rng.randint(1, 20)) + [f"r{rng.randint(0, 400)}" for _ in range(rng.randint(0, 4))])) for q in range(60)] + [(60, "the"), (61, None), (62, "nothing"), (63, "c1 the"), (64, " ".join(common))]
    words = lambda t: set(re.findall("[a-z0-9]+", (t or "").lower()))
    want = {}
    for q, text in asked:
        best = min(((-len(words(text) & words(t)), i) for i, t in rows if words(text) & words(t)), default=None)
        if best:
            want[q] = (best[1], -best[0])
    questions, table = spark.createDataFrame(asked, "question_id int, question string"), spark.createDataFrame(rows, "row_id long, text string")
    got = lookup.overlap_top1(questions, table)
    assert {r.question_id: (r.row_id, r.shared) for r in got.collect()} == want
    assert "NestedLoop" not in got._jdf.queryExecution().toString() and "Cartesian" not in got._jdf.queryExecution().toString()
    assert lookup.overlap_top1(questions, table.limit(0)).count() == 0 and lookup.overlap_top1(questions.limit(0), table).count() == 0
