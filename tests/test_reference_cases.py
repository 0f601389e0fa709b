"""Expected results on small inputs: profile, decisions, redaction, lookup, cases, conversations, activity, sources and streams."""

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from lodewright.functions import text as X
from lodewright.functions.values import messages, timeout_hours, usage
from lodewright.operators import activity, conversations, evals, lookup
from lodewright.operators import decisions as D
from lodewright.operators import profile as P
from lodewright.sources import formats, sinks
from lodewright.streaming import events as S


def one(spark, expression, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expression(F.col("x")).alias("y")).first().y


def test_profile_counts_missing_and_copies(spark):
    df = spark.createDataFrame([("10", "a", None), ("20", "b", " ")], "Section string, Description string, Limit string")
    r = P.profile(df).first()
    assert (r.row_count, r.missing_summary["Limit"], r.duplicate_count) == (2, 2, 0)
    r = P.profile(spark.createDataFrame([("", None), ("", None)], "prompt string, completion string")).first()
    assert (r.missing_fraction, r.duplicate_count, r.duplicate_fraction) == (1.0, 1, 0.5)
    assert P.profile(df.limit(0)).first().missing_fraction == 0.0
    basis = lambda of: tuple(P.profile(df, of).select("row_count", "profiled_row_count", "statistics_basis").first())
    assert [basis(n) for n in (None, 2, 9)] == [(2, 2, "full_dataset"), (2, 2, "full_dataset"), (9, 2, "sample_rows")]


REFERENCE = ["Form No", "Category", "Purpose", "Due Dates"]
PAIR = [{"prompt": "a", "completion": "b"}]


TRAINABILITY = [
    (26, REFERENCE, [{"Form No": "1"}], "xlsx", 0.0, 0.0, (0, "rag", "high")), (26_000, ["prompt", "completion"], PAIR, "csv", 0.0, 0.0, (90, "fine_tune", "low")),
    (800, ["prompt", "completion"], PAIR, "jsonl", 0.0, 0.0, (90, "fine_tune", "low")), (0, ["x"], [], "csv", 0.45, 0.35, (0, "data_needed", "high")),
    (1200, ["messages"], [{"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]}], "jsonl", 0.0, 0.0, (100, "fine_tune", "low")),
    (1200, ["messages"], [{"messages": None}], "jsonl", 0.0, 0.0, (75, "hybrid", "medium")), (1200, ["input", "output"], [{"input": "a", "output": "b"}], "jsonl", 0.1, 0.1, (82, "fine_tune", "low")),
    (1200, ["prompt", "completion"], None, "jsonl", None, None, (75, "fine_tune", "medium")), (None, ["text", "source_format"], [{"text": "x", "source_format": "pdf"}], None, 0.0, 0.0, (20, "rag", "high")),
    (5000, ["a", "b"], [{"a": 1, "b": 2}], "parquet", 0.3, 0.25, (40, "data_needed", "high")), (500, REFERENCE, [{"Form No": [1]}], "csv", 0.0, 0.0, (55, "hybrid", "medium")),
]
PROFILE = "i int, row_count long, columns array<string>, sample_rows string, format string, missing_fraction double, duplicate_fraction double"


def test_trainability(spark):
    rows = [(i, n, columns, None if given is None else json.dumps(given), kind, missing, twice) for i, (n, columns, given, kind, missing, twice, _) in enumerate(TRAINABILITY)]
    got = {r.i: r.trainability for r in D.assessed(spark.createDataFrame(rows, PROFILE)).collect()}
    assert {i: (t.score, t.recommendation, t.risk_level) for i, t in got.items()} == {i: x[-1] for i, x in enumerate(TRAINABILITY)}


def test_shapes(spark):
    chat = [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]
    cases = (
        (["messages"], [{}], None, "unknown"), (["messages"], [{"messages": None}], None, "unknown"), (["messages"], [{"messages": chat}], None, "sft_messages"),
        (["Messages"], [{"Messages": '[{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]'}], None, "sft_messages"), (["messages"], [{"messages": chat[:1]}], None, "unknown"),
        (["prompt", "completion"], PAIR, None, "prompt_completion"), (["prompt", "completion"], [{"prompt": " ", "completion": None}], None, "unknown"),
        (["prompt", "chosen", "rejected"], [{"prompt": "a", "chosen": "b", "rejected": "c"}], None, "dpo"), (["prompt"], [{"prompt": "a"}], None, "grpo_prompt_only"),
        (["instruction", "response"], [{"instruction": "a", "response": "b"}], None, "prompt_completion"), (["instruction", "response", "output"], [{"instruction": "a", "response": "b", "output": ""}], None, "unknown"),
        (["question", "answer"], [], None, "qa"), (["text", "chunk_index"], [{}], None, "unknown"), (["text", "chunk_index", "source_file"], [{}], None, "document_corpus"),
        (["text", "source_format"], [{"source_format": "PDF"}], None, "document_corpus"), (["sentence", "label"], [], None, "classification"), (["content", "label"], [], None, "classification"),
        (["Section", "Description", "Limit", "Applicability"], [{"Section": "80C"}], None, "structured_reference_table"), (["Section", "Rule", "x"], [], "csv", "structured_reference_table"),
        (["Section", "Rule", "x"], [{"x": [1]}], None, "unknown"), (["Section", "code", "x"], [{"x": 1}], None, "unknown"),
    )
    df = spark.createDataFrame([(i, 9, columns, json.dumps(rows), kind, 0.0, 0.0) for i, (columns, rows, kind, _) in enumerate(cases)], PROFILE)
    got = {r.i: r["shape"] for r in D.inferred(df).collect()}
    assert [(cases[i][:2], got[i]) for i in got] == [(cases[i][:2], cases[i][3]) for i in got]


def test_names_with_dots_and_ticks(spark):
    df = spark.createDataFrame([("x", None), ("x", None)], "`a.b` string, `c``d` string")
    r = P.profile(df).first()
    assert (r.missing_summary, r.duplicate_count) == ({"a.b": 0, "c`d": 2}, 1)
    assert P.sample(df, "`a.b`").count() == 2


def test_content_tokens_and_plain_text(spark):
    assert one(spark, X.plain, "  Café-Straße\tÀ  b… ") == "cafe strasse a b..."
    assert sorted(spark.range(1).select(X.content_tokens(F.lit("The classes of its companies: based on boxes, given tax")).alias("t")).first().t) == ["box", "class", "company", "tax"]


TAX = [(0, "ITR-1", "Returns", "Simple income return", "31 July", "Both"), (1, "Form 16", "TDS", "Salary TDS certificate", "15 June", "Both"), (2, "Form 10E", "Relief", "Relief claim", None, "Old"),
       (3, "Form 49B", "TAN", "TAN application", "Any time", "Both")]
TAX_COLUMNS = "row_index long, `Form No` string, Category string, Purpose string, `Due Dates` string, `Old/New Regime Applicability` string"
SENTINEL = "Not specified in the source table"


def test_tables_answer_questions(spark):
    asked = [
        ("What is ITR-1 used for?", "answered", "Simple income return", 0), ("what is itr 1 used for", "answered", "Simple income return", 0), ("what is form16 used for", "answered", "Salary TDS certificate", 1),
        ("Which form is used for TAN application?", "answered", "Form 49B", 3), ("What due date is listed for Form 10E?", "no_answer", SENTINEL, 2), ("What penalty applies if I file ITR-1 late?", "unsupported", SENTINEL, None),
        ("What is ITR-10 used for?", "unsupported", SENTINEL, None), ("What is ITR-1A used for?", "unsupported", SENTINEL, None),
    ]
    questions = spark.createDataFrame([(i, q) for i, (q, *_) in enumerate(asked)], "question_id long, question string")
    table = spark.createDataFrame(TAX, TAX_COLUMNS)
    got = {r.question_id: r for r in lookup.table_answers(questions.where("question_id < 6"), table).collect()}
    got |= {r.question_id: r for r in lookup.table_answers(questions.where("question_id >= 6"), table.where("row_index = 0")).collect()}
    for i, (q, status, answer, row) in enumerate(asked):
        assert (got[i].status, got[i].answer, got[i].rows) == (status, answer, None if row is None else [row]), q
    twice = spark.createDataFrame([(0, "Form DUP", "One thing"), (1, "Form DUP", "Another")], "row_index long, `Form No` string, Purpose string")
    r = lookup.table_answers(spark.createDataFrame([(0, "What is Form DUP used for?")], "question_id long, question string"), twice).first()
    assert (r.status, r.reason, r.rows) == ("no_answer", "ambiguous_top_match", [0, 1])
    tiers = spark.createDataFrame([(0, "Starter", "Entry-level product tier", "All")], "row_index long, Category string, Description string, Applicability string")
    r = lookup.table_answers(spark.createDataFrame([(0, "What is Starter used for?")], "question_id long, question string"), tiers).first()
    assert (r.status, r.answer, r.rows) == ("answered", "Entry-level product tier", [0])
    s = lookup.reference_summary(table).first()
    assert (s.ready, s.row_count, s.key_columns) == (True, 4, ["Form No", "Category", "Purpose"])
    assert not lookup.reference_summary(table.limit(0)).first().ready


def test_lookup_meets_every_scoring_pair(spark):
    """The same pairs as scoring each question against each key."""
    keys = ["data base", "Viet Nam", "80CC", "section 80 cc", "new york city", "of the", "a", "Form 16 (part b)", "form", "x1", "big red fox", "red"]
    asked = ["what is database used for", "Vietnam?", "section 8 0 c c", "the city of new york", "of", "part b of form-16", "fox red", "big", "", None, "x-1!", "a"]
    questions = spark.createDataFrame(list(enumerate(asked)), "question_id long, question string")
    table = spark.createDataFrame(list(enumerate(keys)), "row_index long, key string")
    every = questions.crossJoin(table).withColumn("score", lookup.value_score(F.col("question"), F.col("key"))).where("score >= 40")
    want = {(r.question_id, r.row_index, r.score) for r in every.collect()}
    assert {(r.question_id, r.row_index, r.score) for r in lookup.scored(questions, table, "key").collect()} == want and len(want) >= 10


def test_redaction(spark):
    text = "key hf_" + "a" * 32 + " id 1234 5678 9012 mail a@b.co PASSWORD=hunter2 customer support desk"
    out = one(spark, X.redacted, text)
    assert "[REDACTED_HF_TOKEN]" in out and "[REDACTED_AADHAAR]" in out and "[REDACTED_EMAIL]" in out and "PASSWORD=[REDACTED_SECRET]" in out
    assert "hunter2" not in out and "a@b.co" not in out
    df = spark.createDataFrame([((3, "x", ["PASSWORD=p"]),)], "r struct<prompt_tokens:long,api_key:string,notes:array<string>>")
    r = df.select(X.redacted_value(F.col("r"), df.schema["r"].dataType).alias("r")).first().r
    assert (r.prompt_tokens, r.api_key, r.notes) == (3, "[REDACTED_SECRET]", ["PASSWORD=[REDACTED_SECRET]"])


def test_timeouts_and_usage(spark):
    for text, hours in ((None, 0.5), ("", 0.5), ("30m", 0.5), ("3h", 3.0), ("1d", 24.0), ("3600", 1.0), ("not-a-duration", None), ("-1h", None)):
        assert one(spark, timeout_hours, text) == hours
    assert one(spark, usage, '{"prompt_tokens": 3, "completion_tokens": 4}').total_tokens == 7
    assert one(spark, messages, "not json") == []


def test_chunks(spark):
    text = " a \n\n" + "b" * 25 + "\nc c\nd"
    assert one(spark, lambda c: X.chunks(c, 10), text) == ["a", "b" * 10, "b" * 10, "bbbbb\nc c", "d"]


FORMS = [(0, "ITR-1", "Simple income return", "31 July"), (1, "Form 16", "Salary TDS certificate", "15 June"), (2, "Form 10E", "Relief claim", None), (3, "Form 49B", "TAN application", "None")]


def test_lookup(spark):
    rows = spark.createDataFrame(FORMS, "row_index long, form string, purpose string, due string")
    asked = spark.createDataFrame([(1, "What is ITR-1 used for?"), (2, "what is itr 1 used for"), (3, "what is form16 used for"), (4, "What is ITR-10 used for?"), (5, "What is ITR-1A used for?")], "question_id long, question string")
    got = {r.question_id: (r.status, r.answer) for r in lookup.answers(asked, rows, "form", "purpose").collect()}
    assert got[1] == got[2] == ("answered", "Simple income return") and got[3] == ("answered", "Salary TDS certificate")
    assert got[4][0] == got[5][0] == "unsupported"
    due = lookup.answers(spark.createDataFrame([(1, "What due date is listed for Form 10E?")], "question_id long, question string"), rows, "form", "due").first()
    assert due.status == "no_answer" and due.rows == [2]
    twice = spark.createDataFrame([(0, "Form DUP", "a"), (1, "Form DUP", "b")], "row_index long, form string, purpose string")
    r = lookup.answers(spark.createDataFrame([(1, "What is Form DUP used for?")], "question_id long, question string"), twice, "form", "purpose").first()
    assert (r.status, r.rows) == ("ambiguous", [0, 1])


def test_cases_and_scores(spark):
    rows = spark.createDataFrame([(0, "ITR-1", "Simple income return")], "row_index long, `Form No` string, Purpose string")
    cases = evals.reference_cases(rows)
    task = "structured_reference_qa:0:"
    assert [r.case_id for r in cases.collect()] == [task + "purpose", task + "reverse_lookup"]
    said = spark.createDataFrame([(task + "purpose", "It is a simple income return."), (task + "reverse_lookup", "I need context.")], "case_id string, output string")
    got = {r.case_id: r.status for r in evals.score_outputs(cases, said).collect()}
    assert got == {task + "purpose": "passed", task + "reverse_lookup": "needs_rag"}
    assert evals.status_counts(evals.score_outputs(cases, said.limit(0))).first().overall == "needs_more_data"
    made = evals.examples(rows, "Form No", {"purpose": ("What is %s used for?", "Purpose"), "summary": ("Summarise %s.", "Purpose")}, "Answer from the table.")
    assert made.count() == 2 and [m.role for m in made.first().messages] == ["system", "user", "assistant"]


def test_repeated_calls(spark):
    rows = [(1, i, "a", "{}") for i in range(3)] + [(2, i, "ab"[i % 2], "{}") for i in range(4)] + [(3, i, "abc"[i], "{}") for i in range(3)]
    got = {r.conv_id: r.kind for r in conversations.repeated_calls(spark.createDataFrame(rows, "conv_id long, turn long, name string, arguments string")).collect()}
    assert got == {1: "identical", 2: "repeating"}


def test_activity(spark):
    s = spark.createDataFrame([("a", "u", "idle", "active", "shown", "p", ["j1", "j2"], "2026-01-01T00:00:00"), ("b", "u", "idle", "ended", "deleted", "p", [], "2026-01-02T00:00:00")],
                              "session_id string, user_id string, runtime_state string, status string, visibility string, provider_id string, running_job_ids array<string>, updated_at string")
    assert tuple(activity.session_kpis(s).first()) == (1, 1, 1, 2)
    jobs = activity.orphan_jobs(s, F.to_timestamp(F.lit("2026-01-03 00:00:00")), 24).collect()
    assert sorted(r.job_id for r in jobs) == ["j1", "j2"] and {r.reason for r in jobs} == {"stale"}
    costs = activity.job_costs(spark.createDataFrame([("a100", "8h"), ("x", "1h")], "flavor string, timeout string"), spark.createDataFrame([("a100", 4.0)], "flavor string, usd_per_hour double"))
    assert {r.flavor: r.cost for r in costs.collect()} == {"a100": 32.0, "x": None}
    many = spark.createDataFrame([(f"s{i:03}", "u" if i % 2 else "dev", f"2026-01-{1 + i // 30:02}T00:00:00") for i in range(60)], "session_id string, user_id string, created_at string")
    assert activity.admitted_sessions(many, 50, 10).where("admitted").count() == 35


def test_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_text('a,b\n1,"x\ny"\n2,\n')
    assert [tuple(r) for r in formats.read_any(spark, str(tmp_path / "a.csv")).collect()][0] == ("1", "x\ny", "a.csv", "csv")
    (tmp_path / "b.json").write_text('{"rows": [{"a": 1}, {"a": 2}]}')
    assert formats.read_any(spark, str(tmp_path / "b.json")).count() == 2
    (tmp_path / "c.jsonl").write_text('{"a": "z"}\n\n')
    both = formats.union_by_name([formats.read_any(spark, str(tmp_path / n)) for n in ("a.csv", "c.jsonl")])
    assert both.count() == 3 and "b" in both.columns
    with pytest.raises(ValueError, match="Unsupported"):
        formats.read_any(spark, "x.txt")
    m = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    with zipfile.ZipFile(tmp_path / "d.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {m}><sheets><sheet name="S" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<R xmlns="x"><Relationship Id="r1" Target="worksheets/s.xml"/></R>')
        z.writestr("xl/sharedStrings.xml", f"<sst {m}><si><t>name</t></si></sst>")
        z.writestr("xl/worksheets/s.xml", f'<worksheet {m}><sheetData><row/><row><c r="A2" t="s"><v>0</v></c><c r="B2" t="inlineStr"><is><t>n</t></is></c></row><row><c r="B3"><v>5</v></c></row></sheetData></worksheet>')
    assert [tuple(r)[:2] for r in formats.read_any(spark, str(tmp_path / "d.xlsx")).collect()] == [("", "5")]
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    with zipfile.ZipFile(tmp_path / "e.docx", "w") as z:
        z.writestr("word/document.xml", f"<w:d {w}><w:p><w:t>hello</w:t></w:p><w:tbl><w:tr><w:tc><w:p><w:t>a</w:t></w:p></w:tc><w:tc><w:p><w:t>b</w:t></w:p></w:tc></w:tr></w:tbl></w:d>")
    assert formats.read_docx(spark, str(tmp_path / "e.docx")).first().text == "hello\na\nb\na | b"
    (tmp_path / "f.pdf").write_bytes(b"BT (one) Tj ( ) Tj (two) Tj ET")
    assert formats.read_any(spark, str(tmp_path / "f.pdf")).first().text == "one\ntwo"
    sinks.write_jsonl(both, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 3
    assert formats.notebook_markdown("no") == "no" and formats.html_sections("<p>x</p><h2>T</h2>y")[1]["title"] == "T"


def test_stream_numbers_like_batch(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.repartition(1).write.parquet(str(tmp_path / "in"))
    live = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = S.sequenced(live).writeStream.format("memory").queryName("numbered").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    want = {(r.user_id, r.seq) for r in activity.sequenced(events, "user_id").collect()}
    assert {(r.user_id, r.seq) for r in spark.table("numbered").collect()} == want
    parts = spark.createDataFrame([("m", 2, "lo", None), ("m", 1, "hel", None), ("m", 3, None, "stop")], "message_id string, seq long, delta string, finish_reason string")
    assert tuple(S.merged_deltas(parts).first()) == ("m", "hello", "stop")
