"""Training-script rules, event streams, chat parts, sections, links, notes, job tables and field search on small cases."""

import json

import pytest
from pyspark.sql import functions as F

from lodewright.operators import evals
from lodewright.operators import exchange as E
from lodewright.operators import lookup
from lodewright.operators import training as T

SYNC = "rank_pattern: Cannot write struct type in integration_utils.py"


def value(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def lit(x):
    return F.lit(x).cast("string")


@pytest.mark.parametrize("text, wanted", [("please Fine-Tune it", True), ("run SFT", True), ("finetuned", False), ("", False), (None, False)])
def test_wants_finetune(spark, text, wanted):
    assert value(spark, T.wants_finetune(lit(text))) == (wanted,)


@pytest.mark.parametrize(
    "operation, parts, wanted",
    [
        (" RUN ", ["python train.py"], True), ("uv", ["x", None, "SFTTrainer(...)"], True), ("submit", ["pip", "trl"], True),
        ("ps", ["train.py"], False), ("run", ["constraint.py"], False), ("run", [], False), (None, ["train.py"], False),
    ],
)
def test_starts_training(spark, operation, parts, wanted):
    assert value(spark, T.starts_training(lit(operation), F.array(*(lit(p) for p in parts)).cast("array<string>"))) == (wanted,)


def test_known_error_needs_every_sign_and_a_place(spark):
    assert value(spark, T.known_error(lit(SYNC)), T.known_error(lit("rank_pattern trackio")), T.known_error(lit(None))) == (T.SYNC_FAILURE, None, None)


@pytest.mark.parametrize(
    "script, log, wanted",
    [
        ("SFTConfig(max_seq_length=9)", "unexpected max_seq_length", "SFTConfig(max_length=9)"),
        ("a(evaluation_strategy='no')", "EVALUATION_STRATEGY", "a(eval_strategy='no')"),
        ("SFTTrainer(tokenizer=tokenizer)", "SFTTrainer got tokenizer", "SFTTrainer(processing_class=tokenizer)"),
        ("i(project_name=1, run_name=2)", "bad run_name", "i(project=1, name=2)"),
        ('import trackio\nx = 1\ntrackio.init(a=1)\ny(report_to=["trackio"])\n', SYNC, "x = 1\ny(report_to=[])\n"),
        ('deps = ["trackio", "trl"]', SYNC, 'deps = ["trl"]'),
        ("x = 1", SYNC, None),
        ("max_seq_length=1", "out of memory", None),
        (None, SYNC, None),
        ("x", None, None),
    ],
)
def test_repaired_script(spark, script, log, wanted):
    assert value(spark, T.repaired_script(lit(script), lit(log))) == (wanted,)


def test_dependencies(spark):
    deps = F.array(F.lit("trl"), F.lit(" Trackio "), F.lit("trackio-extra"))
    assert value(spark, T.kept_dependencies(deps, lit(SYNC)), T.kept_dependencies(deps, lit("other"))) == (["trl", "trackio-extra"], ["trl", " Trackio ", "trackio-extra"])
    for name, wanted in (("trackio", True), ("Trackio[all]>=1", True), ("trackio ; python_version>'3'", True), ("trackio-extra", False), ("mytrackio", False)):
        assert value(spark, T.depends_on(F.array(F.lit(name)))) == (wanted,)
    assert value(spark, T.depends_on(F.lit(None).cast("array<string>"))) == (False,)


@pytest.mark.parametrize(
    "given, status, issues",
    [
        ({"status": "pass", "issues": [{"severity": "ERROR", "code": "c", "message": "m", "line": 3}]}, "fail", [("error", "c", "m", 3)]),
        ({"status": "pass", "issues": [{"severity": "warning", "line": "3"}]}, "warn", [("warning", "script_smoke_issue", "Script smoke issue.", None)]),
        ({"status": "fail", "issues": [{"severity": "warning"}]}, "fail", [("warning", "script_smoke_issue", "Script smoke issue.", None)]),
        ({"status": "fail", "issues": []}, "fail", []),
        ({"status": "odd", "issues": ["x", {"severity": "info"}]}, "pass", []),
        ({}, "pass", []),
    ],
)
def test_checked_script(spark, given, status, issues):
    got = value(spark, T.checked_script(lit(json.dumps(given))))[0]
    assert (got.status, [tuple(i) for i in got.issues]) == (status, issues)


def test_case_summary_and_model_calls(spark):
    cases = spark.createDataFrame([("a",), ("b",), ("a",), ("",), (None,)], "task_type string")
    assert tuple(T.case_summary(cases).first()) == (5, ["a", "b"])
    assert tuple(T.case_summary(cases.limit(0)).first()) == (0, [])
    events = spark.createDataFrame([("llm_call", '{"model":"m","latency_ms":5,"cost_usd":0.5}'), ("llm_call", '{"model":"m","kind":"main"}'), ("other", "{}")], "event_type string, data string")
    assert [tuple(r) for r in T.model_calls(events).collect()] == [("m", "main", 2, 5, 0.5, 0)]


def test_stream_events(spark):
    text = ': hi\nid: 4\ndata: {"event_type": "a",\r\ndata: "x": 1}\r\n\n\n\ndata: {"seq": 9}\n\ndata: {bad\n\nid: 7\n\ndata: 3\nid: 8'
    rows = spark.createDataFrame([(1, text), (2, ""), (3, None)], "k int, text string")
    got = E.stream_events(rows, "k").orderBy("k", "pos").select("k", "seq", "event_type", "body").collect()
    assert [tuple(r) for r in got] == [(1, 4, "a", '{"event_type": "a",\n"x": 1}'), (1, 9, None, '{"seq": 9}'), (1, 8, None, "3")]


def test_turns_of(spark):
    part = lambda **k: {n: k.get(n) for n in ("type", "text", "toolCallId", "toolName", "input", "output", "errorText")}
    rows = [
        (1, 0, "user", [part(type="text", text="a"), part(type="file"), part(type="text", text="b")]),
        (1, 1, "assistant", [part(type="text", text="c"), part(type="tool-read", toolCallId="x", input='{"p":1}', output="done"), part(type="dynamic-tool", toolCallId="y", toolName="run", errorText="no"), part(type="tool-z", toolCallId="w"), part(type="dynamic-tool", toolCallId="q")]),
        (1, 2, "user", []), (1, 3, "system", [part(type="text", text="s")]), (1, 4, "assistant", []), (1, 5, "user", None),
    ]
    shape = "k int, pos int, role string, parts array<struct<type:string,text:string,toolCallId:string,toolName:string,input:string,output:string,errorText:string>>"
    got = E.turns_of(spark.createDataFrame(rows, shape), "k").orderBy("pos", "sub").collect()
    assert [(r.pos, r.role, r.content, [tuple(c) for c in r.tool_calls or []], r.tool_call_id) for r in got] == [
        (0, "user", "ab", [], None), (1, "assistant", "c", [("x", "read", '{"p":1}'), ("y", "run", "{}"), ("w", "z", "{}")], None),
        (1, "tool", "done", [], "x"), (1, "tool", "no", [], "y"),
    ]


@pytest.mark.parametrize("query, wanted", [("4.1", "4.1"), (" results ", "5"), ("RESULT", "5"), ("4", "4.1"), ("S4", None), ("method", "4.1"), ("nothing", None), (None, None)])
def test_found_section(spark, query, wanted):
    pairs = [("4.1", "Our Method"), ("S4.2", "More"), ("5", "Results"), ("6", "Results of others"), ("7", None)]
    sections = F.array(*(F.struct(F.lit(i).alias("id"), lit(t).alias("title")) for i, t in pairs))
    assert value(spark, E.found_section(sections, lit(query))["id"]) == (wanted,)


def test_providers_and_trees_and_refs(spark):
    entry = '{"id": "m", "providers": [{"provider": "p", "status": "live", "context_length": 8, "pricing": {"input": 0.5}}, {}]}'
    got, none = value(spark, E.providers(lit(entry)), E.providers(lit("{}")))
    assert [tuple(p) for p in got] == [("p", "live", 8, 0.5, None, False, False), ("", "", None, None, None, False, False)] and none == []
    tree = spark.createDataFrame([("a", "blob", "s", None, "u"), ("d", "tree", "t", 1, "v")], "path string, type string, sha string, size long, url string")
    assert [tuple(r) for r in E.tree_files(tree).collect()] == [("a", "s", 0, "u")]
    assert value(spark, E.refs_text(F.array(F.lit("main"), F.lit("dev")), F.lit(None).cast("array<string>"))) == ("**Branches (2):** main, dev\n**Tags:** none",)


@pytest.mark.parametrize(
    "url, job, model",
    [
        ("https://hub.example/jobs/a/1.", "https://hub.example/jobs/a/1", None), (" https://hub.example/o/m! ", None, "https://hub.example/o/m"),
        ("https://hub.example.evil/o/m", None, None), ("http://hub.example/o/m", None, None), ("https://hub.example/datasets/o", None, None),
        ("https://hub.example/o", None, None), ("https://hub.example/o/m?x=1", None, "https://hub.example/o/m?x=1"), (None, None, None),
    ],
)
def test_links(spark, url, job, model):
    assert value(spark, E.job_link(lit(url), "hub.example"), E.model_link(lit(url), "hub.example")) == (job, model)


def test_noted_workflow(spark):
    noted = lambda t: tuple(value(spark, E.noted_workflow(lit(t), {"generic": "Generic", "tax": "Tax"}, {"own": "Own", "far": "Far Jobs"}))[0])
    assert noted("Vertical: TAX\nCompute provider: far jobs\n  - Dataset repo: a/b:c \n- dataset repo: z") == ("tax", "far", "a/b:c")
    assert noted("- dataset repo:\nnext") == ("generic", "own", None) and noted(None) == ("generic", "own", None)


def test_job_lines(spark):
    jobs = spark.createDataFrame([(1, "a" * 8, "i" * 25, None, "2024-01-01 00:00:00", "RUNNING")], "n int, id string, image string, command string, created string, status string")
    lines = [r.line for r in E.job_lines(jobs, "n").orderBy("head", "ord").collect()]
    assert lines == [
        f"| {'JOB ID':8} | {'IMAGE/SPACE':20} | {'COMMAND':30} | {'CREATED':19} | {'STATUS':12} |",
        "|" + "|".join("-" * (n + 2) for n in (8, 20, 30, 19, 12)) + "|",
        f"| {'a' * 8} | {'i' * 17}... | {'':30} | 2024-01-01 00:00:00 | {'RUNNING':12} |",
    ]
    assert [r.line for r in E.job_lines(jobs.limit(0), "n").collect()] == ["No jobs found."]


def test_field_search(spark):
    rows = spark.createDataFrame(
        [("/a", "GET", "List models", "x", None, "hub models", ""), ("/a", "POST", "Upload", "createModel", "modelling of files", "hub", "model"), ("/b", "GET", "Other", "", "", "misc", "")],
        "path string, method string, summary string, operation_id string, description string, tags string, param_names string",
    )
    find = lambda q, tag=None, k=20: [(r.path, r.method) for r in lookup.field_search(rows, lookup.ENDPOINT_FIELDS, q, k, lookup.tagged(tag)).collect()]
    assert find("models") == [("/a", "GET"), ("/a", "POST")]
    # the filter comes before the limit
    assert find("models other", "isc", 1) == [("/b", "GET")]
    assert find("... !") == [] and find("absent") == []
    assert lookup.field_search(rows.limit(0), lookup.ENDPOINT_FIELDS, "models").count() == 0


@pytest.mark.parametrize("word, wanted", [("models", "model"), ("queries", "query"), ("training", "train"), ("classes", "class"), ("boxes", "box"), ("class", "class"), ("status", "status"), ("sing", "sing"), ("uploaded", "upload")])
def test_stem(spark, word, wanted):
    assert value(spark, lookup.stem(lit(word))) == (wanted,)


def test_golden_cases_by_kind_of_table(spark):
    turn = lambda *pairs: [{"role": r, "content": c} for r, c in pairs]
    rows = [
        (0, turn(("assistant", "hello"), ("user", "a"), ("system", "s"), ("user", " b "), ("assistant", " c "), ("tool", "t"), ("user", "d"))),
        (1, turn(("assistant", "x"), ("user", "y"))), (2, turn(("user", "q"), ("assistant", " "))), (3, []), (4, None), (5, turn(("user", "u" * 300), ("assistant", "v"))),
    ]
    df = spark.createDataFrame(rows, "row_index long, Messages array<struct<role:string,content:string>>")
    assert [tuple(r) for r in evals.golden_cases(df).collect()] == [("sft_reference_eval:0:messages", "b", "c"), ("sft_reference_eval:5:messages", "u" * 240 + "...", "v")]
    assert evals.golden_cases(df, limit=1).count() == 1 and evals.golden_cases(df.limit(0)).count() == 0
    pairs = spark.createDataFrame([(0, "i", "o"), (1, "", "o")], "row_index long, Instruction string, output string")
    assert [tuple(r) for r in evals.golden_cases(pairs).collect()] == [("sft_reference_eval:0:prompt_completion", "i", "o")]
    assert evals.golden_cases(pairs.select("row_index")).count() == 0
