"""Small expressions and operators, each on the values that tell its branches apart."""

import json

import pytest
from pyspark.sql import functions as F

from lodewright.functions import text as X
from lodewright.functions import values as V
from lodewright.operators import activity, conversations, evals, exchange
from lodewright.operators import listings as L
from lodewright.sources import apis, formats, sinks
from lodewright.streaming import events as S


def column(spark, make, values, kind="string"):
    return [r.y for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}").orderBy("i").select("i", make(F.col("x")).alias("y")).collect()]


def test_text_expressions(spark):
    assert column(spark, lambda c: X.truncated(c, 5), ["abcde", "abcd fg", None]) == ["abcde", "abcd...", None]
    assert column(spark, lambda c: X.head_and_tail(c, 8, 0.25), ["12345678", "abcdefghijkl"]) == ["12345678", "ab\n... [4 characters omitted] ...\nghijkl"]
    assert column(spark, X.slug, ["  My Data / v1.0 --x-", "..a..", "é"]) == ["my-data-v1.0-x", "a", ""]
    assert column(spark, X.safe_filename, ["a/b\\My file (1).CSV", "x.exe", "???.csv", "n" * 120 + ".json", "none"]) == ["My-file-1.csv", None, "dataset.csv", "n" * 91 + ".json", None]
    assert column(spark, X.session_filename, ["a/b c-1_é"]) == ["a_b_c-1__.json"]
    assert column(spark, X.without_ansi, ["\x1b[31mred\x1b[0m \x1b]x"]) == ["red x"]
    assert column(spark, X.plain_punctuation, ["‘a’ “b” – c — d​e"]) == ["'a' \"b\" - c - de"]
    assert column(spark, X.clean_description, ["a\t\tb\n \n\n c "]) == ["a b\n\n c"]
    assert column(spark, X.human_size, [5, 1536, 5 * 1024**3], "long") == ["5 B", "1.5 KB", "5.0 GB"]
    assert column(spark, X.argument_hash, ["{}"]) == ["99914b932bd3"]


SECRETS = [
    "plain text without anything", "hf_" + "a" * 30, "sk-ant-" + "b" * 20, "sk-" + "c" * 40, "ghp_" + "d" * 36, "github_pat_" + "e" * 36, "AKIA" + "A" * 16, "aws_secret_access_key = " + "f" * 30, "AccountKey=abc;x", "-----BEGIN PRIVATE KEY-----\nx\n-----END PRIVATE KEY-----",
    "BEARER " + "g" * 20, "1234 5678 9012", "ABCDE1234F", "22ABCDE1234F1Z5", "SBIN0123456", "a.b@c.org", "+91 98765 43210", "Invoice #AB-1234", "Customer name: Jane Doe", "address: 12 Main St", "at 12 Main St", "account no. 123456789", "PASSWORD=x", "paſſword=x", "", None,
]


def test_guarded_rewrites_are_the_plain_ones(spark):
    """Alone and together: a rewrite that is not run would have changed nothing."""
    from functools import reduce

    every = SECRETS + [" ".join(x or "" for x in SECRETS), "\n".join(x or "" for x in reversed(SECRETS))]
    plain = lambda c: F.regexp_replace(reduce(lambda x, r: F.regexp_replace(x, "(?U)" + r[1], r[2]), X.REDACTIONS, c), rf"(?Ui)\b({X.SECRET_NAMES})\s*+[:=]\s*+(?!\[REDACTED_)[^\s\"']+", "$1=[REDACTED_SECRET]")
    got = column(spark, X.redacted, every)
    assert got == column(spark, plain, every) and [g == e for g, e in zip(got, every)].count(True) == 3
    assert set(X.NEEDS) == {r[0] for r in X.REDACTIONS} | {"secret"}


def test_values(spark):
    assert column(spark, V.non_negative, ["5", "-1", "x", None]) == [5, None, None, None]
    assert column(spark, V.fraction, ["0.5", "7", "-1", "x"]) == [0.5, 1.0, 0.0, None]
    assert column(spark, V.score, ["55", "500", "-3", "x"]) == [55, 100, 0, 0]
    assert column(spark, lambda c: V.confidence(c, 0.65, 0.84), [10, 70, 99], "int") == [0.65, 0.7, 0.84]
    assert column(spark, lambda c: V.higher_risk(c, F.lit("medium")), ["low", "medium", "high"]) == ["medium", "medium", "high"]
    assert column(spark, V.shown_date, ["2026-01-02T03:04:05", "soon", None]) == ["2026-01-02 03:04:05", "soon", "N/A"]


def test_variables_in_texts(spark):
    given = F.create_map(F.lit("A"), F.lit("x$1"), F.lit("B"), F.lit("${A}"))
    texts = ["no mark", "${A}/${B}", "${C:-dflt}!", "${C:-}", None, "a${A}b${A}", "$A {A}"]
    assert column(spark, lambda c: V.substituted(c, given), texts) == ["no mark", "x$1/${A}", "dflt!", "", None, "ax$1bx$1", "$A {A}"]
    for text in ("${C}", "${C:x}"):
        with pytest.raises(Exception, match="variable not set: C"):
            column(spark, lambda c: V.substituted(c, given), [text])


def test_json_files_and_required_columns(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"data": [{"a": 1}, null, {"a": 2}], "rows": 5}')
    (tmp_path / "b.json").write_text('{"rows": [1, 2]}')
    (tmp_path / "c.json").write_text('{"x": 1}')
    (tmp_path / "d.json").write_text("5")
    assert [r.a for r in formats.read_json(spark, str(tmp_path / "a.json")).collect()] == [1, 2]
    assert formats.read_json(spark, str(tmp_path / "b.json")).count() == 0 and formats.read_json(spark, str(tmp_path / "c.json")).first().x == 1
    with pytest.raises(Exception):
        formats.read_json(spark, str(tmp_path / "d.json")).collect()
    (tmp_path / "q.csv").write_text('"a,b","c\nd",c\n1,2,3,4\n')
    assert [tuple(r) for r in formats.read_csv(spark, str(tmp_path / "q.csv")).collect()] == [("1", "2", "3")]
    assert formats.read_csv(spark, str(tmp_path / "q.csv")).columns == ["a,b", "c\nd", "c"]


def test_scripts_and_tags(spark):
    assert column(spark, L.push_to_hub, ["push_to_hub = TRUE", "push_to_hub=false", "x", None]) == [True, False, False, False]
    assert [bool(x) for x in column(spark, L.save_warning, ["m.from_pretrained('x')", "from_pretrained push_to_hub", "x"])] == [True, True, False]
    assert column(spark, L.shown_tags, [["arxiv:1", "a", "region:us", "b", "c", "d", "e", "f"]], "array<string>") == [["a", "b", "c", "d", "e"]]
    assert column(spark, L.names_holdout, ["data/test/x", "contest", "my-eval", "a\\valid\\b"]) == [True, False, True, True]


def test_runtime_states_and_approvals(spark):
    rows = [(True, True, True), (False, True, True), (False, False, True), (False, False, False)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, p boolean, q boolean, e boolean").orderBy("i")
    assert [r.s for r in df.select(activity.runtime_state(F.col("p"), F.col("q"), F.col("e")).alias("s")).collect()] == ["waiting_approval", "processing", "ended", "idle"]
    fields = ("profile_known", "blocked", "smoke_failed", "scheduled", "required", "automatic", "cost", "remaining", "budgeted")
    calls = [
        ((True, True, True, True, True, True, 1.0, 5.0, True), "block_trainability"), ((False, False, True, False, True, True, 1.0, 5.0, True), "block_no_profile"), ((True, False, True, True, True, True, 1.0, 5.0, True), "block_smoke"), ((True, False, False, True, False, True, 1.0, 5.0, True), "ask_scheduled"),
        ((True, False, False, False, False, False, None, 0.0, True), "allow"), ((True, False, False, False, True, False, 1.0, 5.0, True), "ask"), ((True, False, False, False, True, True, None, 5.0, True), "ask_unknown_cost"), ((True, False, False, False, True, True, 6.0, 5.0, True), "ask_over_cap"),
        ((True, False, False, False, True, True, 5.0, 5.0, True), "allow_auto"), ((True, False, False, False, True, True, None, 5.0, False), "allow_auto"), ((True, False, False, False, True, True, 6.0, None, True), "allow_auto"), ((True, None, None, None, True, True, 6.0, 5.0, None), "allow_auto"),
    ]
    kinds = ", ".join(f"{f} {'double' if f in ('cost', 'remaining') else 'boolean'}" for f in fields)
    df = spark.createDataFrame([(i, *c) for i, (c, _) in enumerate(calls)], f"i int, {kinds}").orderBy("i")
    assert [r.d for r in df.select(activity.approval(*(F.col(f) for f in fields)).alias("d")).collect()] == [want for _, want in calls]


def test_refunds_never_go_below_none(spark):
    rows = [(i, 1, f"2026-01-01 00:00:{i:02d}", r) for i, r in enumerate([True, False, False, True, True, True, None, False])] + [(9, 1, "2026-01-02 00:00:00", False), (10, 2, "2026-01-01 00:00:00", True)]
    df = spark.createDataFrame(rows, "mark_id int, user_id int, t string, refund boolean").withColumn("ts", F.col("t").cast("timestamp"))
    assert [r.used for r in activity.quota_balance(df).orderBy("mark_id").collect()] == [0, 1, 2, 1, 0, 0, 1, 2, 1, 0]


def test_sampled_values_are_cut_at_any_depth(spark):
    from lodewright.operators import profile as P

    long = "x" * 200
    df = spark.createDataFrame([(1, long, [(long, {"k" * 200: long})], None)], "i int, a string, b array<struct<c:string,d:map<string,string>>>, e struct<f:string>")
    r = P.sample(df, "i").first()
    cut = "x" * 150 + "..."
    assert (r.a, r.b[0].c, r.b[0].d, r.e) == (cut, cut, {"k" * 200: cut}, None) and P.sample(df.limit(0), "i").count() == 0


def test_conversation_views(spark):
    turns = spark.createDataFrame([(1, 0, "system", "s"), (1, 1, "user", " [SYSTEM: go on]"), (1, 2, "user", "hi"), (1, 3, "tool", "t"), (1, 4, "assistant", "a")], "conv_id int, turn int, role string, text string")
    assert [r.turn for r in conversations.visible(turns).orderBy("turn").collect()] == [2, 4]
    assert [r.turn for r in conversations.compacted(turns, 2).orderBy("turn").collect()] == [0, 1, 2, 3, 4]
    logs = spark.createDataFrame([(1, "a\nDownloading 1\nDownloading 2\r 50%| x\r\nb\r\n\nc")], "log_id int, text string")
    assert [r.line for r in conversations.log_lines(logs).orderBy("n").collect()] == ["a", " 50%| x", "b", "", "c"]


def test_examples_and_formats(spark):
    rows = spark.createDataFrame([(0, "p", "", "c", None), (1, None, "i", None, "o")], "row_index int, prompt string, instruction string, completion string, output string")
    assert [r.formatted for r in evals.formatted(rows, ("prompt", "instruction"), ("completion", "output")).orderBy("row_index").collect()] == ["### User\np\n\n### Assistant\nc", "### User\ni\n\n### Assistant\no"]
    forms = spark.createDataFrame([(0, "ITR-1", "Return", "Simple income return", "31 July"), (1, None, " ", None, None)], "row_index int, `Form No` string, Category string, Purpose string, `Due Dates` string")
    got = evals.form_examples(forms, "Answer from the table.").orderBy("row_index", "pos").collect()
    assert len(got) == 12 and [r.qa_type for r in got[:6]] == ["purpose", "applicability", "filing_timeline", "regime", "efiling_mapping", "summary"]
    assert [m.content for m in got[0].messages] == ["Answer from the table.", "What is ITR-1 used for?", "ITR-1 is used for Simple income return."]
    assert got[2].messages[2].content == f"ITR-1 has {X.SENTINEL} filing frequency. The due date is 31 July." and got[6].messages[1].content == f"What is {X.SENTINEL} used for?"


def test_card_sections(spark):
    made = json.dumps({"base_model": "m", "dataset": {"path": "a.csv", "row_count": 5}, "training": {"method": "sft", "timeout": " "}, "trainability": {"risk_level": "low"}, "golden_eval": {"case_count": 25}, "limitations": ["small", " "]})
    card = column(spark, sinks.card, [made, "{}"])
    assert card[0] == (
        "# Model Provenance\n\n## Source\n- Base model: m\n- Dataset: a.csv\n- Row count: 5\n\n## Training\n- Method: sft\n- Hardware: Not specified\n- Timeout: Not specified\n\n## Quality Intelligence\n"
        "- Trainability Risk: low\n- Strategy Recommendation: Not specified\n- Golden Eval: 25 cases\n- Post-Training Eval: Not specified\n\n## Limitations\n- small"
    )
    assert card[1].endswith("## Limitations\n- Not specified.") and column(spark, lambda c: sinks.card(c, "dataset"), ["{}"])[0].startswith("# Dataset Provenance")


def test_sessions_as_files_and_frames(spark, tmp_path):
    rows = spark.createDataFrame([("a", "2026-01-01 10:00:00", [1], "pending"), ("b", "2026-01-02 10:00:00", None, "success")], "session_id string, created_at string, events array<int>, upload_status string")
    sinks.write_trajectories(rows, str(tmp_path / "t"))
    assert [(r.session_id, r.events, str(r.date)) for r in spark.read.json(str(tmp_path / "t")).orderBy("session_id").collect()] == [("a", "[1]", "2026-01-01"), ("b", None, "2026-01-02")]
    assert [r.session_id for r in sinks.pending_uploads(rows).collect()] == ["a"]
    frames = sinks.sse(spark.createDataFrame([("a", 3, "x", "{}")], "session_id string, seq long, event_type string, data string")).first()
    assert frames.frame == 'id: 3\ndata: {"event_type":"x","data":"{}","seq":3}\n\n'


def test_endpoints_name_their_parameters(spark):
    spec = {"paths": {"/a": {"get": {"parameters": [{"name": "q", "in": "query"}, {"in": "path"}, {"name": "id"}]}, "post": {}, "x-y": {}}}}
    got = {r.method: r.param_names for r in apis.endpoints(spark.createDataFrame([(json.dumps(spec),)], "spec string")).collect()}
    assert got == {"GET": "q id", "POST": ""}


def test_restored_calls_and_seeds(spark):
    flat, whole = '{"tool_call_id": "c\\"1", "tool": "run", "arguments": {"a": 1}}', '{"id": "c2", "type": "function", "function": {"name": "f", "arguments": "{}"}}'
    got = column(spark, exchange.restored_calls, [[flat, whole, '{"tool": "x"}', "no", None], ["{}"], None], "array<string>")
    assert [json.loads(x) for x in got[0]] == [{"id": 'c"1', "type": "function", "function": {"name": "run", "arguments": '{"a":1}'}}, json.loads(whole)] and got[1:] == [None, None]
    rows = ['{"role": "system", "content": "s"}', '{"role": "user", "content": "u"}', '{"role": "assistant", "content": null}', '{"role": "robot", "content": "x"}', '{"role": "user", "content": 5}', "no", None, '{"role": "tool", "content": [{"type": "text"}]}']
    messages = spark.createDataFrame([(i, m) for i, m in enumerate(rows)], "i int, message string")
    assert sorted(r.i for r in exchange.seeds(messages).collect()) == [1, 2, 7]


def test_links_listings_and_contexts(spark):
    texts = ["tune on https://hub.example/datasets/own/set now, see https://hub.example/jobs/me/12)", "use own/data.v1 please https://x.y/a/b", "AUTO_FINETUNE_MODEL_URL=https://hub.example/me/model done", None, "nothing"]
    got = [r and tuple(r) for r in column(spark, lambda c: exchange.found_links(c, "hub.example"), texts)]
    assert got[0] == ("own/set", "https://hub.example/jobs/me/12", None) and got[1][0] == "own/data.v1" and got[2] == (None, None, "https://hub.example/me/model") and got[3:] == [(None, None, None)] * 2
    files = spark.createDataFrame([("b",), ("a/2",), ("a/1",), (None,)], "path string")
    assert [r.path for r in exchange.listed_files(files, "a/").collect()] == ["a/1", "a/2"]
    talks = spark.createDataFrame([(i, f"t{i}", None if i == 1 else "closed", i % 2 == 0) for i in range(30)], "num int, title string, status string, is_pull_request boolean")
    shown = exchange.discussions(talks, 29).collect()
    assert [r.num for r in shown] == list(range(29, 0, -1)) and (shown[-1].label, shown[0].label, shown[1].label) == ("discussion (open)", "discussion (closed)", "PR (closed)")
    both = exchange.composite({"guide": files.limit(1), "api": talks.select("num").limit(2)})
    assert both.count() == 3 and {(r.part, r.place) for r in both.collect()} == {("guide", 0), ("api", 1)}
    df = spark.createDataFrame([(0, "Support", "HF", "own/set", ["do x"], []), (1, "Support", "HF", None, [], ["h1", "h2"]), (2, " ", "HF", None, [], [])], "i int, label string, provider string, dataset string, steps array<string>, hints array<string>").orderBy("i")
    made = [r.t for r in df.select(exchange.rendered_context(F.col("label"), F.col("provider"), F.col("dataset"), {"": F.col("steps"), "Evaluation hints": F.col("hints")}).alias("t")).collect()]
    assert made == ["Selected ML workflow context:\n- Domain: Support\n- Compute provider: HF\n- Dataset repo: own/set\n- do x", "Selected ML workflow context:\n- Domain: Support\n- Compute provider: HF\nEvaluation hints:\n- h1\n- h2", ""]


def test_streams_fan_out_and_count_days(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    live = lambda: spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    seen = {"a": 0, "b": 0}

    def sink(name):
        def write(batch, _):
            seen[name] += batch.count()

        return write

    S.fan_out(live(), {n: sink(n) for n in seen}, str(tmp_path / "c1")).trigger(availableNow=True).start().awaitTermination(120)
    assert seen == {"a": events.count(), "b": events.count()}
    S.daily_counts(live()).writeStream.outputMode("complete").format("memory").queryName("days").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start().awaitTermination(120)
    want = events.groupBy("user_id", F.to_date("ts").alias("day")).count()
    assert sorted(map(tuple, spark.table("days").collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
