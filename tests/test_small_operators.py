"""Evaluation gates, plans and caps, call loops, line ranges, names, titles, scripts and logs on small expected results."""

import pytest
from pyspark.sql import functions as F

from lodewright.operators import activity, conversations, evals
from lodewright.operators import listings as L

FORMS = [
    (0, "ITR-1", "Income Tax Return", "Simple income return", "31 July", "Both"), (1, "Form 16", "TDS certificate", "Salary TDS certificate", "15 June", "Both"),
    (2, "Form 10E", "Relief", "Salary arrear relief", "", None), (3, "Form 49B", "TAN", "TAN application", "", ""),
]
KIND = "row_index long, `Form No` string, Category string, Purpose string, `Due Dates` string, `Old/New Regime Applicability` string"


@pytest.fixture(scope="module")
def cases(spark):
    return evals.reference_cases(spark.createDataFrame(FORMS, KIND), source={"type": "local_file", "path": "Income_Tax_Master.xlsx"})


def asked(cases, question):
    return cases.where(F.col("question") == question).first()


def rated(spark, cases, outputs):
    """Outputs by question -> (status by question, overall)."""
    rows = cases.where(F.col("question").isin(*outputs))
    said = spark.createDataFrame([(asked(cases, q).case_id, o) for q, o in outputs.items()], "case_id string, output string")
    got = evals.score_outputs(rows, said)
    ids = {r.case_id: r.question for r in rows.collect()}
    return {ids[r.case_id]: r for r in got.collect()}, evals.status_counts(got).first().overall


ITR, RELIEF, TAN = "What is ITR-1 used for?", "What is Form 10E used for?", "Which form is used for TAN application?"


def test_reference_tables_make_grounded_cases(spark, cases):
    assert [asked(cases, q).expected for q in (ITR, RELIEF, TAN, "What due date is listed for Form 10E?", "What regime applicability is listed for Form 10E?")] == ["Simple income return", "Salary arrear relief", "Form 49B"] + ["Not specified in the source table"] * 2
    assert asked(cases, ITR).domain == "income_tax" and cases.count() == 16
    rows = spark.createDataFrame([(0, "", "Salary TDS certificate", "15 June"), (1, "ITR-1", "", "31 July"), (2, "Form 16", "Salary TDS certificate", "")], "row_index long, `Form No` string, Purpose string, `Due Dates` string")
    assert [r.question for r in evals.reference_cases(rows).collect()] == ["What due date is listed for ITR-1?", "What is Form 16 used for?", "Which form is used for Salary TDS certificate?", "What due date is listed for Form 16?"]
    assert [r.question for r in evals.reference_cases(rows, 1).collect()] == ["What due date is listed for ITR-1?"]


def test_generic_tables_prefer_keys_and_answers_in_order(spark):
    rows = spark.createDataFrame([(0, "80C", "r1", "cap"), (1, None, "r2", "x"), (2, "80D", " ", "y")], "row_index long, Section string, Rule string, Limit string")
    assert [(r.case_id, r.question, r.expected) for r in evals.golden_cases(rows).collect()] == [("structured_reference_qa:0:lookup", "What limit is listed for 80C?", "cap"), ("structured_reference_qa:2:lookup", "What limit is listed for 80D?", "y")]
    only = rows.select("row_index", F.col("Section").alias("Name"), F.col("Rule").alias("x"))
    assert evals.golden_cases(only).count() == 0 and evals.golden_cases(rows.select("row_index", F.col("Rule"))).count() == 0 and evals.golden_cases(rows.limit(0)).count() == 0
    assert [r.expected for r in evals.golden_cases(rows.select("row_index", F.col("Section").alias("Rule"), F.col("Limit").alias("Rate"))).collect()] == ["cap", "y"]


def test_holdout_only_for_explicit_sources(spark):
    pair = spark.createDataFrame([(0, "Explain section 80D.", "It covers premiums.")], "row_index long, prompt string, completion string")
    ids = [evals.golden_cases(pair, source=s).first().case_id for s in ({"split": "validation"}, {"path": "data/test/x.csv"}, {"path": "contest.csv"}, None)]
    assert [x.split(":")[0] for x in ids] == ["sft_holdout", "sft_holdout", "sft_reference_eval", "sft_reference_eval"]


@pytest.mark.parametrize("outputs,statuses,overall", [
    ({ITR: "ITR-1 is used for a simple income return.", RELIEF: "Form 10E is used for salary arrear relief.", TAN: "Form 49B is used for TAN application."}, ["passed"] * 3, "passed"),
    ({ITR: "ITR-1 is a chemistry worksheet about acids, bases, catalysts, and laboratory reactions."}, ["failed"], "failed"), ({RELIEF: "Form 10E is a U.S. W-2 wage statement used by employers."}, ["failed"], "failed"),
    ({TAN: "A TAN application is submitted on the e-filing portal."}, ["failed"], "failed"), ({ITR: "ITR-1 is used for a simple income return. It also guarantees an automatic tax refund."}, ["failed"], "failed"),
    ({RELIEF: "Form 10E provides relief for salary arrears based on the source."}, ["passed"], "passed"), ({ITR: "Based on the provided context, ITR-1 is used for a simple income return."}, ["passed"], "passed"),
    ({ITR: "ITR-1 is used for a simple income return.", RELIEF: "I need retrieval context before answering Form 10E.", TAN: "A TAN application is submitted on the e-filing portal."}, ["passed", "needs_rag", "failed"], "failed"),
    ({ITR: None, RELIEF: " "}, ["needs_more_data"] * 2, "needs_more_data"), ({ITR: "I do not know", RELIEF: None}, ["needs_rag", "needs_more_data"], "needs_more_data"), ({ITR: "I don't know", RELIEF: "Form 10E is used for salary arrear relief."}, ["needs_rag", "passed"], "needs_rag"),
])
def test_gate(spark, cases, outputs, statuses, overall):
    got, all_ = rated(spark, cases, outputs)
    assert [got[q].status for q in outputs] == statuses and all_ == overall


def test_gate_tells_what_is_wrong(spark, cases):
    got, _ = rated(spark, cases, {ITR: "ITR-1 is a chemistry worksheet about acids.", RELIEF: "Form 10E is a U.S. W-2 wage statement.", TAN: "A TAN application."})
    assert got[ITR].topics == ["chemistry"] and got[ITR].score == 0.0 and "off-topic" in " ".join(got[ITR].reasons)
    assert "w-2" in got[RELIEF].topics and "missing expected facts" in " ".join(got[RELIEF].reasons) and got[TAN].missing_facts == ["Form 49B"]
    one, _ = rated(spark, cases, {ITR: "ITR-1 is used for a simple income return. It also guarantees an automatic tax refund."})
    assert (one[ITR].score, one[ITR].missing_facts) == (1.0, []) and "unsupported claims" in " ".join(one[ITR].reasons)


def test_summary_is_verified(spark, cases):
    all_ = evals.score_outputs(cases, spark.createDataFrame([], "case_id string, output string"))
    r = evals.eval_summary(all_).first()
    assert (r.status, r.valid, r.cases, r.needs_more_data, r.top_reasons) == ("needs_more_data", True, 16, 16, ["no output was given"])
    told = evals.status_counts(all_).withColumn("passed", F.lit(16).cast("long"))
    assert evals.eval_summary(all_, told).first().status == "unverified"
    assert evals.eval_summary(all_.limit(0)).first().status == "needs_more_data"


def column(spark, make, values, kind="string"):
    return [r.y for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}").orderBy("i").select("i", make(F.col("x")).alias("y")).collect()]


def test_plans_and_caps(spark):
    rows = [("PRO", None, None), (None, True, ["team"]), ("", True, None), ("user", True, None), ("user", False, ["My Enterprise hub"]), (None, None, ["free", None]), ("team", None, None), (None, None, None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, kind string, pro boolean, orgs array<string>")
    assert [r.p for r in df.orderBy("i").select("i", L.plan_of(F.col("kind"), F.col("pro"), F.col("orgs")).alias("p")).collect()] == ["pro", "pro", "pro", "free", "org", "free", "pro", "free"]
    assert column(spark, activity.cap_for, ["free", "pro", "org", None, "", "mystery"]) == [1, 20, 20, 1, 1, 20]


def test_call_loops_by_place_and_messages(spark):
    kind = "conv_id int, turn int, place int, name string, arguments string"
    rows = [(1, t, p, "ba"[p], "{}") for t in (0, 2) for p in (0, 1)] + [(2, t, 0, "x", "{}") for t in (0, 1, 40)] + [(3, 5, p, "y", None) for p in range(3)] + [(4, t, 0, "abcab"[t], "{}") for t in range(5)]
    calls = spark.createDataFrame(rows, kind)
    turns = spark.createDataFrame([(c, t) for c, n in ((1, 4), (2, 60), (3, 6), (4, 5)) for t in range(n)], "conv_id int, turn int")
    names = lambda p: [x.split(":")[0] for x in p.split(" ")]
    got = {r.conv_id: (r.kind, names(r.pattern)) for r in conversations.repeated_calls(calls, turns).collect()}
    assert got == {1: ("repeating", ["b", "a"]), 3: ("identical", ["y"])}
    assert {r.conv_id for r in conversations.repeated_calls(calls.where("turn < 5"), lookback=2).collect()} == set()
    long = [(9, t, 0, "z", "{}") for t in range(3)]
    far = spark.createDataFrame([(9, t) for t in range(40)], "conv_id int, turn int")
    assert conversations.repeated_calls(spark.createDataFrame(long, kind), far).count() == 0


def test_line_ranges(spark):
    text = ["\n".join(str(i) for i in range(1, 1001))]
    n = lambda *a: len(column(spark, lambda c: L.lines(c, *a), text, "string")[0] or [])
    assert [n(1, 1000), n(), n(-5, 2), n(990, None), n(None, 7), n(1001, None), n(5, 4)] == [1000, 300, 2, 11, 7, 0, 0]
    assert column(spark, lambda c: F.struct(L.line_count(c), L.lines(c, 1001)), text)[0] == (1000, None)


def test_names_titles_scripts(spark):
    files = spark.createDataFrame([(1, i, n) for i, n in enumerate(["a.csv", "a.csv", "a-2.csv", "a.csv", "b", "b", ".x", ".x"])] + [(2, 0, "a.csv")], "up int, ord int, name string")
    got = {(r.up, r.ord): r.unique_name for r in L.unique_names(files, "up", "name", "ord").collect()}
    assert [got[1, i] for i in range(8)] == ["a.csv", "a-2.csv", "a-2-2.csv", "a-3.csv", "b", "b-2", ".x", ".x-2"] and got[2, 0] == "a.csv"
    assert column(spark, L.title, [None, " ", "  hi  ", "x" * 41, "y" * 39 + " z"]) == ["New chat", "New chat", "hi", "x" * 40 + "…", "y" * 39 + "…"]
    assert column(spark, L.clean_title, ['"**Plan** [a](b)"', "'q'", None, "z" * 60]) == ["Plan ab", "q", "", "z" * 50 + "…"]
    scripts = ["# comment", "x = SFTTrainer()", "trainer.train()", "import os", "a\nb", "run.py", "dir/run.py", "https://x/y\nz", "../a\nb", "hello", "", None, "print(1)"]
    assert column(spark, L.is_inline_script, scripts) == [True, True, True, True, True, False, False, False, False, False, False, False, True]
    tags = [["base_model:me/x", "base_model:my-finetune", "base_model:org/base"], ["base_model:finetune:org/b"], ["x"], ["base_model:me/x"]]
    assert column(spark, lambda c: L.base_model(c, F.lit("me/x")), tags, "array<string>") == ["org/base", "org/b", None, None]


def test_install_logs_and_user_columns(spark):
    rows = [(1, 0, "Resolved"), (1, 1, " Installed 3 packages in 1.5 s "), (1, 2, "run"), (2, 0, "Installed 1 package in 3ms"), (2, 1, "x"), (3, 0, "Installed 3 packages in /tmp"), (3, 1, "y")]
    log = spark.createDataFrame(rows, "log_id int, n int, line string")
    got = sorted((r.log_id, r.n, r.line) for r in L.after_install(log).collect())
    assert got == [(1, 0, "[installs truncated]"), *rows[1:]]
    own = spark.createDataFrame([(0, "k", 5, 6, 7, 8)], "seq int, session_id string, tokens int, peak int, was int, nth int")
    assert L.budget_state(own, 4, 9).columns == [*own.columns, "state"]
    assert L.head_split(own.withColumn("cut", F.lit("mine")), "seq").first().cut == "mine"
