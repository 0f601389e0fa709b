"""Paths, names, edits, web payloads, provenance and heartbeats on small inputs."""

import json

from pyspark.sql import functions as F

from lodewright.functions import paths as X
from lodewright.operators import profile as P
from lodewright.sources import apis as A
from lodewright.streaming import events as S


def one(spark, c):
    return spark.range(1).select(c.alias("v")).first().v


def test_path_priority_takes_the_deepest_folder(spark):
    rows = [("examples/scripts/train.py",), ("src/Demo/x/recipes/a.py",), ("a.py",), (None,)]
    got = [tuple(r.v or ()) for r in spark.createDataFrame(rows, "p string").select(X.path_priority(F.col("p")).alias("v")).collect()]
    assert got[:3] == [(0, 0, 3), (1, 12, 5), (1, 999, 1)]


def test_scores(spark):
    df = spark.createDataFrame([("examples/train.py",), ("zzz",), ("",), (None,)], "p string")
    rows = df.select(X.example_score(F.col("p")).alias("e"), X.keyword_score(F.col("p"), "train").alias("k")).collect()
    assert rows[0] == (100, 100) and rows[1].e < 50 and rows[1].k == 0 and rows[2] == (0, 0) and rows[3] == (None, None)
    assert X._ratio("kitten", "sitting") == 200 * 4 / 13


def test_close_names(spark):
    assert one(spark, X.close_names(F.lit("acme/modle:fast"), ["acme/model", "acme/models", "other"])) == ["acme/model", "acme/models"]


def test_upload_names(spark):
    names = lambda *x: F.array(*(F.lit(v).cast("string") for v in x))
    assert one(spark, X.file_slug(names("C:\\up\\Call Notes.v2.CSV"))) == "call-notes-v2-csv"
    assert one(spark, X.file_slug(names("data_sales.csv", None, "files/notes.txt", "a-b.json"))) == "sales-notes-a-bundle"
    assert one(spark, X.file_slug(names(".hidden"))) == "hidden" and one(spark, X.file_slug(names())) == ""
    assert one(spark, X.friendly_repo(F.lit(" datasets/me/x-session-AB12 "), names("q.csv"))) == "me/q-csv-ab12"
    assert one(spark, X.friendly_repo(F.lit("me/plain"), names("q.csv"))) == "me/plain"
    own = lambda r, o, a: one(spark, X.owned_repo(F.lit(r), F.lit(o).cast("string"), F.lit(a).cast("string")))
    assert [own("x", "me", None), own("dev/x", "me", None), own("app/x", "me", "app"), own("you/x", "me", None), own("x", None, None)] == ["me/x", "me/x", "me/x", "you/x", "x"]


def test_loose_matches_keep_offsets(spark):
    f = lambda t, w: tuple(one(spark, X.found_at(F.lit(t), F.lit(w))))
    assert f("ab cd", "cd") == (3, None)
    assert f("x\na  \nb", "a\nb") == (2, "(matched after trimming trailing whitespace)")
    assert f("x\n   a\nb", "a \n b") == (5, "(matched after trimming whitespace)")
    assert f("x\n  \u201chi\u201d\n", '"hi"') == (4, "(matched after unicode normalization)")
    assert f("abc", "zz") == (None, None)


def test_edits(spark):
    def e(text, old, new, mode="replace", every=False):
        return tuple(one(spark, X.edited(*(F.lit(v) for v in (text, old, new, mode, every)))))

    assert e("a b a", "b", "c") == ("a c a", 1, None, None)
    assert e("a b a", "a", "c") == (None, 2, None, "ambiguous")
    assert e("a b a", "a", "c", "replace_all") == ("c b c", 2, None, None)
    assert e("a b a", "a", "!", "append_after") == ("a! b a", 1, None, None)
    assert e("a b a", "a", "!", "prepend_before", True) == ("!a b !a", 2, None, None)
    assert e("x\n  a  \ny", "a\ny", "z")[:2] == ("x\nz", 1)
    assert e("a", "q", "z")[3] == "not_found" and e("a", "a", "z", "swap")[3] == "unknown_mode"


def test_previews_and_specs(spark):
    j = lambda v: F.lit(json.dumps(v))
    assert one(spark, A.sample_rows(j({"rows": [{"row": {"a": 1}}, {"row": 3}, {}]}))) == ['{"a":1}']
    assert one(spark, A.schema_columns(j({"dataset_info": {"features": {"b": {}, "a": {}}}}))) == ["b", "a"] and one(spark, A.schema_columns(F.lit("no"))) == []
    splits = {"splits": [{"split": "train", "num_rows": 7}, {"config": "x", "split": "train", "num_examples": 9, "num_rows": 1}]}
    assert one(spark, A.split_rows(j(splits), "default", "train")) == 7 and one(spark, A.split_rows(j(splits), "x", "train")) == 9 and one(spark, A.split_rows(j(splits), "x", "test")) is None
    spec = {"servers": [{"url": "http://h"}], "tags": [{"name": "z"}], "paths": {"/a": {"parameters": [], "get": {"summary": "s", "tags": ["t", "u"]}, "post": {}}}}
    df = spark.createDataFrame([(json.dumps(spec),), (None,)], "spec string")
    rows = {r.method: r for r in A.endpoints(df).collect()}
    assert set(rows) == {"GET", "POST"} and rows["GET"].tags == "t u" and rows["POST"].request_body == "{}" and rows["GET"].base_url == "http://h"
    assert [r.tag for r in A.tags(df).collect()] == ["t", "u", "z"]


def test_hardware_prices(spark):
    payload = {"data": [{"flavor": "a", "price": "$1,200.50"}, {"name": "b", "pricing": {"hourlyPrice": 2}}, {"id": "a", "price": 3}, {"id": "c", "price": True}]}
    df = spark.createDataFrame([(json.dumps(payload),), ("bad",), (None,)], "payload string")
    assert sorted(map(tuple, A.hardware_prices(df).collect())) == [("a", 3.0), ("b", 2.0)]


def test_provenance(spark):
    df = spark.createDataFrame([(1, "x"), (2, "y")], "id long, text string")
    got = json.loads(P.provenance(P.decide(df, "id"), base_model="m", limitations=("small",)).first().provenance)
    assert got["base_model"] == "m" and got["row_count"] == 2 and got["limitations"] == ["small"] and "golden_eval_cases" not in got and "cost_usd" not in got["training"]


def test_heartbeats(spark, tmp_path):
    at = lambda s: f"2024-01-01 00:00:{s:02}"
    df = spark.createDataFrame([("a", at(s)) for s in (0, 5, 10, 12, 25)] + [("b", at(1)), ("b", None)], "session_id string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    df.write.parquet(f"{tmp_path}/in")
    live = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    for seconds, want in ((10, [("a", 10), ("a", 25)]), (0, [])):
        q = S.heartbeats(live, seconds).writeStream.format("memory").queryName(f"beats{seconds}").option("checkpointLocation", f"{tmp_path}/c{seconds}").trigger(availableNow=True).start()
        q.awaitTermination()
        assert [(r.session_id, r.ts.second) for r in spark.table(f"beats{seconds}").orderBy("ts").collect()] == want
