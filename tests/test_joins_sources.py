from email.message import EmailMessage

import pytest
from pyspark.sql import functions as F

from tallymark.functions.keys import match_id, message_id
from tallymark.operators import filters as fl
from tallymark.operators import joins as jn
from tallymark.schemas import MESSAGE, MODEL_PARAMS
from tallymark.session import new_folder
from tallymark.sources import mail, tables

KEY = "subject string, `from` string, body string, date long"


def test_message_id_marks_nulls_and_borders(spark):
    rows = [("ab", "c", "x", 1), ("a", "bc", "x", 1), (None, "c", "x", 1), ("null", "c", "x", 1)]
    df = spark.createDataFrame(rows, KEY)
    assert df.select(message_id()).distinct().count() == 4
    assert [r.m is None for r in df.select(match_id().alias("m")).collect()] == [False, False, True, False]


def test_join_folds_copies(spark):
    left = spark.createDataFrame([(i, "s", "f", "b", 1) for i in range(3)] + [(9, "s", "f", "z", 1), (8, None, "f", "b", 1)], "i int, " + KEY)
    right = spark.createDataFrame([("s", "f", "b", 1, [1.0])] * 4 + [(None, "f", "b", 1, [2.0])], KEY + ", v array<float>")
    inner = jn.join_messages(left, right, ["v"])
    assert sorted((r.i, r.copies) for r in inner.collect()) == [(0, 4), (1, 4), (2, 4)]
    assert jn.repeat_copies(inner).count() == 12
    assert jn.join_messages(left, right, ["v"], "left").count() == 5
    assert jn.attach_vectors(left, right, ["v"]).count() == 3
    assert sorted(r.i for r in jn.without_messages(left, right).collect()) == [8, 9]


def test_work_lists(spark):
    docs = spark.createDataFrame([(1,), (2,)], "doc int")
    work = jn.work_list(docs, ["a", "b"], 3)
    assert work.count() == 12
    pairs = jn.work_list(docs, ["a", "b"])
    done = spark.createDataFrame([(1, "a")], "doc int, model string")
    left = {(r.doc, r.model) for r in jn.pending_work(pairs, done, ["doc", "model"]).collect()}
    assert left == {(1, "b"), (2, "a"), (2, "b")}
    state = {r.model: (r.done, r.expected, r.complete) for r in jn.completeness(done, pairs).collect()}
    assert state == {"a": (1, 2, False), "b": (0, 2, False)}


def test_unions_and_duplicates(spark):
    one = spark.createDataFrame([(1, 2.0)], "a int, b double")
    two = spark.createDataFrame([(3, 4)], "b int, a long")
    both = jn.union_widened(one, two)
    assert both.dtypes == [("a", "bigint"), ("b", "double")]
    assert sorted(both.collect()) == [(1, 2.0), (4, 3.0)]
    df = spark.createDataFrame([("k", 2, "late"), ("k", 1, "first"), (None, 1, "n")], "k string, p int, v string")
    assert sorted((r.k or "", r.v) for r in jn.keep_first(df, ["k"], ["p"]).collect()) == [("", "n"), ("k", "first")]


def test_filters(spark):
    moments = ["1800-01-01 00:00:00", "1991-01-01 00:00:00", "1991-01-01 00:00:01", None]
    df = spark.createDataFrame([(m,) for m in moments], "date string").withColumn("date", fl.timestamp_utc("date"))
    assert fl.dated(df).count() == 1
    cats = spark.createDataFrame([("x",), ("N/A",), (None,)], "category string")
    assert fl.not_failed(cats).count() == 1 and fl.complete(cats, ["category"]).count() == 2
    assert fl.fill(cats, "N/A").filter("category = 'N/A'").count() == 2
    with pytest.raises(ValueError, match="no rows in labels"):
        jn.require_rows(cats.limit(0), "labels")


def test_date_filter_reaches_the_scan(spark):
    path = new_folder(spark, "dated")
    df = spark.range(10).select(F.timestamp_seconds(F.col("id") * 1_000_000_000).alias("date"), "id")
    tables.write(df, path)
    plan = fl.dated(tables.scan(spark, path, ["date"]))._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(date), GreaterThan(date" in plan and "id" not in plan.split("ReadSchema")[-1]


def test_model_tree(spark):
    root = new_folder(spark, "tree")
    df = spark.createDataFrame(
        [("tulu3", " na "), ("tulu3", "x (y)"), ("gemma2-2b", "x"), ("qwq", "z")], "folder string, primary_category string"
    ).withColumn("date", F.lit("2024-01-01").cast("timestamp"))
    for folder in ("tulu3", "gemma2-2b", "qwq"):
        tables.write(df.filter(F.col("folder") == folder).drop("folder"), f"{root}/{folder}")
    df.drop("folder").coalesce(1).write.mode("append").parquet(root)
    tree = tables.scan_model_tree(spark, root)
    assert {r.model_key for r in tree.collect()} == {"tulu3", "qwq"}
    rows = {(r.model, r.primary_category) for r in tables.integrate(tree).collect()}
    assert rows == {("Tulu-3", "N/A"), ("Tulu-3", "x"), ("QwQ", "z")}
    assert tables.scan(spark, f"{root}/*/*.parquet").count() == 4


def test_partitioned_write(spark):
    root = new_folder(spark, "parts")
    df = spark.createDataFrame([("tulu3", "x"), ("qwq", "z")], "model_key string, c string")
    tables.write(df, root, by=["model_key"], level=5)
    assert {(r.model_key, r.c) for r in tables.scan_model_tree(spark, root).collect()} == {("tulu3", "x"), ("qwq", "z")}


def test_pipe_table(spark, tmp_path):
    path = tmp_path / "table.txt"
    path.write_text(
        "| Model name | Served | Params (B) |\n| --- | :---: | ---: |\n| Gemma-2  | gemma2:latest | 9.24 |\n"
        "| QwQ | qwq:latest | 32.8 | \n| X-y | a | none |\n"
    )
    rows = tables.read_pipe_table(spark, str(path), MODEL_PARAMS).collect()
    assert [(r.model, r.served_name, r.params_b and round(r.params_b, 2)) for r in rows] == [
        ("Gemma-2", "gemma2:latest", 9.24), ("QwQ", "qwq:latest", 32.8), ("X-y", "a", None),
    ]


def test_mail_files(spark, tmp_path):
    message = EmailMessage()
    message["Subject"] = "Grüße"
    message["From"] = "me@example.org"
    message["Date"] = "Mon, 01 Jan 2024 02:00:00 +0200"
    message.set_content("plain été")
    message.add_alternative("<p>html</p>", subtype="html")
    message.add_attachment(b"abc", maintype="application", subtype="pdf", filename="a.pdf")
    (tmp_path / "a.eml").write_bytes(message.as_bytes())
    (tmp_path / "b.eml").write_bytes(b"From: x@y\nContent-Type: text/plain\n\ncaf\xe9")
    (tmp_path / "c.eml").write_bytes(b"Date: not a date\n\n")
    df = mail.read_messages(spark, str(tmp_path))
    assert df.schema == MESSAGE
    rows = {r["from"]: r for r in df.withColumn("s", F.unix_seconds("date")).collect()}
    first = rows["me@example.org"]
    assert (first.subject, first.attachments, first.multipart, first.s) == ("Grüße", 1, True, 1704067200)
    assert first.body.strip() == "plain été" and first.date_str.startswith("Mon, 01 Jan")
    assert rows["x@y"].body == "café" and rows["x@y"].s == -5364662400 and rows["x@y"].subject == ""
    assert rows[""].date_str == "not a date" and rows[""].s == -5364662400
