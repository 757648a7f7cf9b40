import json

import pytest
from pyspark.sql import functions as F

from tallymark import fixed
from tallymark.functions import labels as lb
from tallymark.functions import numbers as nm


def run(spark, expression, values):
    df = spark.createDataFrame(list(enumerate(values)), "i int, t string")
    return [r.o for r in df.select("i", expression.alias("o")).orderBy("i").collect()]


@pytest.mark.parametrize(
    "raw, wanted",
    [
        ("a (b) c (d) e", "a  e"),
        ("Promotional emails (marketing, sales)", "Promotional emails"),
        (" na ", "N/A"),
        ("nab", "nab"),
        ("  x ", "x"),
        ("a (b\nc) d", "a (b\nc) d"),
        ("a (b\nc (d) e", "a (b\nc  e"),
        (None, None),
    ],
)
def test_normalise(spark, raw, wanted):
    assert run(spark, lb.normalise_label("t"), [raw]) == [wanted]


def test_mapping_modes(spark):
    table = {"a": "A"}
    assert run(spark, lb.map_values("t", table), ["a", "b", None]) == ["A", "b", None]
    assert run(spark, lb.map_values("t", table, "null"), ["a", "b"]) == ["A", None]
    assert run(spark, lb.map_values("t", table, "error"), ["a", None]) == ["A", None]
    with pytest.raises(Exception, match="no mapping for b"):
        run(spark, lb.map_values("t", table, "error"), ["b"])


def test_mapping_by_table_and_reverse(spark):
    names = spark.createDataFrame([("a", "A"), ("b", "B")], "key string, name string")
    df = spark.createDataFrame([(1, "a"), (2, "x")], "i int, t string")
    kept = lb.map_by_table(df, "t", names, "key", "name").orderBy("i").collect()
    assert [r.t for r in kept] == ["A", "x"]
    back = lb.map_by_table(spark.createDataFrame([(1, "B")], "i int, t string"), "t", names, "name", "key")
    assert back.first().t == "b"
    with pytest.raises(Exception, match="no mapping for x"):
        lb.map_by_table(df, "t", names, "key", "name", "error").collect()


def reply(**change):
    record = {"class_label": fixed.CLASSES[8], "alternative_label": "two words", "subject_suggestion": "note"}
    record.update(change)
    return json.dumps({k: v for k, v in record.items() if v is not ...})


def test_reply_validation(spark):
    good = [reply(), reply(extra=1), reply(alternative_label="a b c")]
    bad = [
        reply(class_label="Promotional emails"), reply(alternative_label="a b c d"), reply(alternative_label="A"),
        reply(subject_suggestion="two words"), reply(subject_suggestion=...), reply(subject_suggestion=None),
        reply(subject_suggestion="note\n"), reply(alternative_label=True), reply(subject_suggestion=["note"]), "no json", "[]", "", None,
    ]
    assert run(spark, lb.reply_is_valid(lb.parse_reply("t")), good + bad) == [True] * 3 + [False] * len(bad)
    df = spark.createDataFrame(list(enumerate([good[0], bad[0], bad[1]])), "i int, t string")
    rows = lb.with_reply(df, "t", valid="ok").orderBy("i").collect()
    assert [(r.ok, r.primary_category, r.alternative_category) for r in rows] == [
        (True, fixed.CLASSES[8], "two words"), (False, "N/A", "N/A"), (False, "N/A", "N/A"),
    ]


def test_kept_classes(spark):
    assert run(spark, lb.is_kept_class("t"), [fixed.CLASSES[7], fixed.CLASSES[8]]) == [True, False]


def test_any_equals(spark):
    df = spark.createDataFrame([("x", None), (None, "y"), (None, None)], "a string, b string")
    assert [r.o for r in df.select(lb.any_equals(["a", "b"], "x").alias("o")).collect()] == [True, False, False]


def test_minmax_and_rounding(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0), (2.0, 5.0)], "a double, b double")
    rows = nm.minmax_over(df, ["a", "b"]).orderBy("a").collect()
    assert [r.a for r in rows] == [0.0, 0.5, 1.0] and [r.b for r in rows] == [None] * 3
    flipped = nm.minmax_over(df, ["a"], inverted=["a"]).orderBy("a").collect()
    assert [r.a for r in flipped] == [0.0, 0.5, 1.0]
    assert df.select(nm.as_count(F.lit(2.9)), nm.percent(F.lit(0.5)), nm.rounded(F.lit(0.126))).first()[:] == (2, 50.0, 0.13)


def test_zero_vectors(spark):
    df = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, -1.0]), (3, [0.5, 0.0])], "i int, v array<float>")
    assert [r.i for r in df.filter(~nm.is_zero_vector("v")).collect()] == [3]
