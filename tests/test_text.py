import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from tallymark.functions import text as tx


def run(spark, expression, values, kind="string"):
    rows = list(enumerate(values))
    df = spark.createDataFrame(rows, f"i int, t {kind}")
    return [r.o for r in df.select("i", expression.alias("o")).orderBy("i").collect()]


def test_remove_urls(spark):
    values = ["see http://a.b/c?d=1 now", "https://x y", "ftp://x", None, "http:/", "a http://x y"]
    assert run(spark, tx.remove_urls("t"), values) == ["see  now", " y", "ftp://x", "", "http:/", "a  y"]


def test_url_goes_before_markup(spark):
    # The address takes the quote, the bracket and the text behind it along.
    assert run(spark, tx.clean_text("t"), ['<a href="https://x.y">t</a> z']) == ['<a href=" z']
    assert run(spark, tx.clean_text("t"), ['<a href="https://x.y" >t</a> z']) == ["t z"]


@pytest.mark.parametrize(
    "html, wanted",
    [
        ("<p>a</p><p>b</p>", "ab"),
        ("a <!-- > <b> --> c", "a c"),
        ("<script>if (a<b) {'</p>'}</script>x<style>p{}</style>y", "xy"),
        ("<script><!-- </script>x", "x"),
        ("x<script>never closed", "x"),
        ('<a title="1 > 2">t</a>', "t"),
        ("<p don't>a</p>", "a"),
        ("1 < 2 and 3 > 2", "1 < 2 and 3 > 2"),
        ("&lt;b&gt; &amp;lt; &eacute; &#233; &#x41; &copy &nosuch;", "<b> &lt; é é A © &nosuch;"),
        ("a&nbsp;&nbsp;b\r\n\r\n c", "a b c"),
        (None, ""),
    ],
)
def test_clean_html(spark, html, wanted):
    assert run(spark, tx.clean_html("t"), [html]) == [wanted]


def test_hostile_text_is_cleaned_quickly(spark):
    quotes = "<a " + "l'x " * 100_001 + "> y"
    stray = "<a<b " * 50_000
    assert run(spark, tx.clean_html("t"), [quotes, stray, "<b " * 1000 + "> z <"]) == ["y", stray.strip(), "z <"]


def test_step_by_step_cleaning_is_the_same(spark):
    values = ["<p>a &amp; &eacute;</p>", "<p></p>", "plain\n", None, " http://x <b>y</b>\n z"]
    df = spark.createDataFrame(list(enumerate(values)), "i int, t string")
    both = df.select("i", tx.clean_text("t").alias("a"), tx.clean_or_raw("t").alias("b"), "t")
    steps = tx.with_clean_text(tx.with_clean_text(both, "t", "c"), "t", "d", or_raw=True)
    for row in steps.collect():
        assert row.a == row.c and row.b == row.d


def test_only_markup_keeps_raw_body(spark):
    assert run(spark, tx.clean_or_raw("t"), ["<p></p>", "<p> x </p>"]) == ["<p></p>", "x"]


def test_white_space_follows_python(spark):
    alphabet = ["a", " ", "\n", "\r", "\x0b", "\x85", " ", "\xa0", "\t", "\x1f", "\x1c", "　"]
    rng = random.Random(1)
    cases = ["".join(p) for n in range(4) for p in itertools.product(alphabet, repeat=n)]
    cases += ["".join(rng.choices(alphabet, k=rng.randint(4, 9))) for _ in range(2000)]

    def lines(text):
        text = re.sub(r"[\n\r]+", "\n", text)
        return re.sub(r"\s+", " ", "\n".join(line.strip() for line in text.splitlines()))

    assert run(spark, tx.trim_lines("t"), cases) == [lines(c) for c in cases]
    assert run(spark, tx.trim_all("t"), cases) == [c.strip() for c in cases]
    assert run(spark, tx.collapse_spaces("t"), cases) == [re.sub(r"\s+", " ", c) for c in cases]


def test_newlines(spark):
    assert run(spark, tx.collapse_newlines("t"), ["a\r\n\n\rb\nc"]) == ["a\nb\nc"]


def test_token_count_and_truncation(spark):
    assert run(spark, tx.count_tokens("t"), ["a b, été_1!", "", None]) == [5, 0, 0]
    assert run(spark, tx.count_tokens("t", is_cleaned=False), ["<b>a</b> b"]) == [2]
    # int(len * limit / (n + 1)) characters, by code point
    text = "été 😀 abc"
    assert run(spark, tx.truncate_to_tokens("t", F.lit(3), limit=2), [text]) == [text[: len(text) * 2 // 4]]
    assert run(spark, tx.truncate_to_tokens("t", F.lit(0), limit=50), [text]) == [text]


def test_user_encoder(spark):
    count = tx.count_tokens_with(lambda: str.split)
    assert run(spark, count("t"), ["a b c", None]) == [3, 0]


def test_compose(spark):
    made = tx.compose("t", F.lit("me"), F.lit("x"))
    assert run(spark, made, ["s", None]) == ["Subject: s\nFrom: me\nx", "Subject: None\nFrom: me\nx"]


def test_bytes(spark):
    values = ["été".encode(), "été".encode("latin-1"), b"\xff\xfe", None]
    assert run(spark, tx.decode_bytes("t"), values, "binary") == ["été", "été", "ÿþ", None]
    broken = tx.drop_invalid_utf8(F.col("t").cast("string"))
    assert run(spark, broken, [b"a\xffb", "é".encode()], "binary") == ["ab", "é"]


def test_dates(spark):
    parsed = F.unix_seconds(tx.parse_date("t", "dd MMM yyyy HH:mm:ss Z"))
    assert run(spark, parsed, ["01 Jan 2024 00:00:00 +0000", "nonsense", None]) == [
        1704067200, -5364662400, -5364662400,
    ]


def test_prompt(spark):
    made = tx.render_prompt("{a}-{b} {c}{a}", {"a": F.col("t"), "b": F.lit(1)})
    assert run(spark, made, ["x", None]) == ["x-1 {c}x", "None-1 {c}None"]
