"""Script, text and citation expressions on literal rows."""

import pytest
from pyspark.sql import functions as F

from lexiloom.functions import citations, scripts, text as tx

SCRIPTS = [
    ("Rivers carry sand to the sea", "latn"), ("மலையில் மழை பெய்தது", "taml"), ("ฝนตกที่ภูเขา", "thai"), ("नदी पहाड़ से आती है", "deva"), ("他们在学校门口等车", "hans"), ("他們在學校門口等車", "hant"),
    ("やまに あめが ふりました", "jpan"), ("산에 비가 내렸습니다", "kore"), ("дождь идёт в горах", "cyrl"), ("المطر على الجبل", "arab"), ("2026 / 11: 3,5 %", "unknown"), ("", "unknown"), (None, "unknown"),
]


def column(spark, rows, expr, schema="a string, b string"):
    return [r.x for r in spark.createDataFrame([(k, *r) if isinstance(r, tuple) else (k, r) for k, r in enumerate(rows)], f"k int, {schema}").orderBy("k").select(expr.alias("x")).collect()]


def test_detect(spark):
    assert column(spark, [t for t, _ in SCRIPTS], scripts.detect(F.col("a")), "a string") == [s for _, s in SCRIPTS]


def test_language(spark):
    assert column(spark, ["latn", "hant", "taml", "xxxx"], scripts.language_of(F.col("a")), "a string") == ["en", "zh", "ta", "und"]


@pytest.mark.parametrize(
    ("body", "script", "n"),
    [("four small grey stones", "latn", 4), ("மழை பெய்தது", "taml", 2), ("門口等車", "hant", 4), ("他 们 等", "hans", 3), ("やまに", "jpan", 3), ("ฝนตก", "thai", 4), ("", "latn", 0), ("a　b", "latn", 2)],
)
def test_count_tokens(spark, body, script, n):
    assert column(spark, [(body, script)], tx.count_tokens(F.col("a"), F.col("b"))) == [n]


def test_heading_level(spark):
    rows = ["Part Two", "Summary", "7.1 Rivers", "7-1-4 Sand banks", "9) Hills", "2.3.5.8 Small stones"]
    assert column(spark, rows, tx.heading_level(F.col("a")), "a string") == [1, 1, 2, 3, 1, 4]


def test_join_lines(spark):
    rows = [("sand-\nstone", "latn"), ("North-\nSea", "latn"), ("a\n\n  b \n", "latn"), ("門口\n等車", "hans"), ("x -\ny", "latn"), ("ab-\ncd", "taml"), (" \r\n a \x0b\u2028 b\x1f \n", "latn"), ("a" + " " * 50_000 + "b", "latn")]
    assert column(spark, rows, tx.normalise(F.col("a"), F.col("b"))) == ["sandstone", "North-Sea", "a b", "門口等車", "x - y", "ab- cd", "a b", "a b"]


def test_normalise_strips_and_composes(spark):
    rows = [("café so­ft﻿  x", "latn")]
    assert column(spark, rows, tx.normalise(tx.nfc(F.col("a")), F.col("b"))) == ["café soft x"]


def test_tokens(spark):
    rows = [("Rivers Carry Sand", "latn"), ("on page 7.1.4 below", "latn"), ("CO2, again!", "latn"), ("மழை பெய்தது", "taml"), ("門口等車", "hans"), ("車", "hans"), ("", "hans"), ("Straße", "latn"), (None, "latn")]
    got = column(spark, rows, tx.tokens(F.col("a"), F.col("b")))
    assert got[0] == ["rivers", "carry", "sand"] and "7.1.4" in got[1] and got[2] == ["co2", "again"] and len(got[3]) == 2
    assert got[4:] == [["門口", "口等", "等車"], ["車"], [], ["strasse"], []]


def test_legacy_and_mixed(spark):
    rows = ["A plain line on rivers and hills.", "Près du château, la rivière gelée s'étend à l'été.", "¬î£˜ ¢ð£¤ ¬î£˜", "மழைab மலைcd"]
    assert column(spark, rows, scripts.trustworthy(F.col("a")), "a string") == [True, True, False, False]


def test_estimate_prices_tamil_higher(spark):
    latin, tamil = column(spark, ["a" * 233, "க" * 233], tx.estimate_tokens(F.col("a")), "a string")
    assert latin == 115 and tamil > 2 * latin


def test_snippet(spark):
    long, short = column(spark, ["word " * 100, " a \n b "], tx.snippet(F.col("a")), "a string")
    assert len(long) <= 221 and long.endswith("…") and short == "a b"


def test_provenance(spark):
    df = spark.sql("SELECT 'sha256:abcdef0123456789' AS d, CAST(NULL AS STRING) AS n, 3 AS a, 5 AS b, array('Ch 1', '', '1.2 X') AS h")
    assert df.select(tx.provenance(F.col("n"), F.col("d"), F.col("a"), F.col("b"), F.col("h"))).first()[0] == "abcdef01 / pp.3-5 | Ch 1 > 1.2 X"


@pytest.mark.parametrize(
    ("raw", "clean", "used"),
    [
        ("It rained [4].", "It rained [4].", [4]), ("Sand [77] moves far.", "Sand moves far.", []), ("雨が降った [60]。", "雨が降った。", []), ("Hills [5, 6] rise", "Hills [5] rise", [5]), ("Stones [3,4]", "Stones [3][4]", [3, 4]),
        ("[0] leads", "leads", []), ("  [0] indented [8]\nnext", "  indented\nnext", []), ("`run [2]` then [9]", "`run [2]` then", []), ("~~~\n[7]\n~~~\nlast [1]", "~~~\n[7]\n~~~\nlast [1]", [1]), ("same [2, 2]", "same [2]", [2]), ("one ` tick [3]", "one ` tick [3]", [3]), ("nul\0 [1]", "nul [1]", [1]),
        ("gaps [9] [8] close", "gaps close", []), ("[9] [8] y", " y", []), ("x [9]\ty", "x\ty", []), ("a [9]`b`", "a`b`", []),
    ],
)
def test_verify(raw, clean, used):
    assert citations.verify_text(raw, 5) == (clean, used)
    assert citations.verify_text(clean, 5)[0] == clean


def test_citation_columns(spark):
    rows = ["x [1, 1] y [7]", "none", "`[1]` [2]", None]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(rows)], "k int, t string").orderBy("k")
    assert [r.m for r in df.select(citations.find_markers(F.col("t")).alias("m")).collect()] == [[1, 1, 7], [], [2], []]
    v = [r.v for r in df.select(citations.verify(F.col("t"), F.lit(5)).alias("v")).collect()]
    assert (v[0].emitted, v[0].grounded) == (3, 1) and v[3].text == ""
