"""Text helpers on literals (FIXTURES.md text cases) and on documents."""

from pyspark.sql import functions as F

from haat.functions import labels as L
from haat.functions.text import clean_answer, has_bengali, reply_text


def _one(spark, col_fn, value, schema="t string"):
    return spark.createDataFrame([(value,)], schema).select(col_fn(F.col("t")).alias("x")).first()["x"]


def test_bengali(spark):
    assert _one(spark, has_bengali, "আমার দোকান") is True
    assert _one(spark, has_bengali, "my shop") is False


def test_cleanup_fixture(spark):
    assert _one(spark, clean_answer, " a  \n\n b \n") == "a\n b" + L.SHORT_ANSWER_HINT
    assert _one(spark, clean_answer, "") == ""
    assert _one(spark, clean_answer, None) == ""


def test_cleanup_of_whole_answers(spark):
    cases = [("  hello world, this answer is certainly longer than forty chars \r\n\r\n next  ",
              "hello world, this answer is certainly longer than forty chars\n next"),
             ("\t\n  x  \n", "x" + L.SHORT_ANSWER_HINT), ("   \n  \n ", L.SHORT_ANSWER_HINT),
             ("a\x0bb\x0cc   \n   ", "a\nb\nc" + L.SHORT_ANSWER_HINT),
             ("no change needed in this sentence at all, really.", "no change needed in this sentence at all, really.")]
    df = spark.createDataFrame([(c[0],) for c in cases], "t string").select(clean_answer(F.col("t")).alias("x"))
    assert [r["x"] for r in df.collect()] == [c[1] for c in cases]


def test_json_shapes(spark):
    rows = ['{"candidates": [{"content": "c"}]}', '{"output": [{"text": "o"}]}',
            '{"outputs": [{"content": "x"}]}', '{"response": "r"}', '{"k": 5}']
    df = spark.createDataFrame([(r,) for r in rows], "t string")
    got = [r["x"] for r in df.select(reply_text(F.col("t")).alias("x")).collect()]
    assert got == ["c", "o", "x", "r", None]


def test_date_label(spark):
    import datetime as dt
    df = spark.createDataFrame([(dt.date(2026, 1, 15),)], "d date")
    r = df.select(L.date_label(F.col("d")).alias("en"), L.date_label(F.col("d"), "bn").alias("bn")).first()
    assert r["en"] == "Thursday 15 January 2026"
    assert r["bn"] == "বৃহস্পতিবার 15 জানুয়ারি 2026"


def test_upcoming_season_first_rule_wins(spark):
    df = spark.range(1, 13).select(F.col("id").cast("int").alias("m"))
    got = {r["m"]: r["s"] for r in df.select("m", L.upcoming_season(F.col("m")).alias("s")).collect()}
    assert got[3] == L.SEASON_RAMADAN and got[4] == L.SEASON_EID and got[11] == L.SEASON_WINTER
    assert got[6] == L.SEASON_NORMAL


def test_reply_order(spark):
    from haat.operators.text import json_reply
    cases = [('{"candidates": [{"content": "", "text": "t"}]}', "t"),
             ('{"candidates": [{"other": 1}], "response": "r"}', None),
             ('{"candidates": [], "response": "r"}', "r"), ('{"output": ["x"], "outputs": [{"text": "y"}]}', "y"),
             ('{"outputs": [], "response": "r"}', "r"), ('{"k": 3}', "3"), ('not json', None), ('{}', None), (None, None)]
    ev = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "event_id long, props string")
    got = {r["event_id"]: r["reply"] for r in json_reply(ev).collect()}
    assert [got[i] for i in range(len(cases))] == [c[1] for c in cases]


def test_split_trim(spark):
    from haat.functions.numeric import split_trim
    df = spark.createDataFrame([(" clothing, electronics ,food",)], "p string")
    assert df.select(split_trim(F.col("p")).alias("x")).first()["x"] == ["clothing", "electronics", "food"]
