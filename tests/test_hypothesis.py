"""Property tests: Spark helpers against plain-Python definitions on
random inputs (one Spark job per generated batch)."""

from decimal import ROUND_HALF_UP, Decimal

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from haat.functions import labels as L
from haat.functions.numeric import rnd
from haat.functions.text import LINE_BREAKS, WHITESPACE, clean_answer

CHARS = "ab xyzআ.," + "".join(chr(c) for c in set(WHITESPACE) | set(LINE_BREAKS))


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet=CHARS, max_size=120), min_size=1, max_size=40))
def test_clean_answer_has_its_properties(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for r in df.select("t", clean_answer(F.col("t")).alias("x")).collect():
        body = r["x"].removesuffix(L.SHORT_ANSWER_HINT)
        assert (body != r["x"]) == (r["t"] != "" and len(body) < 40)
        lines = body.split("\n") if body else []
        assert all(x.strip() and x == x.rstrip() for x in lines) and body == body.strip()
        assert "".join(body.split()) == "".join(r["t"].split())


def py_rnd(x, n=2):
    d = Decimal(repr(x)).quantize(Decimal(1).scaleb(-(n + 4)), ROUND_HALF_UP)
    return float(d.quantize(Decimal(1).scaleb(-n), ROUND_HALF_UP))


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(
    st.floats(min_value=-1e9, max_value=1e9, allow_nan=False),
    st.integers(min_value=-10**7, max_value=10**7).map(lambda k: k / 1000.0)),   # many exact ties
    min_size=1, max_size=60))
def test_rnd_is_half_up_through_decimal(spark, xs):
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate(xs)], "i int, x double")
    got = {r["i"]: r["y"] for r in df.select("i", rnd(F.col("x")).alias("y")).collect()}
    assert [got[i] for i in range(len(xs))] == [py_rnd(x) for x in xs]
