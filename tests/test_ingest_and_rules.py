"""Bad CSV lines, repeated ingestion and sentiment rules against plain Python."""

import datetime as dt
import glob
import math
import os
import re

import pytest

from haat.operators.sentiment_rules import Rules, rule_sentiment
from haat.session import scratch_dir
from haat.sources import files

SCHEMA = "dt date, product string, quantity int, price double"


def test_bad_lines_are_set_aside(spark):
    from pyspark.sql.types import StructType
    path = scratch_dir(spark, "bad")
    good = ["2026-01-01,a,1,2.5", '2026-01-02,"b, c",2,', "2026-01-03,,3,1.0"]
    bad = {"2026-13-01,a,1,2.5": "value", "2026-01-01,a,one,2.5": "value", "2026-01-01,a": "fields",
           "2026-01-01,a,1,2.5,more": "fields", '"x, y",a': "fields"}
    spark.createDataFrame([(x,) for x in good + list(bad)], "value string").write.text(path)
    rows, rejects = files.read_csv_checked(spark, path, StructType.fromDDL(SCHEMA), scratch_dir(spark, "out"), header=False)
    assert sorted(tuple(r) for r in rows.collect()) == [
        (dt.date(2026, 1, 1), "a", 1, 2.5), (dt.date(2026, 1, 2), "b, c", 2, None), (dt.date(2026, 1, 3), None, 3, 1.0)]
    assert {r.line: r.reason for r in rejects.collect()} == bad


def table(path):
    return {p: os.stat(p).st_mtime_ns for p in glob.glob(f"{path}/dt=*/*.parquet")}


def test_days_are_replaced_once(spark):
    path = scratch_dir(spark, "days")
    make = lambda rows: spark.createDataFrame(rows, "dt date, product string, quantity int")     # noqa: E731
    d = [dt.date(2026, 1, i + 1) for i in range(4)]
    first = [(d[0], "a", 1), (d[0], "a", 1), (d[1], "a", 2), (d[2], "b", 3)]
    second = [(d[2], "b", 3), (d[1], "a", 9), (d[3], "c", 4)]
    assert files.ingest_days(make(first), path).count() == 3
    before = table(path)
    assert {r.dt for r in files.ingest_days(make(second), path).collect()} == {d[1], d[3]}
    after = table(path)
    # Days that did not change keep their files.
    assert {p for p in before if "2026-01-01" in p or "2026-01-03" in p} == set(before) & set(after)
    assert files.ingest_days(make(second), path).count() == 0 and table(path) == after
    got = sorted((r.dt, r.product, r.quantity) for r in spark.read.parquet(path).collect())
    assert got == [(d[0], "a", 1), (d[0], "a", 1), (d[1], "a", 9), (d[2], "b", 3), (d[3], "c", 4)]
    assert files.ingest_days(make([]), path).count() == 0


def plain(text, r):
    w = [x for x in re.split(r"[^\w]+|[\d_]+", (text or "").lower()) if x]
    s = hits = negated = 0
    for i, x in enumerate(w):
        if x in r.lexicon:
            v, before = r.lexicon[x], w[max(0, i - 3):i][::-1]
            v += math.copysign(1, v) * sum(f * r.boosters.get(b, 0) for f, b in zip((1, 0.95, 0.9), before))
            neg = any(b in r.negations for b in before)
            s, hits, negated = s + v * (-0.74 if neg else 1), hits + 1, negated + neg
    return len(w), hits, negated, s


TEXTS = [None, "", "good", "not good", "very good", "not very good", "good not", "very very very very good",
         "never was a good", "bad, slightly BAD; extremely bad", "no no no bad", "not a b c good", "so too really bad",
         "word " * 5000 + "not good"]


@pytest.mark.parametrize("rules", [Rules(), Rules(boosters={}, negations=()), Rules(lexicon={"word": 0.5})])
def test_rules(spark, rules):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id int, text string")
    for r in rule_sentiment(df, ["id"], rules=rules).collect():
        n, hits, negated, s = plain(TEXTS[r.id], rules)
        assert (r.n_tokens, r.n_hits, r.n_negated) == (n, hits, negated)
        assert r.score == pytest.approx(s, abs=1e-4) and r.compound == pytest.approx(s / math.sqrt(s * s + 15), abs=1e-4)


def test_a_batch_is_worked_out_once(spark, tmp_path):
    df = spark.createDataFrame([(f"2024-01-0{i % 5 + 1}", i) for i in range(20)], "dt string, n int")
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    path = str(tmp_path / "days")
    for times in (1, 2):
        files.ingest_days(df.mapInArrow(counted, df.schema), path)
        assert read.value == 20 * times
    assert spark.read.parquet(path).count() == 20
