"""The streaming ingestion ends with the same counts as the batch query."""

from haat.operators.sentiment import interest_index
from haat.session import scratch_dir
from haat.sources.tables import table
from haat.streaming import interest

from tests.conftest import SF_SMALL


def test_stream_matches_batch(spark):
    counts = interest.event_counts_stream(spark, SF_SMALL, file_glob="events.parquet")
    out, ck = scratch_dir(spark, "interest-table"), scratch_dir(spark, "interest-ckpt")
    q = interest.start_ingest(counts, out, ck)
    q.awaitTermination(300)
    got = interest.interest_from_counts(interest.read_counts(spark, out))
    exp = interest_index(table(spark, SF_SMALL, "events"))
    cols = ["product", "date", "n_events", "interest"]
    assert sorted(map(tuple, got.select(cols).collect())) == sorted(map(tuple, exp.select(cols).collect()))
    # a second run finds no new files and leaves the table unchanged
    q2 = interest.start_ingest(counts, out, ck)
    q2.awaitTermination(300)
    assert interest.read_counts(spark, out).count() == exp.count()


def test_weekly_sentiment_stream_matches_batch(spark):
    from pyspark.sql import functions as F
    from haat.operators.sentiment import weekly_sentiment
    from haat.sources.adapter import social_sentiment
    from haat.streaming import sentiment as ss
    stream = ss.weekly_sentiment_stream(spark, SF_SMALL, file_glob="events.parquet")
    out, ck = scratch_dir(spark, "weekly-table"), scratch_dir(spark, "weekly-ckpt")
    ss.start_weekly_ingest(stream, out, ck).awaitTermination(300)
    got = {(r["week"], r["product"]): (r["sentiment"], r["n_scores"])
           for r in ss.read_weekly(spark, out).collect()}
    exp = {(r["week"], r["product"]): (r["sentiment"], r["n_scores"])
           for r in weekly_sentiment(social_sentiment(spark, SF_SMALL))
           .where(F.col("n_scores") > 0).collect()}
    assert set(got) == set(exp)
    for k in exp:
        assert got[k][1] == exp[k][1] and abs(got[k][0] - exp[k][0]) <= 1e-4


def test_late_files_are_counted(spark, tmp_path):
    """The newer half arrives first, the older half second."""
    from pyspark.sql import functions as F
    ev = table(spark, SF_SMALL, "events")
    mid = ev.select(F.expr("percentile_approx(cast(ts AS timestamp), 0.5)")).first()[0]
    newer = F.col("ts").cast("timestamp") >= F.lit(mid)
    src = tmp_path / "src"
    out, ck = scratch_dir(spark, "late-table"), scratch_dir(spark, "late-ckpt")
    for i, half in enumerate((newer, ~newer)):
        ev.where(half).coalesce(1).write.mode("append").parquet(str(src))
        counts = interest.event_counts_stream(spark, str(src), file_glob="*.parquet")
        interest.start_ingest(counts, out, ck).awaitTermination(300)
    assert interest.read_counts(spark, out).agg(F.sum("n_events")).first()[0] == ev.count()
