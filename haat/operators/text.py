"""Text operators over whole columns (F21–F25 applied to tables)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haat.functions import labels as L
from haat.functions.text import clean_answer, has_bengali, reply_text


def answer_cleanup(conv: DataFrame) -> DataFrame:
    """F24 on every conversation turn (whole texts)."""
    return conv.select("conv_id", "turn", "role", clean_answer(F.col("text")).alias("cleaned"))


def bengali_flag(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """F23 per document."""
    return docs.select(id_col, "lang", has_bengali(F.col("text")).alias("is_bengali"))


def json_reply(events: DataFrame, extra_keys=("k",)) -> DataFrame:
    """F25 on each event's ``props`` (see ``functions.text.reply_text``)."""
    return events.select("event_id", reply_text(F.col("props"), extra_keys).alias("reply"))


def date_labels(dates: DataFrame, col: str = "dt") -> DataFrame:
    """English and Bengali "weekday day month year" labels per date."""
    d = F.col(col).cast("date")
    return dates.select(d.alias("dt")).distinct().select(
        "dt", L.weekday_name(F.col("dt")).alias("weekday"),
        L.date_label(F.col("dt"), "en").alias("label_en"),
        L.date_label(F.col("dt"), "bn").alias("label_bn"))
