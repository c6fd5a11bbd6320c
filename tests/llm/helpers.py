"""Small hostile tables for the operator tests."""

import os

SF = "/root/testdata/sf0.001"

ODD_TEXTS = [None, "", " ", "\n\n", "a", "a", "  two  spaces ", "tab\tand\nline", "Ünïcödé ßtraße", "日本語 テキスト",
             "emoji 👩‍👩‍👧 end", "it's we'll I'd 'tis", "x" * 5000, "word " * 3000, "a\x1cb \x1d c", "a᠎b ᠎ c",
             "end line  nbsp", "12 345 6,7.8", "<|endoftext|> text", "Trailing. ", " leading", "tail\r\n"]


def documents(spark, texts=ODD_TEXTS, first_id=1, extra=True):
    """doc_id, text, lang, source and columns whose names clash with outputs."""
    rows = [(first_id + i, t, "en" if i % 3 else None, f"s{i % 3}" if i % 4 else None, 7, "x")
            for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, mix_slot int, kept string")
    return df if extra else df.select("doc_id", "text", "lang", "source")


def empty(spark):
    return documents(spark).limit(0)


def with_null_and_repeats(spark):
    """The odd table with a null id and its rows twice."""
    df = documents(spark)
    null = spark.createDataFrame([(None, "no id", None, None, 1, "y")], df.schema)
    return df.union(df).union(null)


def read(spark, name="documents", sf=SF):
    return spark.read.parquet(os.path.join(sf, f"{name}.parquet"))
