"""Small tables with everything that input may hold."""

import pytest
from pyspark.sql.types import (
    DoubleType, IntegerType, LongType, StringType, StructField, StructType,
)

SF_DIR = "/root/testdata/sf0.001"
DOCUMENTS = StructType(
    [
        StructField("doc_id", LongType()),
        StructField("text", StringType()),
        StructField("lang", StringType()),
        StructField("source", StringType()),
        StructField("n_chars", LongType()),
        # Names that operators use for columns of their own.
        StructField("row", StringType()),
        StructField("mark", IntegerType()),
        StructField("place", DoubleType()),
        StructField("document", StringType()),
        StructField("held_out", StringType()),
    ]
)
PASSAGE = (
    "Once a passage of many words has been written it may be copied into other texts, and "
    "then the bytes of it start at more than one place; what stands before and after it can "
    "differ, and so the search has to find where exactly it begins and where exactly it ends. "
)


def texts():
    """(doc_id, text): nulls, empty, ties, repeated rows, a very long word, a long text."""
    return [
        (1, "Released under the MIT License. " + PASSAGE),
        (2, "Something else first: " + PASSAGE + "And a different end."),
        (3, None),
        (None, "a text without an id " + PASSAGE[:150]),
        (None, None),
        (5, ""),
        (6, "same row"),
        (6, "same row"),
        (6, "other text of the same id"),
        (7, "x" * 5000),
        (8, "é日本😀 ▁ mixed\tchars \n\n and   blanks    "),
        (-9, "word " * 3000),
        (2**40, "ä" * 3),
        (11, PASSAGE),
        (12, PASSAGE),
        (13, "\x00 control \x1c chars ' 's <|endoftext|> <s>"),
    ]


def frame(spark, rows):
    full = [(i, t, None if i == 5 else "en", None, None if t is None else len(t),
             "r", 7, 0.5, None, "no") for i, t in rows]
    return spark.createDataFrame(full, DOCUMENTS)


@pytest.fixture(scope="session")
def odd(spark):
    return frame(spark, texts()).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return frame(spark, [])


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF_DIR}/documents.parquet")


def pairs(df):
    """(doc_id, text or nothing) of all rows."""
    return [(r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect()]


def in_order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
