import os
import sys

import pytest
from pyspark.sql import types as T

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

#: documents with columns whose names the operators use inside
SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
    T.StructField("lang", T.StringType()), T.StructField("n_chars", T.LongType()),
    T.StructField("row", T.StringType()), T.StructField("key", T.StringType()),
    T.StructField("node", T.IntegerType()), T.StructField("block", T.StringType()),
    T.StructField("component", T.StringType()), T.StructField("n", T.DoubleType())])


def rows_of(pairs):
    return [(i, t, None, None if t is None else len(t), "r", None, 1, "b", "c", 0.5) for i, t in pairs]


def odd_pairs():
    """Nulls, empty and blank texts, a very long one, ties, repeated rows, odd characters."""
    words = [f"w{k * k % 97}x{k % 13}" for k in range(4000)]
    long = " ".join(words) + "\n" + "Common Line\n" * 5
    same = "the same text word for word with enough words in it to be compared\nCommon line "
    out = [(None, "a text without an id"), (None, None), (1, None), (2, ""), (3, " \t\n\x0b "), (4, long),
           (5, same), (5, same), (6, same), (7, same + " edited"), (8, "Ünïcode ▁ İ \U0001f600 \x00 tail\r\nx"),
           (8, "other text, same id"), (9, "x" * 5000), (10, "a"), (11, "a  b   c\n\n d ")]
    out += [(20 + k, f"own words number{k} of{k * 7} document{k}\n\tCOMMON LINE  \nlast{k}") for k in range(12)]
    return out


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(rows_of(odd_pairs()), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def sample(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
