"""Training-data pipeline over ``documents``: toxic documents go, lines common to many documents
go, one document of each group of near duplicates stays, and the rest is packed.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep the
columns of the documents. ``run`` writes each stage's result to the shared folder and reads it
again, so that a lost executor repeats one stage at most.

Cases: null and empty texts are never toxic, have no common lines and no near duplicates and
are packed as their end alone; null ids and repeated rows pass like others (of repeated rows
with words one stays); extra columns of any name are kept by all stages but the last; empty
tables, labels included, give no rows or no rejections.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mise.llm import lines, minhash, packing, toxicity
from mise.llm.common import stored, table
from mise.llm.queries import vocabulary

MIN_DOCS = 10           # documents that share a line before it goes
WIDTH, PERCENT = 5, 80  # words in a shingle, similarity of near duplicates
WORD_CACHE = 128 << 20  # bytes of encoded words that a worker remembers, beside what the other stages left


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below the toxicity threshold."""
    return toxicity.reject(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their texts without the lines found in ``MIN_DOCS`` documents or more."""
    out = lines.drop_common_lines(docs, MIN_DOCS)
    types = dict(docs.dtypes)
    cut = F.col("n_dropped") > 0
    new = {"text": F.col("kept"), "n_chars": F.char_length("kept")}
    return out.select(*(
        F.when(cut, new[c].cast(types[c])).otherwise(F.col(f"row.`{c}`")).alias(c) if c in new
        else F.col(f"row.`{c}`") for c in docs.columns))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return minhash.keep_one(docs, WIDTH, PERCENT)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' tokens packed into sequences: one row per piece."""
    return packing.pack(docs, vocabulary("word_bpe_49k.json"), cache_bytes=WORD_CACHE)


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_lines), ("near_dedup", drop_copies), ("packing", pack)]

#: The toxicity stage learns its lexicon, which SQL does not express: tested by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
