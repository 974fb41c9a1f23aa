"""Five stages from raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; all but the last return the
columns of documents.  Null and empty texts, null ids and languages, repeated rows and empty tables pass every stage:

* toxicity: a text without words scores low and stays; repeated rows go or stay together;
* near_duplicates: texts without words link with nothing and stay; of equal texts the smallest id stays, with all rows
  of that id; rows with a null id stay;
* secrets: every row stays; a null text stays null;
* mixing: repeated rows share their draw; a null language or source is a value of its own;
* packing: a null or empty text is a document of the end id alone.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmask.llm import jaccard_join, mixing, packing, secrets, toxicity
from quillmask.llm.common import mark, table, tidy, written

#: texts that go to a Python worker at once; Spark keeps the memory of the largest batch that it has sent
ROWS = 1_000
#: SQL can't express the classifier
ORACLE_SQL = None


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return written(toxicity.reject(docs, toxicity.fit(docs, table(spark, sf_dir, "labels"))), "clean", ROWS)


def near_copies_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that link, the one of smallest id stays."""
    return jaccard_join.keep_first(docs)


def secrets_masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets found are masked in the text; every document stays."""
    return secrets.redact(docs).withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose tokens follow the raked source, language and topic weights."""
    return mixing.mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 2048 tokens at most."""
    return written(packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json")), "pieces", ROWS)


STAGES = [("toxicity", toxic_out), ("near_duplicates", near_copies_out), ("secrets", secrets_masked), ("mixing", mixed), ("packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each but the last is written and read again, and then its predecessor's rows are dropped."""
    docs, since = table(spark, sf_dir, "documents"), mark()
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
        tidy(spark, since, name)
    return STAGES[-1][1](spark, docs, sf_dir)
