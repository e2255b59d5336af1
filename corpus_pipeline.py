"""A corpus from documents to packed sequences: language, near duplicates, personal data, source mix, packing.

Each stage takes what its predecessor kept, as Parquet, and its decisions take effect. All but the last return the columns of
documents; other columns are carried along, whatever their names, as those that stages add on their way are named apart.

Defined cases: null and empty texts, and those without a letter, have no language and go in the first stage; rows of null id have no
near duplicates, and are packed as any other; repeated rows of an id stay together: a copy that another document stands for goes
with all rows of its id; null sources are one source; an empty table passes through every stage and gives no pieces.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwright.llm import langid, mixing, neardup, packing, pii
from siftwright.llm.common import shared_dir, table
from siftwright.llm.queries import _byte_bpe

#: A text is in a language that knows this share of its n-grams, or leads the next one by so much: short texts have uncommon words.
LEAST_SCORE, LEAST_LEAD = 0.4, 0.05

#: Tokenizers and learned models have no SQL; tests/llm/test_pipeline.py holds every stage, and run(), against plain Python.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that are in one of the languages learned from the labelled ones."""
    names = ("_language_pred", "_language_score", "_language_lead")
    judged = langid.predict(docs, langid.fit(docs), *docs.columns, names=names)
    sure = (F.col(names[1]) >= LEAST_SCORE) | (F.col(names[2]) >= LEAST_LEAD)
    return judged.filter((F.col(names[0]) != langid.UNKNOWN) & sure).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least id of each group of similar ones."""
    return neardup.one_of_each(docs, neardup.join(docs)).select(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind; n_chars follows."""
    return pii.redacted(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or drops documents such that sources come near their targets."""
    return mixing.mixed(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of documents and their places in sequences of 1024 tokens."""
    return packing.pack(docs, _byte_bpe(), end_id=0, size=1024)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("mix_sources", mix_sources), ("pack", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = f"{shared_dir(spark)}/siftwright-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
