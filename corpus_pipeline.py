"""The corpus pipeline: five stages from raw documents to a weighted mix.

Every stage takes all that the one before kept and, but for the last, returns
the columns of its input, of any names:

1. ``toxicity`` drops documents that score 0.5 or more,
2. ``simhash`` keeps one document of each group of near copies (five-word shingles, similarity 0.8),
3. ``decontamination`` drops documents that overlap with a benchmark item,
4. ``pii`` replaces personal data by its kind and sets ``n_chars`` anew,
5. ``mixing`` takes words of each source to its target and returns what is taken.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.decontaminate import decontaminate
from cairn.llm.mixing import mixed_documents
from cairn.llm.pii import redacted
from cairn.llm.runtime import materialize, release, table, written
from cairn.llm.simhash import one_of_each
from cairn.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that score below 0.5. Null and empty texts stay, repeated rows are judged alike; empty tables give empty results."""
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def simhash(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts whose five-word shingles agree by 0.8 or more, that with the least id. Null and empty texts are one group; a null id counts as largest."""
    return one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that overlap with no benchmark item. Null and empty texts and items overlap with nothing; repeated rows stay or go together."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with personal data replaced by its kind. A null text stays null and has no ``n_chars``; repeated rows change alike."""
    return redacted(docs).withColumn("n_chars", F.length("text").cast("long"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of which the mix takes words. Null and empty texts have none to give; a null source is one of its own; repeated rows share a cut."""
    return mixed_documents(docs)


STAGES = [("toxicity", toxicity), ("simhash", simhash), ("decontamination", decontamination), ("pii", pii), ("mixing", mixing)]

#: Learnt scores and components reached over any number of links aren't expressible.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before = written()
        docs = materialize(stage(spark, docs, sf_dir), name)
        release(spark, since=before, keep=docs)  # what the stage wrote on its way
    return STAGES[-1][1](spark, docs, sf_dir)
