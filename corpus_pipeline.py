"""A corpus pipeline of five stages, each an operator of ``tessera.llm``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, written as
Parquet and read again for the next one. All but the last return the columns of
``documents``; the last adds how often each document is taken.

Defined cases, in every stage: null and empty texts have no features, lines,
shingles or windows, so only the classifier (by its bias) and the mix (they take
nothing) can drop them; rows without an id stay through ``lines`` and
``near_copies`` and are told apart in ``mix``; repeated rows are judged each,
but equal ones are near copies only under different ids; an empty table passes
through; extra columns are passed on, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontamination, jaccard_join, line_dedup, mixing, quality_classifier
from tessera.llm._spark import table, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality_classifier.keep_good(docs, quality_classifier.fit(docs, table(spark, sf_dir, "labels")))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines with an earlier match go; n_chars follows the text."""
    out = line_dedup.dedup(docs, least_tokens=line_dedup.ANY_SIZE)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: texts linked at 80 % of their shingles of five words."""
    return jaccard_join.keep_first(docs, size=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with ``copies``."""
    return mixing.taken(docs)


STAGES = [("quality", quality), ("lines", lines), ("near_copies", near_copies), ("decontaminate", decontaminate), ("mix", mix)]

#: SQL cannot express the classifier; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
