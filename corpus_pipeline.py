"""A training corpus from raw documents: language, near duplicates, benchmark leaks, personal data, source mix.

Each stage reads what the one before it wrote, works on all of it and returns the columns of ``documents``, extra ones too.  An empty
table gives an empty table.  Very long texts are read whole by every stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from sondage.llm import decontaminate, langid, mixing, pii, simhash
from sondage.llm.runtime import delete, released, shared_dir, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the labelled languages, with the language found in ``lang``; the rest go.

    Null and empty texts and those without letters go; repeated rows and rows with a null id stay if their text does; ties between
    languages go to the name that sorts first.
    """
    return langid.in_known_language(docs, langid.labelled_samples(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of the least id.

    Null, empty and wordless texts and rows with a null id are nobody's duplicates and stay; repeated rows of one id are one document,
    and all stay or go.
    """
    return simhash.deduplicate(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no passage of 13 words with the benchmark.

    Null, empty and wordless texts share none and stay, as do rows with a null id; repeated rows of one id all stay or go.
    """
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data and secrets replaced by their kinds.

    Null and empty texts stay as they are; every row stays, also repeated ones and those with a null id; of overlapping finds that of the
    higher score is replaced, and the longer one if they tie.
    """
    return pii.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose tokens meet each source's budget.

    A null source is one of its own.  Rows with a null id and ids without a token go; repeated rows of one id are one document with all
    their tokens; ties within a length are broken by the seeded hash of the id, then the id.
    """
    return mixing.mix(docs)


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("benchmark_leaks", drop_benchmark_leaks),
    ("personal_data", redact_personal_data),
    ("source_mix", mix_sources),
]

#: Suffix automata, SimHash groups and knapsacks are beyond SQL; the tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each written to the shared folder and read again."""
    docs, before = table(spark, sf_dir, "documents"), None
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        # What a stage wrote for itself goes once its result is written, and so does what it read.
        with released():
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        if before:
            delete(spark, before)
        before = f"{folder}/{name}"
        docs = spark.read.parquet(before)
    return STAGES[-1][1](spark, docs, sf_dir)
