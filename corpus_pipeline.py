"""A training-text pipeline over the documents table; belongs to contrail.llm.

Each stage reads what its predecessor wrote: quality rules, language identification, line de-duplication,
one document per near-duplicate group, packing. All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial, wraps

from pyspark.sql import DataFrame, SparkSession

from contrail.llm import jaccard_join, language_id, line_dedup, packing, quality_rules
from contrail.llm.queries import tokenizer_file
from contrail.llm.shared import delete, noted, read, stored

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Folders of the tables that the operators of the stage before stored.
_BEFORE: list[str] = []


def stage(f: Stage, first: bool = False) -> Stage:
    """A stage begins when the result of the one before is written, so what that one's operators stored is not read any more and is deleted.

    The first stage deletes nothing: the result of an earlier run may still be read.
    """

    @wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if not first:
            delete(spark, _BEFORE)
        _BEFORE.clear()
        with noted(_BEFORE):
            return f(spark, docs, sf_dir)

    return run_stage


@partial(stage, first=True)
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.apply(docs)


@stage
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.apply(docs)


@stage
def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.apply(docs, keep_emptied=False)


@stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.apply(docs)


@stage
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer_file("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality),
    ("language_id", language),
    ("line_dedup", lines),
    ("jaccard_join", near_duplicates),
    ("packing", packed),
]

#: Compression models, edit joins and packing are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, work in STAGES[:-1]:
        docs = stored(work(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
